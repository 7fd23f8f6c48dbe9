"""A sink of files with given names, with a manifest that is written last.

Spark's own sinks name their part files; labels, debug documents, results and frames must lie under the names that others
look for. Rows are (path, at, content): what is written to a path is the contents in order of `at`. Every task writes its
files under temporary names, moves each into place when it is whole, and lists them in a part of the manifest, which
reaches the driver by name only. The driver writes `_manifest.json` once all tasks are done: without it there is no
result. If the job fails, the files of its finished tasks are removed.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST, PARTS = "_manifest.json", "_manifest"


@dataclass
class Listed(WriterCommitMessage):
    """The part of the manifest that a task wrote (none without files) and its sums."""

    part: str | None
    files: int
    size: int


class NamedWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def open(self) -> tuple[pafs.FileSystem, str]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        return fs, base.rstrip("/")

    def write(self, iterator: Iterator) -> Listed:
        fs, base = self.open()
        mark, path, out, digest, lines = uuid.uuid4().hex, None, None, None, []
        made: set[str] = set()

        def finish() -> None:
            if out is not None:
                out.close()
                fs.move(f"{base}/{path}.{mark}", f"{base}/{path}")
                lines.append({"path": path, "rows": rows, "bytes": size, "sha256": digest.hexdigest()})

        rows = size = 0
        try:
            for row in iterator:
                if row[0] != path:
                    finish()
                    path, rows, size, digest = row[0], 0, 0, hashlib.sha256()
                    if (folder := posixpath.dirname(f"{base}/{path}")) not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    out = fs.open_output_stream(f"{base}/{path}.{mark}")
                content = bytes(row[2])
                out.write(content)
                digest.update(content)
                rows, size = rows + 1, size + len(content)
            finish()
        except BaseException:
            if out is not None:
                out.close()
                with contextlib.suppress(OSError):
                    fs.delete_file(f"{base}/{path}.{mark}")
            self.remove(fs, base, [x["path"] for x in lines])
            raise
        if not lines:
            return Listed(None, 0, 0)
        part = f"{PARTS}/{mark}.json"
        fs.create_dir(f"{base}/{PARTS}", recursive=True)
        with fs.open_output_stream(f"{base}/{part}") as f:
            f.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
        return Listed(part, len(lines), sum(x["bytes"] for x in lines))

    def commit(self, messages: list) -> None:
        fs, base = self.open()
        done = [m for m in messages if m and m.part]
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done), "parts": sorted(m.part for m in done)}, indent=1).encode())

    def abort(self, messages: list) -> None:
        fs, base = self.open()
        for m in messages:
            if m and m.part:
                with fs.open_input_stream(f"{base}/{m.part}") as f:
                    self.remove(fs, base, [json.loads(x)["path"] for x in f.read().splitlines()])
                self.remove(fs, base, [m.part])

    @staticmethod
    def remove(fs: pafs.FileSystem, base: str, paths: list[str]) -> None:
        for p in paths:
            with contextlib.suppress(OSError):
                fs.delete_file(f"{base}/{p}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["root"])


def write_named(rows: DataFrame, root: str) -> None:
    """rows: path (relative to root), at (order within a file), content (binary or string)."""
    rows.sparkSession.dataSource.register(NamedFiles)
    slim = rows.select("path", F.col("at").cast("long").alias("at"), F.col("content").cast("binary").alias("content"))
    slim.repartition("path").sortWithinPartitions("path", "at").write.format("named_files").option("root", root).mode("append").save()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, rows, bytes and sha256 of the files of a finished write; fails where there was none."""
    fs, base = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{base.rstrip('/')}/{MANIFEST}") as f:
        parts = json.loads(f.read())["parts"]
    schema = "path string, rows long, bytes long, sha256 string"
    return spark.read.schema(schema).json([f"{root}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def label_files(labels: DataFrame) -> DataFrame:
    """Rows for write_named: a text file for each frame of labels (split, frame, ord, line), in folders by split, and frames without a box (line null) as empty files."""
    name = F.concat_ws("/", F.lit("labels"), "split", F.concat(F.regexp_replace("frame", r"[/:]", "_"), F.lit(".txt")))
    return labels.select(name.alias("path"), F.col("ord").alias("at"), F.coalesce(F.concat("line", F.lit("\n")), F.lit("")).alias("content"))


def document_files(rows: DataFrame, name: Column, order: str) -> DataFrame:
    """Rows for write_named: a JSON line for each row, in the file `name` of its own."""
    return rows.select(name.alias("path"), F.col(order).alias("at"), F.concat(F.to_json(F.struct(*rows.columns)), F.lit("\n")).alias("content"))


def table_files(rows: DataFrame, name: Column, order: str, columns: list[str]) -> DataFrame:
    """Rows for write_named: a CSV file for each name, with a byte order mark and a header of its own."""
    line = F.concat(F.regexp_replace(F.to_csv(F.struct(*columns), {"emptyValue": "", "nullValue": "", "escape": '"'}), r"[\r\n]+", " "), F.lit("\n"))
    named = rows.select(name.alias("path"), F.col(order).cast("long").alias("at"), line.alias("content"))
    heads = named.select("path").distinct().select("path", F.lit(-(1 << 62)).alias("at"), F.lit("﻿" + ",".join(columns) + "\n").alias("content"))
    return named.unionByName(heads)
