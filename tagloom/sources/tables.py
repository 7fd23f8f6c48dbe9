"""Sources and sinks of tag tables, listings and configurations."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY_COLUMNS, LEGACY_NAMES, TAG_COLUMNS

TRUE_WORDS = {"1", "true", "yes", "y", "on"}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tag rows of CSV files, all strings: old names renamed, missing columns blank, in the fixed order."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    return as_rows(raw.withColumnsRenamed(LEGACY_NAMES))


def as_rows(df: DataFrame) -> DataFrame:
    """The fixed columns alone; null and NaN are blank."""
    return df.select(*((F.coalesce(F.when(F.lower(F.col(c).cast("string")) != "nan", F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in TAG_COLUMNS))


def to_row(fields: Column) -> list[Column]:
    """The fixed columns of an observation: ordinary ones of a map, sides with one decimal, whole milliseconds."""
    side = lambda c: F.call_function("format_number", F.col(c), F.lit("0.0")).cast("double").alias(c)
    out = []
    for c in TAG_COLUMNS:
        if c in KEY_COLUMNS[2:]:
            out.append(side(c))
        elif c == "frame_timestamp":
            out.append(F.col("timestamp_ms").cast("long").alias(c))
        else:
            out.append(F.col(c) if c == "filename" else F.coalesce(F.element_at(fields, c), F.lit("")).alias(c))
    return out


def write_rows(df: DataFrame, path: str) -> None:
    """CSV part files with a header whose first name carries the byte order mark that spreadsheets look for."""
    first = TAG_COLUMNS[0]
    df.select(F.col(first).alias("﻿" + first), *TAG_COLUMNS[1:]).write.mode("overwrite").option("header", True).csv(path)


def label_pairs(files: DataFrame) -> DataFrame:
    """csv, video for files (path): the video of the same stem, else the folder's own; pairs without a video go."""
    p = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("kind"))
    labels, videos = p.where("kind = 'csv'"), p.where("kind = 'mp4'")
    own = videos.select("dir", "stem", F.col("path").alias("own"))
    folder = videos.select("dir", F.col("stem").alias("name"), F.col("path").alias("folder"))
    met = labels.withColumn("name", F.regexp_extract("dir", r"([^/]*)$", 1)).join(own, ["dir", "stem"], "left").join(folder, ["dir", "name"], "left")
    return met.select(F.col("path").alias("csv"), F.coalesce("own", "folder").alias("video")).where("video IS NOT NULL")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path and modified of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"))


def newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The file of latest change, by name among equal ones."""
    return files.groupBy(*keys).agg(F.max(F.struct("modified", "path")).alias("x")).select(*keys, F.col("x.path").alias("path"), F.col("x.modified").alias("modified"))


def sample_frames(frames: DataFrame, fps: Column, sample_fps: float, min_sharpness: float, max_frames: int = 0) -> DataFrame:
    """Every step-th frame that is sharp enough, at most max_frames a video (0: all)."""
    from pyspark.sql import Window

    step = F.greatest(F.lit(1), F.rint(fps / sample_fps).cast("int")) if sample_fps > 0 else F.lit(1)
    kept = frames.where((F.pmod("frame_index", step) == 0) & (F.col("sharpness") >= min_sharpness))
    if not max_frames:
        return kept
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy("filename").orderBy("frame_index"))).where(F.col("__r") <= max_frames).drop("__r")


def nearest_frame(asked: DataFrame, frames: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """asked (filename, ts) with the frame of nearest time, the earlier of equally near ones.

    Time is cut into buckets. Within a bucket two windows find the frames on either side; where it has none, the last frame
    of the buckets before and the first of those behind are carried in by a table with a row for each bucket. So a task
    sorts one bucket of a video, not the video.
    """
    from pyspark.sql import Window

    bucket = F.floor(F.col("t") / bucket_ms).alias("bucket")
    times = frames.select("filename", F.col("timestamp_ms").alias("t")).withColumn("bucket", bucket)
    wanted = asked.select("filename", F.col("ts").alias("t")).withColumn("bucket", bucket)
    ends = times.groupBy("filename", "bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    every = ends.unionByName(wanted.select("filename", "bucket", *(F.lit(None).cast("long").alias(c) for c in ("lo", "hi")))).groupBy("filename", "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = Window.partitionBy("filename").orderBy("bucket")  # a row for each bucket
    carried = every.select("filename", "bucket", F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("behind"))
    both = times.select("filename", "bucket", "t", F.col("t").alias("f"), F.lit(0).alias("ask")).unionByName(wanted.select("filename", "bucket", "t", F.lit(None).cast("long").alias("f"), F.lit(1).alias("ask")))
    running = lambda *order: F.last("f", True).over(Window.partitionBy("filename", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"p": running("t", "ask"), "n": running(F.desc("t"), "ask")}).where("ask = 1").join(carried, ["filename", "bucket"])
    met = met.withColumns({"p": F.coalesce("p", "before"), "n": F.coalesce("n", "behind")})
    near = F.when(F.col("p").isNull(), F.col("n")).when(F.col("n").isNull(), F.col("p")).when(F.col("t") - F.col("p") <= F.col("n") - F.col("t"), F.col("p")).otherwise(F.col("n"))
    return met.select("filename", F.col("t").alias("ts"), near.alias("frame_ts"))


def read_config(path: str | None) -> dict:
    """Settings of a JSON or YAML file; {} if there is none. Where no YAML reader is installed, plain "key: value" lines are read; nested ones are refused."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
        if any(x[0] in " \t-" or ":" not in x for x in lines):
            raise ValueError(f"{path}: nested settings need a YAML reader") from None
        return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v.strip()}


def env_flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    return env[name].strip().lower() in TRUE_WORDS if name in env else default


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_yolo(labels: DataFrame, path: str) -> None:
    """labels: split, frame, ord, line. One text row a frame, in folders by split."""
    lines = labels.groupBy("split", "frame").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("x"))
    lines.select("split", F.array_join(F.col("x.line"), "\n").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def by_stem(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (path) with `other`, the right paths of the same file name without its ending; null where there is none."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[a-z0-9]+$", "")
    return left.withColumn("stem", stem).join(right.select(stem.alias("stem"), F.col("path").alias("other")), "stem", "left")


def scan_with_hits(frames: DataFrame, hits: DataFrame, fps: Column, sample_fps: float, most: int) -> DataFrame:
    """filename, frame_index and number of hits n of the first `most` sampled frames that have any."""
    from pyspark.sql import Window

    step = F.greatest(F.lit(1), F.rint(fps / max(0.1, sample_fps)).cast("int"))
    n = hits.groupBy("filename", "frame_index").agg(F.count("*").alias("n"))
    met = frames.where(F.col("frame_index") % step == 0).select("filename", "frame_index").distinct().join(n, ["filename", "frame_index"])
    return met.withColumn("__r", F.row_number().over(Window.partitionBy("filename").orderBy("frame_index"))).where(F.col("__r") <= most).drop("__r")


def union_of(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """All rows of several tables, with the table's name as a column; columns that some lack are null there."""
    out = None
    for k, part in parts.items():
        part = part.withColumn(name, F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
