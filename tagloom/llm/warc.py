"""Operator 1: WARC archives, and the normaliser of archives that are one gzip stream.

`write_archives` writes one record per row into whole-file gzip streams. `normalise` inflates each stream once, block
by block, writes every record as a gzip member of its own and a sidecar index of their offsets. `read_records` reads
records by that index. All files lie in a folder that driver and executors share; a task that is run again writes
files of other names, and only files that a finished task has reported are read.

Defined cases: null html is an empty payload; null urls give no target header; rows without page_id are written and
read back with a null page_id; of equal payloads whose rows repeat the largest page_id, each row with it is a response;
an empty table gives no archives and no rows. Payloads of any length pass through in blocks. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table

BLOCK = 1 << 20
#: Uncompressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_head(fields: dict[str, str | int | None], length: int) -> bytes:
    """A record's header block; line ends and controls in values are percent-encoded."""
    safe = {k: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(v)) for k, v in fields.items() if v is not None}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in safe.items()) + f"Content-Length: {length}\r\n\r\n").encode("utf-8", "surrogatepass")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """Head and block of the record of one page; a revisit has the HTTP head alone."""
    block = HTTP if refers_to is not None else HTTP + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Target-URI": url,
        "WARC-Date": "1970-01-01T00:00:00Z",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": len(payload),
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "WARC-Profile": None if refers_to is None else PROFILE,
    }
    return record_head(fields, len(block)), block


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """records: page_id, url, payload, digest, refers_to. Returns path and number of records of each archive written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(5)]
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, zipper, size, n = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                head, block = page_record(*row)
                for part in (head, block, b"\r\n\r\n"):
                    out.write(zipper.compress(part))
                    size += len(part)
                n += 1
                if size >= ARCHIVE_BYTES:
                    out.write(zipper.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})
                    out = None
        if out is not None:
            out.write(zipper.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, n_records long")


class Inflated:
    """Reads the inflated bytes of a gzip file of one or many members, each byte once."""

    def __init__(self, source):
        self.source, self.have, self.unzip, self.rest = source, b"", zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate one more block; whether there was any."""
        if self.unzip.eof:
            self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        raw = self.unzip.unconsumed_tail or self.rest or self.source.read(BLOCK)
        self.rest = b""
        if not raw:
            return False
        self.have += self.unzip.decompress(raw, BLOCK)
        return True

    def head(self) -> bytes:
        """Up to and with the next empty line; b"" at the end of the file."""
        while (at := self.have.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.have.strip():
                    raise ValueError("the archive ends within a record's head")
                return b""
        out, self.have = self.have[: at + 4], self.have[at + 4 :]
        return out

    def body(self, length: int) -> Iterator[bytes]:
        """The next `length` bytes, in blocks."""
        while length:
            if not self.have and not self.more():
                raise ValueError("the archive ends within a record's block")
            out, self.have = self.have[:length], self.have[length:]
            length -= len(out)
            yield out


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_file(fs, source: str, target: str, index: str) -> int:
    """One archive; returns the number of records. index: a JSON line per record."""
    with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(index) as side:
        stream, offset, n = Inflated(raw), 0, 0
        while head := stream.head():
            fields = parse_head(head)
            zipper, start = zlib.compressobj(6, zlib.DEFLATED, 31), offset
            parts = itertools.chain([head], stream.body(int(fields["content-length"]) + 4))  # with the two line ends behind the block
            for data in itertools.chain(map(zipper.compress, parts), (zipper.flush() for _ in range(1))):
                out.write(data)
                offset += len(data)
            line = {"offset": start, "length": offset - start, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri")}
            side.write(json.dumps(line).encode() + b"\n")
            n += 1
    return n


def spread(files: DataFrame) -> DataFrame:
    """One file a task, as far as there are tasks: each row stands for much work."""
    return files.repartition(max(1, min(files.count(), 20_000)))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of column `path` with a gzip member a record; returns path, index and number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = uuid.uuid4().hex
                n = normalise_file(fs, pafs.FileSystem.from_uri(path)[1], f"{root}/{name}.warc.gz", f"{root}/{name}.idx")
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.gz"], "index": [f"{folder}/{name}.idx"], "n_records": pa.array([n], pa.int64())})

    return spread(archives.select("path")).mapInArrow(run, "path string, index string, n_records long")


def page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def read_member(raw: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[: int(fields["content-length"])]


def read_records(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of normalised archives (columns path, index), each read by its offset; payloads are held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(pafs.FileSystem.from_uri(index)[1]) as side:
                    entries = [json.loads(x) for x in side.read().splitlines()]
                with fs.open_input_file(at) as archive:
                    for begin in range(0, len(entries), 256):
                        cols = {"page_id": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": [], "url": [], "payload": []}
                        for e in entries[begin : begin + 256]:
                            fields, block = read_member(archive.read_at(e["length"], e["offset"]))
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                            if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{e['id']}: the payload isn't that of its digest")
                            row = (page_of(fields["warc-record-id"]), int(fields["x-payload-length"]), digest, fields["warc-type"], page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload)
                            for c, v in zip(cols.values(), row, strict=True):
                                c.append(v)
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                        keep = 7 if with_payload else 6
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(cols.values())[:keep], kinds, strict=False)], names=list(cols)[:keep])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if with_payload else "")
    return spread(files.select("path", "index")).mapInArrow(run, schema)


def page_records(pages: DataFrame) -> DataFrame:
    """Rows of write_archives for pages (page_id, url, html): which of equal payloads is the response is settled by digest.

    Groups of copies are summed up before the shuffle, and the join on the digest is one that Spark splits where a key is hot.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.where(F.octet_length("payload") >= REVISIT_FROM)
        .groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "first_id")
    )
    return rows.join(groups, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to one-stream archives, normalised, and read back by the sidecar indexes."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = materialise(write_archives(page_records(table(spark, sf_dir, "pages")), f"{folder}/raw"), "warc-raw")
    files = materialise(normalise(archives, f"{folder}/normal"), "warc-normal")
    return read_records(files).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest,
         octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT digest, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN g.first_id IS NULL OR g.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.n >= 1000
"""
