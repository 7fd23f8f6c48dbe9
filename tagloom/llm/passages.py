"""Operator 6: removal of passages that repeat, byte by byte, by suffix sorting.

Every window of FAR bytes that also starts elsewhere is covered and goes. Besides, windows of NEAR bytes that also start
elsewhere are followed, and what they cover in one piece counts as a passage if it holds WORDS words: shared passages of
some fifty words are shorter than FAR bytes. op6 reports those, the pipeline's stage removes them too.

Windows can only repeat under a common anchor (anchors.py), so runs of windows whose anchor and side occur once are left
out; the others, equal ones once, are dealt by anchor to shards of bounded size. Each shard is suffix-sorted by external
induced sorting with common-prefix values (induced.py), whose queue goes to disk; neighbours with as long a common prefix
as a window are repeats. A run that occurs twice as a whole, and has no other under its key, repeats as a whole, without
a sort. A key whose distinct runs exceed a shard can't be sorted in one task: its windows are named by 128-bit hashes and
counted, without skew. Repeats of NEAR bytes are looked for in all texts; those of FAR bytes can only lie within pieces
that the former cover, so they are looked for in those pieces alone.

Texts that occur more than once are looked at once; all of their bytes go if there are FAR of them. Texts are told
apart by MD5, equal runs and windows by 128 bits of hash.

Defined cases: null and empty texts have no bytes, are never removed from, and keep the digest of nothing; rows of one
doc_id are separate documents; repeated rows remove each other; an empty table gives no rows; only the named columns
are read. Texts of any length are worked through in parts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import windows
from .common import bit_array, bits_for, give_back, has_bit, materialise, maybe_in, settled, slices, table, text_buffers, tidy
from .induced import suffix_order

#: Bytes of the windows that are followed and of those that are removed; words of a passage.
NEAR, FAR, WORDS = 240, 400, 50
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of a shard, about; and of the distinct runs of one key that still go to a shard.
SHARD, HOT = 1_500_000, 1_500_000
#: Bytes of text that a worker looks at at once.
PART = 250_000
BREAK = np.array([255], np.uint8)  # between runs; no byte of UTF-8
#: Distinct runs whose bytes a task has sent and won't send again.
SENT = 500_000
SPAN_TYPE = "array<struct<b:long,e:long>>"


def print_of(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, text) of every distinct text, and rid of those that occur more than once.

    Texts that may be copies, by a bit map, are summed up by print before they are shuffled; the others stay where they are.
    """
    rows = docs.where(F.octet_length("text") >= NEAR).select(print_of().alias("rid"), "text")
    copies = materialise(rows.groupBy("rid").count().where("count > 1").select("rid"), "passages-copies")
    marked = maybe_in(rows, F.col("rid"), copies, "rid", bits_for(copies))
    once = marked.where("maybe").groupBy("rid").agg(F.first("text").alias("text"))
    return marked.where("NOT maybe").select("rid", "text").unionByName(materialise(once, "passages-once")), copies


def part_windows(data: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Runs of windows of texts that lie end to end; long data in parts that overlap by a window."""
    if len(data) <= 2 * PART:
        yield windows(data, offsets, span), data
        return
    for at in range(0, len(data), PART):  # one long text
        piece = data[at : at + PART + span - 1]
        w = windows(piece, np.array([0, len(piece)]), span)
        yield {k: v + at if k in ("first", "last") else v for k, v in w.items()}, data


def run_keys(texts: DataFrame, span: int) -> DataFrame:
    """Keys of all runs that more than one run has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4096, PART):
                for w, _ in part_windows(*text_buffers(part.column(0)), span):
                    yield pa.RecordBatch.from_arrays([pa.array(w["key"].view(np.int64))], names=["key"])

    return texts.select("text").mapInArrow(tidy(run), "key long").groupBy("key").count().where("count > 1").select("key")


def candidate_runs(texts: DataFrame, keys: DataFrame, span: int) -> DataFrame:
    """key, sid (128 bits of the bytes), rid, start and number of windows, bytes (of the first such run in a task) of runs whose key may repeat."""
    size = bits_for(keys)
    held = texts.sparkSession.sparkContext.broadcast(bit_array(keys, "key", size))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = held.value, set()
        for batch in batches:
            for part in slices(batch, 1, 4096, PART):
                data, offsets = text_buffers(part.column(1))
                rids = part.column(0).to_pylist()
                for w, data in part_windows(data, offsets, span):
                    keep = np.flatnonzero(has_bit(bits, spark_hash(w["key"]) & (size - 1)))
                    cols = {k: [] for k in ("sid", "rid", "start", "windows", "bytes")}
                    for t, a, b in zip(w["text"][keep].tolist(), w["first"][keep].tolist(), w["last"][keep].tolist(), strict=True):
                        raw = data[a : b + span].tobytes()
                        sid = hashlib.blake2b(raw, digest_size=16).digest()
                        cols["sid"].append(sid)
                        cols["rid"].append(rids[t])
                        cols["start"].append(a - int(offsets[t]))
                        cols["windows"].append(b - a + 1)
                        cols["bytes"].append(None if sid in sent else raw)
                        sent.add(sid)
                    if len(sent) > SENT:
                        sent.clear()
                    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(w["key"][keep].view(np.int64)), *(pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True))], names=["key", *cols])

    return texts.select("rid", "text").mapInArrow(tidy(hashed), "key long, sid binary, rid binary, start long, windows int, bytes binary")


def spark_hash(x: np.ndarray) -> np.ndarray:
    """xxhash64 of longs as Spark has it (seed 42), as non-negative remainders need: two's complement."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = h ^ (rot(x.view(np.uint64) * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def repeats_in(runs: list[np.ndarray], counts: np.ndarray, whole: np.ndarray, span: int) -> list[np.ndarray]:
    """For each run of bytes: whether each of its first `counts` windows starts anywhere else among them, or the run occurs twice as a whole."""
    offs = np.cumsum([0, *(len(r) + 1 for r in runs)])
    text = np.concatenate([x for r in runs for x in (r, BREAK)])
    order, common = suffix_order(text, span)
    hit = np.zeros(len(text), bool)
    same = np.flatnonzero(common >= span)
    hit[order[same]] = True
    hit[order[same - 1]] = True
    return [hit[a : a + n] | w for a, n, w in zip(offs[:-1].tolist(), counts.tolist(), whole.tolist(), strict=True)]


def intervals(hit: np.ndarray) -> list[dict]:
    """Runs of True as first and last position."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return [{"a": int(a), "z": int(z)} for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True)]


HITS = pa.schema([("sid", pa.binary()), ("hits", pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))])
HITS_TYPE = "sid binary, hits array<struct<a:int,z:int>>"


def shard_hits(work: DataFrame, shards: int, span: int) -> DataFrame:
    """sid and repeating windows (first, last) for distinct runs dealt to shards by key."""

    def one(tab: pa.Table) -> pa.Table:
        keys, n, counts = tab["key"].to_pylist(), np.asarray(tab["n"]), np.asarray(tab["windows"])
        kinds = Counter(keys)
        several = np.array([kinds[k] > 1 for k in keys])
        found = {i: np.ones(int(counts[i]), bool) for i in np.flatnonzero(~several & (n > 1)).tolist()}
        if several.any():
            some = np.flatnonzero(several)
            runs = [np.frombuffer(tab["bytes"][i].as_buffer(), np.uint8) for i in some.tolist()]
            found |= dict(zip(some.tolist(), repeats_in(runs, counts[some], n[some] > 1, span), strict=True))
            del runs
        sids = tab["sid"].to_pylist()
        out = pa.Table.from_pylist([{"sid": sids[i], "hits": intervals(h)} for i, h in sorted(found.items()) if h.any()], HITS)
        del found
        give_back()
        return out

    dealt = work.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)))
    return dealt.select("shard", "key", "sid", "windows", "n", "bytes").groupBy("shard").applyInArrow(one, HITS_TYPE)


def window_hits(hot: DataFrame, span: int) -> DataFrame:
    """The same for the runs of keys with more distinct runs than a shard holds: each window by its hash, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, n, k, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                names = [hashlib.blake2b(raw[i : i + span], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([k] * n, pa.int64()), pa.array(names, pa.binary())], names=["sid", "i", "n", "name"])

    found = materialise(hot.select("sid", "windows", "n", "bytes").mapInArrow(tidy(run), "sid binary, i int, n long, name binary"), "passages-windows")
    twice = found.groupBy("name").agg(F.sum("n").alias("times")).where("times > 1").select("name")
    hits = found.join(twice, "name").groupBy("sid").agg(F.array_sort(F.collect_list("i")).alias("at"))  # a run's windows: some hundreds
    return hits.select("sid", F.transform("at", lambda i: F.struct(i.alias("a"), i.alias("z"))).alias("hits"))


def repeats(texts: DataFrame, span: int) -> DataFrame:
    """rid and the byte spans (b, e; in order, not merged) that repeats of `span` bytes cover, for each of the texts (rid, text) with any."""
    keys = materialise(run_keys(texts, span), "passages-keys")
    runs = materialise(candidate_runs(texts, keys, span), "passages-runs")
    distinct = runs.groupBy("sid").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.first("windows").alias("windows"), F.first("bytes", ignorenulls=True).alias("bytes"))
    distinct = materialise(distinct, "passages-distinct")
    sizes = distinct.select("key", F.octet_length("bytes").cast("long").alias("size")).groupBy("key").agg(F.count("*").alias("kinds"), F.sum("size").alias("size")).where("kinds > 1")
    sizes = materialise(sizes, "passages-sizes")
    # runs alone under their key need no sort, and their bytes no shuffle
    marked = maybe_in(distinct, F.col("key"), sizes, "key", bits_for(sizes))
    alone = marked.where("NOT maybe AND n > 1").select("sid", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("z"))).alias("hits"))
    work, hot = marked.where("maybe").drop("maybe"), sizes.where(F.col("size") > HOT).select("key")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    if hot.isEmpty():
        hits = shard_hits(work, max(1, -(-int(total) // SHARD)), span)
    else:
        hot = materialise(hot, "passages-hot")
        hits = shard_hits(work.join(hot, "key", "left_anti"), max(1, -(-int(total) // SHARD)), span).unionByName(window_hits(work.join(hot, "key", "left_semi"), span))
    hits = materialise(alone.unionByName(hits), "passages-hits")
    spans = runs.select("sid", "rid", "start").join(hits, "sid").select("rid", F.explode(F.transform("hits", lambda h: F.struct((F.col("start") + h["a"]).alias("b"), (F.col("start") + h["z"] + span).alias("e")))).alias("s"))
    return spans.groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def covered_pieces(texts: DataFrame, near: DataFrame) -> DataFrame:
    """rid (with the first byte's place behind it) and text: the pieces of texts that near's spans cover, where FAR bytes fit in."""
    rows = maybe_in(texts, F.col("rid"), near, "rid", bits_for(near)).where("maybe").join(near, "rid").select("rid", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, pieces = [], []
            for rid, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                for b, e in merged(spans, len(raw)):
                    if e - b >= FAR:
                        rids.append(rid + b.to_bytes(8))
                        pieces.append(raw[b:e])
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(pieces, pa.binary())], names=["rid", "text"])

    return rows.mapInArrow(tidy(run), "rid binary, text binary")


def covered(docs: DataFrame) -> DataFrame:
    """rid, near and far: the byte spans (b, e; in order, not merged) that repeats of NEAR and of FAR bytes cover, for each text with any; whole: true for texts that occur more than once."""
    texts, copies = distinct_texts(docs)
    near = settled(lambda: repeats(texts, NEAR), "passages-near")
    pieces = materialise(covered_pieces(texts, near), "passages-pieces")
    far = settled(lambda: repeats(pieces, FAR), "passages-far")
    far = far.select(F.substring("rid", 1, 16).alias("text_rid"), F.conv(F.hex(F.substring("rid", 17, 8)), 16, 10).cast("long").alias("at"), F.explode("spans").alias("s"))
    far = far.select(F.col("text_rid").alias("rid"), F.struct((F.col("s.b") + F.col("at")).alias("b"), (F.col("s.e") + F.col("at")).alias("e")).alias("s"))
    far = far.groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("far"))
    found = near.withColumnRenamed("spans", "near").join(far, "rid", "left").join(copies, "rid", "left_anti").withColumn("whole", F.lit(False))
    return found.unionByName(copies.select("rid", *(F.lit(None).cast(SPAN_TYPE).alias(c) for c in ("near", "far")), F.lit(True).alias("whole")))


def merged(spans: list[dict] | None, size: int, least: int | None = None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; with `least`: everything, if it is at least so long."""
    if least is not None:
        return [(0, size)] if size >= least else []
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["b"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["e"])
        else:
            out.append([s["b"], s["e"]])
    return [(b, e) for b, e in out]


def runs_of(raw: bytes, near: list[dict] | None, far: list[dict] | None, whole: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal runs of bytes that repeats of FAR bytes cover, and those of NEAR bytes that hold WORDS words."""
    wide = merged(far, len(raw), FAR if whole else None)
    return wide, [(b, e) for b, e in merged(near, len(raw), NEAR if whole else None) if len(WORD.findall(raw, b, e)) >= WORDS]


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in runs)]
    return b"".join([raw[a:b] for a, b in zip(ends, [*(b for b, _ in runs), len(raw)], strict=True)])


def with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that have no spans, and those that have, with columns `__near`, `__far` and `__whole`. A bit map spares most texts the shuffle."""
    marked = maybe_in(docs.withColumn("__rid", print_of()), F.coalesce("__rid", F.lit(b"")), spans, "rid", bits_for(spans))
    marked = marked.withColumn("maybe", F.col("maybe") & (F.octet_length("text") >= NEAR))
    found = spans.select(F.col("rid").alias("__rid"), F.col("near").alias("__near"), F.col("far").alias("__far"), F.col("whole").alias("__whole"))
    some = marked.where("maybe").join(found, "__rid", "left")
    return marked.where("NOT coalesce(maybe, false)").select(*docs.columns), some.select(*docs.columns, "__near", "__far", F.coalesce("__whole", F.lit(False)).alias("__whole"))


def remove_passages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, word_passages (number of passages of WORDS words that repeat) and runs (first byte, end) for each row of docs."""
    docs = docs.select(key, "text")
    spans = settled(lambda: covered(docs), "passages-spans")
    none, some = with_spans(docs, spans)
    runs_type = "array<struct<b:long,e:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, near, far, whole in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                raw = text.encode()
                runs, words = runs_of(raw, near, far, whole)
                rows.append((len(raw), sum(e - b for b, e in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest(), len(words), [{"b": b, "e": e} for b, e in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "word_passages", "runs"])

    kind = docs.schema[key].dataType.simpleString()
    cut_ = some.mapInArrow(tidy(run), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, word_passages long, runs {runs_type}").withColumnRenamed("key", key)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    whole = none.select(key, size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), zero.alias("word_passages"), F.array().cast(runs_type).alias("runs"))
    return whole.unionByName(cut_)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats in 400 bytes or more, removed from all documents; word_passages counts repeated passages of 50 words or more, of any number of bytes from 240."""
    return remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("runs")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the bytes that repeat in FAR bytes, or in passages of WORDS words; a code point of which a byte goes, goes.

    As in the operator every copy of a passage goes, the first too: what many documents share is boilerplate. Documents of
    which no word is left go. n_chars follows.
    """
    spans = settled(lambda: covered(docs.select("text")), "passages-spans")
    none, some = with_spans(docs, spans)

    @F.pandas_udf("string")
    def kept(text, near, far, whole):
        def left(t, n, f, w):
            raw = t.encode()
            both = sorted(sum(runs_of(raw, *(None if x is None else list(x) for x in (n, f)), w), []))
            return cut(raw, merged([{"b": b, "e": e} for b, e in both], len(raw))).decode("utf-8", "ignore")

        return text.__class__([left(*x) for x in zip(text, near, far, whole, strict=True)])

    cleaned = materialise(some.withColumn("__text", kept("text", "__near", "__far", "__whole")).drop("__near", "__far"), "passages-kept")
    changed = F.col("__text") != F.col("text")
    cleaned = cleaned.where(~changed | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    cols = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.char_length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return none.unionByName(cleaned.select(*(cols.get(c, F.col(c)).alias(c) for c in docs.columns)))
