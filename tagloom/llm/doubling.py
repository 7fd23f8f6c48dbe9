"""Operator 13: removal of word passages that earlier documents have, by level-wise doubling of repeated windows.

The first level has windows of half the asked length (7 of 13 words). Of every 13 words, the 7-word window of smallest
hash is looked at, so equal passages look at equal ones and three positions in four are never sent anywhere. Only where
such a window occurs more than once, the 13-word windows around it are candidates of the next level. There 13-word
windows are told apart by 128 bits, and those that start in more than one document survive; the ones with a smaller
doc_id before them remove their words. Survivors L words apart in one text pair up to candidates of 2 L words, named
by both their names; again those in more than one document survive, and so on until no candidate is left. So a level
sorts only what repeated at the level before. `longest` is the last level at which a document still had an earlier copy.

Texts that occur more than once are looked at once, for the smallest doc_id that has them; in the other rows every word
goes, if there are enough words for a window.

Defined cases: null texts have no words; texts with fewer words than a window keep all; rows of one doc_id don't remove
one another's words (no smaller doc_id), so repeated rows are treated alike; a null doc_id counts as smaller than any
other; an empty table gives no rows; only the named columns are read. Texts of any length are worked through in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .anchors import sliding_least
from .common import bit_array, bits_for, has_bit, materialise, maybe_in, settled, slices, spent_shuffles, stored, table, text_buffers, tidy
from .passages import print_of, spark_hash
from .wordids import Windows, row_hash, word_ids

WORDS = 13
#: Rows and bytes of text, and words, that a worker looks at at once.
ROWS, BYTES, PART = 4096, 1_000_000, 1 << 20
SMALLEST = -(1 << 63)


def document(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(SMALLEST))


def copied_texts(docs: DataFrame, key: str) -> DataFrame:
    """rid and first (the smallest doc) of texts that occur more than once."""
    rows = docs.where("text IS NOT NULL").select(print_of().alias("rid"), document(key).alias("doc"))
    return materialise(rows.groupBy("rid").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1").select("rid", "first"), "doubling-copies")


def distinct_texts(docs: DataFrame, copies: DataFrame, key: str, words: int) -> DataFrame:
    """doc, tag and text of every text with room for a window, once, under its smallest doc."""
    rows = docs.where(F.octet_length("text") >= 2 * words - 1).select(print_of().alias("rid"), document(key).alias("doc"), "text")
    marked = maybe_in(rows, F.col("rid"), copies, "rid", bits_for(copies))
    once = marked.where("maybe").groupBy("rid").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    both = marked.where("NOT maybe").select("doc", "text").unionByName(materialise(once.select("doc", "text"), "doubling-once"))
    return both.select("doc", F.xxhash64("text").alias("tag"), "text")


def parts(batch: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Windows]]:
    """For parts of a batch (doc, tag, text): row number and position in its text of every window's first word, its place in the part, and the part's hashes."""
    for piece in slices(batch, 2, ROWS, BYTES):
        ids, at = word_ids(*text_buffers(piece.column(2)))
        base = batch.num_rows and (piece.column(2).offset - batch.column(2).offset)
        for a in range(0, max(len(ids) - words + 1, 0), PART):
            some = ids[a : a + PART + words - 1]
            start = np.arange(len(some) - words + 1)
            row = np.searchsorted(at, start + a, "right") - 1
            ok = start + a + words <= at[row + 1]
            start, row = start[ok], row[ok]
            yield row + base, start + a - at[row], start, Windows(some)


def anchor_keys(start: np.ndarray, w: Windows, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: its half-length window of smallest hash, by place and by hash."""
    half = -(-words // 2)
    every = w.hash(np.arange(w.n - half + 1), half)
    low = (every & ~np.uint64(0xFFFFFF)) | np.arange(len(every), dtype=np.uint64)  # the leftmost of the least
    place = (sliding_least(low, words - half + 1)[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    return place, every[place]


def half_windows(texts: DataFrame, words: int) -> DataFrame:
    """key of the half-length windows that were looked at, if more than one was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, start, w in parts(batch, words):
                place, key = anchor_keys(start, w, words)
                yield pa.RecordBatch.from_arrays([pa.array(key[np.unique(place, return_index=True)[1]].view(np.int64))], names=["key"])

    return texts.mapInArrow(tidy(run), "key long").groupBy("key").count().where("count > 1").select("key")


def windows_at(texts: DataFrame, keys: DataFrame, words: int, names: DataFrame | None = None) -> DataFrame:
    """a, b (128 bits), doc, tag and pos of the windows around half-length ones that may repeat; with names (a, b) only of windows that may be one of those."""
    spark = texts.sparkSession
    maps = [(bit_array(k, "key", n), n) for k in [keys, *([names.select(F.xxhash64("a", "b").alias("key"))] if names is not None else [])] for n in [bits_for(k)]]
    held = spark.sparkContext.broadcast(maps)  # 32 MB each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = (batch.column(i).to_numpy() for i in (0, 1))
            (bits, size), *second = held.value
            for row, pos, start, w in parts(batch, words):
                _, key = anchor_keys(start, w, words)
                keep = np.flatnonzero(has_bit(bits, spark_hash(key) & (size - 1)))
                a, b = (w.hash(start[keep], words, k).view(np.int64) for k in (0, 1))
                for more, n in second:
                    ok = np.flatnonzero(has_bit(more, spark_hash(row_hash([a, b])) & (n - 1)))
                    keep, a, b = keep[ok], a[ok], b[ok]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, docs[row[keep]], tags[row[keep]], pos[keep].astype(np.int32))], names=["a", "b", "doc", "tag", "pos"])

    return texts.mapInArrow(tidy(run), "a long, b long, doc long, tag long, pos int")


def shared_names(rows: DataFrame) -> DataFrame:
    """a, b and first (the smallest doc) of windows that more than one document has."""
    return rows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("a", "b", "first")


def survivors(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The windows among the names; later: a smaller doc has it too."""
    return rows.join(names, ["a", "b"]).select("a", "b", "doc", "tag", "pos", (F.col("first") < F.col("doc")).alias("later"))


def doubled(rows: DataFrame, size: int) -> DataFrame:
    """Windows of 2 * size words whose halves both survived, named by the halves' names."""
    there = Window.partitionBy("doc", "tag").orderBy("pos").rangeBetween(size, size)
    both = rows.select("a", "b", "doc", "tag", "pos", F.max("a").over(there).alias("c"), F.max("b").over(there).alias("d")).where("c IS NOT NULL")
    return both.select(*(F.xxhash64(F.lit(k), "a", "b", "c", "d").alias(n) for k, n in ((1, "a"), (2, "b"))), "doc", "tag", "pos")


def repeated(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """doc, tag, at and longest: positions of the windows of a text that a smaller doc has, and the words of its last level with one.

    Each level's tables are deleted as soon as the next level's stand.
    """
    keys, drop_keys = stored(half_windows(texts, words), "doubling-keys")
    names, drop_names = stored(shared_names(windows_at(texts, keys, words)), "doubling-names")
    alive, drop_alive = stored(survivors(windows_at(texts, keys, words, names), names), "doubling-windows")
    drop_keys()
    drop_names()
    at = materialise(alive.where("later").groupBy("doc", "tag").agg(F.array_sort(F.collect_list("pos")).alias("at")), "doubling-at")  # of one text
    levels, size = [materialise(at.select("doc", "tag", F.lit(words).cast("long").alias("longest")), "doubling-level")], words
    while True:
        rows, drop_rows = stored(doubled(alive, size), "doubling-windows")
        drop_alive()
        if rows.isEmpty():
            drop_rows()
            break
        size *= 2
        names, drop_names = stored(shared_names(rows), "doubling-names")
        alive, drop_alive = stored(survivors(rows, names), "doubling-windows")
        drop_rows()
        drop_names()
        levels.append(materialise(alive.where("later").groupBy("doc", "tag").agg(F.lit(size).cast("long").alias("longest")), "doubling-level"))
    longest = reduce(DataFrame.unionByName, levels).groupBy("doc", "tag").agg(F.max("longest").alias("longest"))
    return at.join(longest, ["doc", "tag"])


def covered(at: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Maximal runs of words that windows at these positions cover."""
    last = np.flatnonzero(np.diff(at, append=1 << 40) > words)
    first = np.concatenate([[0], last[:-1] + 1])
    return list(zip(at[first].tolist(), (at[last] + words).tolist(), strict=True))


def with_windows(docs: DataFrame, copies: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """docs (key, text) with whole (an earlier row has the same text), at and longest. Bit maps spare most texts the shuffles."""
    none = {"at": F.lit(None).cast("array<int>"), "longest": F.lit(0).cast("long")}
    marked = maybe_in(docs.select(key, "text", document(key).alias("doc"), F.coalesce(print_of(), F.lit(b"")).alias("rid")), F.col("rid"), copies, "rid", bits_for(copies))
    firsts = marked.where("maybe").join(copies, "rid", "left").withColumn("whole", F.coalesce(F.col("first") < F.col("doc"), F.lit(False))).drop("first", "maybe")
    firsts = marked.where("NOT maybe").drop("maybe").withColumn("whole", F.lit(False)).unionByName(firsts)
    named = firsts.withColumn("tag", F.coalesce(F.xxhash64("text"), F.lit(0)))
    marked = maybe_in(named, F.xxhash64("doc", "tag"), found.select(F.xxhash64("doc", "tag").alias("both")), "both", bits_for(found))
    ask = F.col("maybe") & ~F.col("whole") & F.col("text").isNotNull()
    some = marked.where(ask).join(found, ["doc", "tag"], "left").select(key, "text", "whole", "at", F.coalesce("longest", F.lit(0)).alias("longest"))
    return marked.where(~ask).withColumns(none).select(key, "text", "whole", "at", "longest").unionByName(some)


def remove_repeats(docs: DataFrame, words: int = WORDS, key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, n_runs, longest and kept_sha256 of each row of docs (key, text); if asked, runs (first word, end) and kept, the words that stay."""
    docs = docs.select(key, "text")
    copies = copied_texts(docs, key)
    with spent_shuffles(docs.sparkSession):
        found = settled(lambda: repeated(distinct_texts(docs, copies, key, words), words), "doubling-found")
    rows = with_windows(docs, copies, found, key)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_removed long, n_runs long, longest long, kept_sha256 string" + (", runs array<struct<b:long,e:long>>, kept string" if with_text else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at_all = batch.column(3)
            for i, (text, whole, longest) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), strict=True)):
                raw = (text or "").encode().split()  # at bytes 20 and 09 to 0D
                n, runs = len(raw), []
                if whole and n >= words:
                    runs, longest = [(0, n)], words << (n // words).bit_length() - 1
                elif at_all[i].is_valid:
                    runs = covered(at_all[i].values.to_numpy(), words)
                ends = [0, *(e for _, e in runs)]
                kept = b" ".join([w for a, z in zip(ends, [*(b for b, _ in runs), n], strict=True) for w in raw[a:z]] if runs else raw)
                row = (n, sum(e - b for b, e in runs), len(runs), longest, hashlib.sha256(kept).hexdigest())
                out.append((*row, [{"b": b, "e": e} for b, e in runs], kept.decode()) if with_text else row)
            cols = zip(*out, strict=True) if out else [[]] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(cols, list(arrow)[1:], strict=True))], names=arrow.names)

    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


def op13_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document of smaller doc_id has, removed from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def levels_sql(n: int = 14) -> str:
    """The levels of doubling as tables a0, a1, ... and the longest one of each row."""
    levels = ["a0 AS MATERIALIZED (SELECT k.r, k.doc_id, k.i, k.h, f.first FROM k JOIN f USING (h))"]
    for i in range(1, n):
        levels.append(f"p{i} AS MATERIALIZED (SELECT x.r, x.doc_id, x.i, md5(x.h || y.h) AS h FROM a{i - 1} x JOIN a{i - 1} y ON x.r = y.r AND y.i = x.i + {WORDS << i - 1})")
        levels.append(f"a{i} AS MATERIALIZED (SELECT p.*, f.first FROM p{i} p JOIN (SELECT h, min(doc_id) AS first FROM p{i} GROUP BY h HAVING min(doc_id) < max(doc_id)) f USING (h))")
    told = " UNION ALL ".join(f"SELECT r, {WORDS << i} AS size FROM a{i} WHERE first < doc_id" for i in range(n))
    return ",\n".join([*levels, f"l AS (SELECT r, max(size) AS longest FROM ({told}) GROUP BY r)"])


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
x AS (SELECT r, doc_id, len(w) AS n, unnest(generate_series(1, CAST(len(w) AS BIGINT) - 12)) AS i, w FROM d WHERE len(w) >= 13),
k AS MATERIALIZED (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM x),
f AS MATERIALIZED (SELECT h, min(doc_id) AS first FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
{levels_sql()},
g AS MATERIALIZED (SELECT DISTINCT a0.r, a0.i + s.j AS p FROM a0, generate_series(0, 12) s(j) WHERE a0.first < a0.doc_id),
o AS (SELECT d.r, unnest(generate_series(1, CAST(len(w) AS BIGINT))) AS p, unnest(w) AS word FROM d),
t AS (SELECT o.r, count(*) AS n_words, count(g.p) AS n_removed, count(g.p) FILTER (WHERE b.p IS NULL) AS n_runs, coalesce(string_agg(o.word, ' ' ORDER BY o.p) FILTER (WHERE g.p IS NULL), '') AS kept
      FROM o LEFT JOIN g ON o.r = g.r AND o.p = g.p LEFT JOIN g b ON o.r = b.r AND o.p = b.p + 1 GROUP BY o.r)
SELECT d.doc_id, CAST(coalesce(t.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.n_runs, 0) AS BIGINT) AS n_runs,
  CAST(coalesce(l.longest, 0) AS BIGINT) AS longest, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r LEFT JOIN l ON d.r = l.r
"""
