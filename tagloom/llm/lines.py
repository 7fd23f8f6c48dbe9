"""Operator 8: removal of repeated runs of lines, by a suffix array over line-ID sequences.

Every document is a sequence of line ids. Ranks of the suffixes by their first h lines are doubled: the pair of ranks at
a position and h lines on gives the rank by 2 h lines, by a global sort of the distinct pairs. Suffixes whose first h
lines occur once drop out, so what is sorted shrinks to what repeats. At depth MIN_LINES the suffixes of one rank are a
longest-common-prefix interval: its first suffix, by (doc_id, line), stays, the lines of the others are deleted;
neighbouring deleted windows make up maximal runs. Where a number of words is given, a line of so many words is a run by
itself: the later ones of its depth-1 group are deleted too. The pipeline asks for LONG_WORDS; op8 and its SQL don't.

Defined cases: lines end at "\\n"; null texts have no lines and stay null; a run of blank lines alone is no repeat; rows of equal doc_id
and text are one document and are treated alike; null doc_ids come first; an empty table gives no rows; only the named
columns are read. Groups of any size are counted before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, maybe_in, table

MIN_LINES = 2
#: Words that make a single line a run in the pipeline.
LONG_WORDS = 50
MAP_BITS = 1 << 24


def document() -> Column:
    """What tells documents apart: doc_id and text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))


def ranked(groups: DataFrame, *keys: str) -> DataFrame:
    """groups with a column `rank` in the order of the keys: sorted over ranges, so no task sees all."""
    return materialise(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "lines-ranks")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """doc (see document()), at and n: first lines and lengths of windows that have an earlier copy.

    Windows have min_lines lines; with long_words, also one line of at least so many words.
    """
    lines = docs.where("text IS NOT NULL").select("doc_id", document().alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    long = F.size(F.array_remove(F.split("line", r"\s+"), "")) >= long_words if long_words else F.lit(False)
    rows = lines.select("doc_id", "doc", "at", F.unhex(F.md5("line")).alias("a"), (F.length(F.trim("line")) > 0).cast("int").alias("filled"), long.alias("long"))
    rows = materialise(rows.distinct(), "lines-rows")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "doc", "at")).alias("first")
    repeated = lambda x, *keys: x.groupBy(*keys).agg(F.count("*").alias("n"), first, F.max("filled").alias("any")).where("n > 1")
    groups = ranked(repeated(rows, "a").select("a", "first", "any"), "a")
    singles = rows.where("long").join(groups.select("a", "first"), "a").where("doc <> first.doc OR at <> first.at").select("doc", "at", F.lit(1).alias("n"))
    depth, suffixes = 1, rows.join(groups.select("a", "rank"), "a").select("doc_id", "doc", "at", "rank", "filled")
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        there = Window.partitionBy("doc").orderBy("at").rangeBetween(step, step)
        pairs = suffixes.select("doc_id", "doc", "at", F.col("rank").alias("a"), F.max("rank").over(there).alias("b"), F.greatest("filled", F.max("filled").over(there)).alias("filled")).where("b IS NOT NULL")
        pairs = materialise(pairs, "lines-pairs")
        groups = ranked(repeated(pairs, "a", "b").select("a", "b", "first", "any"), "a", "b")
        suffixes = pairs.join(groups.select("a", "b", "rank"), ["a", "b"]).select("doc_id", "doc", "at", "rank", "filled")
        depth += step
    kept = groups.where(F.col("any") > 0).select("rank", F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at"))
    windows = suffixes.join(kept, "rank").where("doc <> first_doc OR at <> first_at").select("doc", "at", F.lit(min_lines).alias("n"))
    return windows.unionByName(singles) if long_words else windows


def remove_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """docs with the text that is left, and gone: positions of deleted lines, in order."""
    windows = later_copies(docs.select("doc_id", "text"), min_lines, long_words)
    gone = windows.select("doc", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("line")).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    gone = materialise(gone, "lines-gone")
    none = F.array().cast("array<int>")
    marked = maybe_in(docs.withColumn("__doc", F.coalesce(document(), F.lit(""))), F.col("__doc"), gone, "doc", MAP_BITS)
    some = marked.where("maybe").join(gone.select(F.col("doc").alias("__doc"), F.col("gone").alias("__gone")), "__doc", "left")
    some = some.withColumn("__gone", F.when(F.col("text").isNotNull(), F.coalesce("__gone", none)).otherwise(none))
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.size("__gone") > 0, F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")).otherwise(F.col("text"))
    changed = some.withColumn("__text", text).select(*(F.col("__text").alias("text") if c == "text" else F.col(c) for c in docs.columns), F.col("__gone"))
    return marked.where("NOT maybe").select(*docs.columns, none.alias("__gone")).unionByName(changed)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of two lines or more, removed from all documents but the first that has them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    out = remove_lines(docs)
    runs = F.size(F.filter("__gone", lambda x: ~F.array_contains("__gone", x - 1)))
    n = F.when(F.col("whole").isNull(), 0).otherwise(F.size(F.split("whole", "\n")))
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, long_words: int | None = None) -> DataFrame:
    """Pipeline stage: texts without later copies of runs; documents of which nothing is left go. n_chars follows."""
    out = remove_lines(docs, long_words=long_words)
    cut = F.size("__gone") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where(~cut | (F.length(F.trim("text")) > 0)).select(*docs.columns)


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same, with single lines of LONG_WORDS words or more."""
    return stage(spark, docs, sf_dir, LONG_WORDS)


ORACLE = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos
           FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, pos, line AS a, lead(line) OVER (PARTITION BY doc_id, text ORDER BY pos) AS b FROM l),
g AS (SELECT a, b, min((doc_id, pos)) AS first FROM w WHERE b IS NOT NULL AND (trim(a) <> '' OR trim(b) <> '') GROUP BY a, b HAVING count(*) > 1),
d AS (SELECT DISTINCT w.doc_id, w.text, w.pos + s.i AS pos FROM w JOIN g ON w.a = g.a AND w.b = g.b, (VALUES (0), (1)) s(i) WHERE (w.doc_id, w.pos) <> g.first),
k AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(d.pos) AS n_removed,
        count(d.pos) FILTER (WHERE p.pos IS NULL) AS n_runs,
        coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL), '') AS kept
      FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.text = d.text AND l.pos = d.pos
      LEFT JOIN d p ON l.doc_id = p.doc_id AND l.text = p.text AND l.pos - 1 = p.pos GROUP BY l.doc_id, l.text)
SELECT o.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents o LEFT JOIN k ON o.doc_id = k.doc_id AND o.text = k.text
"""
