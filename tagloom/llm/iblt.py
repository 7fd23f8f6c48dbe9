"""Operator 9: document fingerprints as invertible Bloom lookup sketches, in DataFrame functions alone.

A text's paragraphs (its lines, long ones in pieces of PIECE characters from their start) are hashed; each distinct
digest goes to three of the sketch's cells, which hold a count, the digests' xor and their check sums' xor. Sketches of
two versions are subtracted cell by cell; what both hold cancels. Cells with a single digest are peeled, round by
round, until the digests of either side alone are recovered; if cells are left over, larger sketches with other
hashes are tried, at last one of twice as many cells as there are digests. Likeness is the number of common digests by that of all.

The next document in the order of (doc_id, text) is found on ids alone: a range sort numbers them, and each
range's end is joined to the next one's begin. Texts are shuffled once, and of the next text only as much as is needed.

Defined cases: a null text is empty; an empty text has a sketch of empty cells, and two empty ones are alike (1.0);
rows of equal doc_id and text are one document, followed by the next different one; null doc_ids come first; a single
document is its own next; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

PIECE = 240
#: Cells of the fingerprint, of the first retry as well; rounds of peeling.
CELLS, RETRIES, ROUNDS = 48, (192, 768), 16


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(rf"([^\n]{{1,{PIECE}}})"), F.lit(1))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def placed(keys: Column, cells: Column, level: int, sign: int = 1) -> Column:
    """Digests with their check sums and their three cells, one in each third of the sketch."""
    third = (cells / 3).cast("int")
    place = lambda k, j: (F.pmod(F.xxhash64(k, F.lit(3 * level + j)), third) + j * third).cast("int")
    return F.transform(keys, lambda k: F.struct(F.lit(sign).alias("n"), k.alias("k"), F.xxhash64(k, F.lit(-1 - level)).alias("h"), place(k, 0).alias("a"), place(k, 1).alias("b"), place(k, 2).alias("c")))


def at_cell(items: Column, i: Column, third: Column) -> Column:
    """The items of a cell: its third tells which of their places counts."""
    return F.when(i < third, F.filter(items, lambda x: x["a"] == i)).when(i < 2 * third, F.filter(items, lambda x: x["b"] == i)).otherwise(F.filter(items, lambda x: x["c"] == i))


def added(cell: Column, items: Column, sign: int) -> Column:
    """A cell with items added (sign 1) or taken away (-1)."""
    return F.aggregate(items, cell, lambda s, x: F.struct((s["n"] + sign * x["n"]).alias("n"), s["k"].bitwiseXOR(x["k"]).alias("k"), s["h"].bitwiseXOR(x["h"]).alias("h")))


def sketch(keys: Column, cells: Column, level: int) -> Column:
    """The cells of a set of digests."""
    items = placed(keys, cells, level)
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    one = lambda it: F.transform(F.sequence(F.lit(0), cells - 1), lambda i: added(empty, at_cell(it, i, (cells / 3).cast("int")), 1))
    return F.element_at(F.transform(F.array(items), one), 1)  # items made once


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peeled(cells: Column, size: Column, level: int) -> Column:
    """struct(cells left, found): number of digests recovered; nothing is left if it succeeds."""

    def single(all_: Column) -> Column:
        alone = F.filter(all_, lambda x: (F.abs(x["n"]) == 1) & (F.xxhash64(x["k"], F.lit(-1 - level)) == x["h"]))
        third = (size / 3).cast("int")
        place = lambda k, j: (F.pmod(F.xxhash64(k, F.lit(3 * level + j)), third) + j * third).cast("int")
        return F.array_distinct(F.transform(alone, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["h"].alias("h"), place(x["k"], 0).alias("a"), place(x["k"], 1).alias("b"), place(x["k"], 2).alias("c"))))

    def step(state: Column, _: Column) -> Column:
        def taken(items: Column) -> Column:
            rest = F.transform(state["cells"], lambda x, i: added(x, at_cell(items, i, (size / 3).cast("int")), -1))
            return F.struct(F.when(F.size(items) > 0, rest).otherwise(state["cells"]).alias("cells"), (state["found"] + F.size(items)).alias("found"))

        busy = F.exists(state["cells"], lambda x: x["n"] != 0)
        return F.when(busy, F.element_at(F.transform(F.array(single(state["cells"])), taken), 1)).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("cells"), F.lit(0).alias("found")), step)


def differing(a: Column, b: Column, first: tuple[Column, Column] | None = None) -> Column:
    """Number of digests in one of the two sets only, by ever larger sketches; null if even the largest fails."""

    def attempt(level: int, size: Column, pair: tuple[Column, Column] | None = None) -> Column:
        x, y = pair or (sketch(a, size, level), sketch(b, size, level))
        done = lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0)), s["found"])
        return F.element_at(F.transform(F.array(peeled(subtracted(x, y), size, level)), done), 1)

    sizes = [F.lit(CELLS), *map(F.lit, RETRIES), (2 * (F.size(a) + F.size(b)) + 3) * 3]
    tries = [attempt(level, size, first if not level else None) for level, size in enumerate(sizes)]
    return F.coalesce(*tries)  # stops at the first that succeeds


def likeness(a: Column, b: Column, first: tuple[Column, Column] | None = None) -> Column:
    n = F.size(a) + F.size(b)
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))  # for the case that no sketch is large enough
    d = F.coalesce(differing(a, b, first), exact)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d))


def written(cells: Column) -> Column:
    """A sketch as text: count, digests' and check sums' xor of each cell, in hex; empty cells are empty."""
    return F.array_join(F.transform(cells, lambda x: F.when((x["n"] == 0) & (x["k"] == 0), F.lit("")).otherwise(F.concat_ws(":", x["n"].cast("string"), F.hex(x["k"]), F.hex(x["h"])))), ",")


def followed(keys: DataFrame) -> DataFrame:
    """keys: doc_id, k, n, one row a document. Adds those of the document before: prev_id, prev_k, prev_n.

    Ids alone are sorted, over ranges; the first of each range finds its predecessor in the ends of the ranges, of which
    there are as many as partitions.
    """
    order = ["doc_id", "k"]
    rows = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows, "print-order").withColumn("part", F.shiftright("at", 33))
    ends = rows.groupBy("part").agg(F.min("at").alias("first_at"), F.max(F.struct("at", "doc_id", "k", "n")).alias("last"))
    ring = Window.orderBy("part")
    before = F.coalesce(F.lag("last").over(ring), F.last("last").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = ends.select(F.col("first_at").alias("at"), before.alias("p"))
    own = rows.select((F.col("at") + 1).alias("at"), F.struct("at", "doc_id", "k", "n").alias("p"))
    prev = rows.select("at").join(heads, "at", "left_anti").join(own, "at").unionByName(heads)
    return rows.drop("part").join(prev, "at").select(*order, "n", F.col("p.doc_id").alias("prev_id"), F.col("p.k").alias("prev_k"), F.col("p.n").alias("prev_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.md5("text"))
    keys = followed(rows.select("doc_id", "k", F.char_length("text").cast("long").alias("n")).distinct())
    same = lambda x, y: [F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")), F.col(f"{x}.k") == F.col(f"{y}.k")]
    met = rows.alias("r").join(keys.alias("o"), same("r", "o")).select("r.doc_id", "r.k", "text", "n", "prev_id", "prev_k", "prev_n")
    given = met.groupBy("prev_id", "prev_k").agg(F.first(F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 2).cast("int"))).alias("begin"), F.first(digests(F.col("text"))).alias("next_keys"))
    pairs = rows.alias("r").join(given.alias("g"), [F.col("r.doc_id").eqNullSafe(F.col("g.prev_id")), F.col("r.k") == F.col("g.prev_k")])
    n = F.char_length("text")
    out = pairs.select("r.doc_id", n.cast("long").alias("n_chars"), digests(F.col("text")).alias("own"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("begin")).alias("edited"), "next_keys")
    out = out.select("doc_id", "n_chars", "own", "next_keys", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("edited")).alias("new"))
    out = out.select("*", sketch(F.col("own"), F.lit(CELLS), 0).alias("own_cells"), sketch(F.col("new"), F.lit(CELLS), 0).alias("new_cells"))
    near_edited = likeness(F.col("own"), F.col("new"), (F.col("own_cells"), F.col("new_cells")))
    near_next = likeness(F.col("own"), F.col("next_keys"))
    return out.select("doc_id", "n_chars", "edited_sha256", written(F.col("own_cells")).alias("fingerprint"), written(F.col("new_cells")).alias("edited_fingerprint"), near_edited.alias("near_edited"), near_next.alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
