"""Operator 3: near-duplicates by bottom-k sketches from one hash function.

Each text's set of word shingles is hashed once; its sketch is the K smallest hashes. Texts of equal sets are one class,
whose smallest doc_id stands for it. Inverted lists of the retained values give pairs that share values; the sketch of
the union, made from two sketches, estimates their likeness and filters; the rest are compared on their full sets.

No link is lost. A pair at the threshold shares SHARE of the K values but for a chance of about 1e-6 (and less for any
likelier pair), so it shares one of the rarest values of each, 1 - SHARE of all (prefix filtering); only those are
listed. In a list, members are first compared with a leader, the one of most shared values; only members in other
components than the leader's are compared further. Members of lists that stay long are listed anew by their whole
sets, where three quarters must be shared. So a group of n copies costs a few times n comparisons, not n * n.

Defined cases: texts without words, null or empty, have no shingles and link with nothing; fewer words than a shingle
has make one shingle; rows of one doc_id are one document; a null doc_id never names a component (a component of only such rows
has component_id null, and each of its rows is kept); repeated rows of a kept document are all kept. An empty table gives no rows. Only the named columns are read. doc_id lies below 2^62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_array, bit_of, has_bit, materialise, slices, table, text_buffers, tidy
from .components import components
from .shingles import set_print, shingle_sets

#: Retained values of a sketch; the least share of them that a linked pair has in common.
K, SHARE = 64, 0.47
#: Linked from 75 in 100.
PERCENT = 75
#: Members of longer lists are listed anew by their whole sets before they are compared with each other.
LONG = 32
NAMELESS = 1 << 62
#: Bits of the map of documents whose sets are needed; 4 MB, whatever the corpus.
MAP_BITS = 1 << 25


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as signed numbers of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, print (128 bits of the set) and sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1024, 500_000):
                sets = shingle_sets(*text_buffers(part.column(1)))
                low = [signed(x[:k]) for x in sets]
                offs = pa.array(np.cumsum([0, *map(len, low)]), pa.int32())
                sketch = pa.ListArray.from_arrays(offs, pa.array(np.concatenate(low) if low else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_print(x) for x in sets], pa.binary()), sketch], names=["doc_id", "n_shingles", "print", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidy(run), "doc_id long, n_shingles long, print binary, sketch array<long>")


def rid(doc_id: str = "doc_id") -> Column:
    """The number of a class: its smallest doc_id, or one above NAMELESS made from its print."""
    return F.coalesce(F.col(doc_id), F.xxhash64("print").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS))


def inverted_lists(postings: DataFrame, share: float) -> DataFrame:
    """postings: value, rid, n, s (values of that rid). Returns value, rid, n, weight, left.

    Listed are, for each class, those of its rarest values that must meet any partner's (which has `share` of them at
    least) and that some other class has too. If postings have whole sets, left is the number of values from this one on.
    """
    shared = postings.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    rows = postings.join(shared, "value").select("rid", "n", "s", F.struct("f", "value").alias("x"))
    # sorted by rarity, those that no other class has would come first
    per = rows.groupBy("rid", "n", "s").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    allowed = F.col("s") - F.greatest(F.lit(1), F.ceil(F.col("s") * share)) + 1 - (F.col("s") - F.size("xs"))
    weight = F.aggregate("xs", F.lit(0.0), lambda w, x: w + x["f"]).alias("weight")  # large for the middle of a group
    listed = per.where(allowed > 0).select("rid", "n", weight, (F.col("s") - F.size("xs")).alias("before"), F.posexplode(F.slice("xs", 1, allowed.cast("int"))).alias("at", "x"))
    return listed.select(F.col("x.value").alias("value"), "rid", "n", "weight", (F.col("n") - F.col("before") - F.col("at")).alias("left"))


def like_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def labelled(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("label", F.col("rid"))
    return lists.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("label", F.coalesce("root", "rid")).drop("root")


def open_members(lists: DataFrame) -> DataFrame:
    """The rows of lists of more than one component, and the length of each such list."""
    sizes = lists.groupBy("value").agg(F.count("*").alias("long"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("value", "long")
    return lists.join(sizes, "value")


def set_postings(sets: DataFrame, members: DataFrame) -> DataFrame:
    """value, rid, n, s for the whole sets of the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.full(len(v), i)), pa.array(np.full(len(v), len(v)))], names=["value", "rid", "n"])

    return sets.join(members, "rid", "left_semi").select("rid", "hashes").mapInArrow(tidy(run), "value long, rid long, n long").withColumn("s", F.col("n"))


def open_lists(lists: DataFrame) -> DataFrame:
    """Each list of more than one component, with a leader: the member of most shared values."""
    best = F.max(F.struct("weight", (-F.col("rid")).alias("minus"), F.col("rid"), F.col("n"), F.col("label"))).alias("leader")
    return lists.groupBy("value").agg(best, F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("value", "leader")


def star_pairs(lists: DataFrame) -> DataFrame:
    """a (leader), b: members of other components than their list's leader."""
    met = lists.join(open_lists(lists), "value").where(F.col("label") != F.col("leader.label"))
    return met.where(like_sizes("n", "leader.n")).select(F.col("leader.rid").alias("a"), F.col("rid").alias("b")).distinct()


def other_pairs(rows: DataFrame, whole: bool = False) -> DataFrame:
    """a, b: members of the same of these lists in different components; sizes meet by buckets of the ratio that a link allows.

    whole: of whole sets. There the first common value, in order of rarity, leaves enough values after it for a link.
    """
    enough = F.least("aleft", "bleft") * (100 + PERCENT) >= PERCENT * (F.col("an") + F.col("bn")) if whole else F.lit(True)
    bucket = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int")
    left = rows.select("value", F.col("rid").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("left").alias("aleft"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    right = rows.select("value", F.col("rid").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"), F.col("left").alias("bleft"), bucket.alias("bucket"))
    return left.join(right, ["value", "bucket"]).where((F.col("a") < F.col("b")) & (F.col("al") != F.col("bl")) & like_sizes("an", "bn") & enough).select("a", "b").distinct()


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """rid and full set (sorted hashes) of the members, from one more pass over the texts.

    A bit map of fixed size tells which documents to hash again, so that texts needn't be shuffled.
    """
    held = bit_array(members, "rid", MAP_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at = np.asarray(batch.column(2))
            some = batch.filter(pa.array(has_bit(bits, at) | batch.column(0).is_null().to_numpy(zero_copy_only=False)))
            for part in slices(some, 1, 1024, 500_000):
                sets = shingle_sets(*text_buffers(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_print(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "print", "hashes"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), bit_of(F.col("doc_id").cast("long"), MAP_BITS)).mapInArrow(tidy(run), "doc_id long, print binary, hashes binary")
    return found.select(rid().alias("rid"), "hashes").join(members, "rid", "left_semi")


def likely(x: np.ndarray, y: np.ndarray, k: int = K) -> bool:
    """Whether the sketch of the union has the share of common values that a link needs."""
    x, y = x[:k], y[:k]
    union = np.union1d(x, y)[:k]
    common = np.intersect1d(x, y, assume_unique=True)
    return np.isin(union, common, assume_unique=True).sum() >= np.ceil(len(union) * SHARE)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two whole sets, sorted, are alike enough."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are linked: their sketches, the first values of their sets, tell which aren't; whole sets decide on the rest."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("hashes").alias("h" + x))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True))
            yield batch.select([0, 1]).filter(pa.array([likely(x, y) and linked(x, y) for x, y in sides], pa.bool_()))

    return met.mapInArrow(tidy(run), "a long, b long")


class Links:
    """Verified links so far, as the components they make."""

    def __init__(self, sets: DataFrame):
        self.sets, self.roots = sets, None

    def add(self, pairs: DataFrame) -> None:
        found = materialise(verified(pairs, self.sets), "near-edges")
        if not found.isEmpty():
            known = found if self.roots is None else found.unionByName(self.roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
            self.roots = materialise(components(known, "near-components"), "near-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    rows = materialise(sketches(docs), "near-rows")
    groups = rows.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialise(groups.select("print", "copies", rid("first").alias("rid"), "n", "sketch"), "near-classes")
    postings = classes.select("rid", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    lists = materialise(inverted_lists(postings, SHARE), "near-lists")
    sets = materialise(full_sets(docs, lists.select("rid").distinct()), "near-sets")
    links = Links(sets)
    links.add(star_pairs(labelled(lists, links.roots)))
    rest = materialise(open_members(labelled(lists, links.roots)), "near-open")
    pairs = other_pairs(rest.where(F.col("long") <= LONG))
    # members of long lists: their whole sets tell what must be shared more narrowly than sketches can
    many = rest.where(F.col("long") > LONG).select("rid").distinct()
    if many.isEmpty():
        links.add(pairs)
    else:
        lists = materialise(inverted_lists(set_postings(sets, many), PERCENT / 100), "near-long")
        links.add(pairs.unionByName(star_pairs(labelled(lists, links.roots))))
        links.add(other_pairs(open_members(labelled(lists, links.roots)), whole=True))
    roots = links.roots
    copies = classes.where("copies > 1").select("print", "rid")
    out = rows.drop("sketch").join(copies, "print", "left").withColumn("rid", F.when(F.col("n_shingles") > 0, F.coalesce("rid", rid())))
    if roots is not None:
        out = out.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("rid", F.coalesce("root", "rid"))
    component = F.when(F.col("rid").isNull(), F.col("doc_id")).when(F.col("rid") < NAMELESS, F.col("rid"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document of smallest doc_id stays."""
    keep = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
