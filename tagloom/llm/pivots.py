"""Operator 4: exact top-k by inner product, with elimination by a table of distances to pivots.

Every vector is stored with its distances to a fixed number of pivots. For a query, the largest difference of
distances to a pivot is a lower bound of its distance to a candidate, and with the norms an upper bound of their inner
product. Candidates are evaluated in the order of the bound until the k-th score exceeds the bound of all the rest.

Queries and candidates meet in blocks of bounded size: each cell of the grid of query blocks and candidate blocks is
one row, so no task holds more than two blocks, and each cell returns k rows a query at most.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; rows
whose id is the query's are no candidates of it; repeated candidate rows count each; repeated query rows count once; only
vectors of equal length meet. Scores are exact integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialise, table

PIVOTS, PIVOT_SAMPLE = 24, 1000
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
#: Above this a float64 no longer holds every inner product; Python's integers do the rest.
EXACT = 1 << 52


def scaled(component: Column) -> Column:
    return F.floor(256 * component.cast("double")).cast("long")


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, scaled).alias("v"))


def choose_pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each length of vector: far-apart members of a bounded sample, each farthest from those before it."""
    by_size: dict[int, list] = {}
    for row in bounded_sample(vectors, "vec_id", PIVOT_SAMPLE).collect():  # PIVOT_SAMPLE vectors at most
        by_size.setdefault(len(row.v), []).append(row.v)
    out = {}
    for size, rows in by_size.items():
        m = np.array(rows, float).reshape(len(rows), size)
        picked, far = [0], np.full(len(m), np.inf)
        while len(picked) < min(n, len(m)):
            far = np.minimum(far, np.linalg.norm(m - m[picked[-1]], axis=1))
            picked.append(int(far.argmax()))
        out[size] = m[picked]
    return out


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray], rows: int) -> DataFrame:
    """Blocks of at most `rows` vectors of one length: ids, components and distances to the pivots, as arrays' bytes."""

    def block(size: int, ids: list, vs: list) -> dict:
        m = np.array(vs, np.int64).reshape(len(vs), size)
        p = pivots.get(size, np.zeros((0, size)))
        d = np.stack([np.linalg.norm(m - x, axis=1) for x in p], 1) if len(p) else np.zeros((len(m), 0))
        return {"size": size, "block": uuid.uuid4().hex, "n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "vectors": m.tobytes(), "distances": d.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[list, list]] = {}
        schema = pa.schema([("size", pa.int32()), ("block", pa.string()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("distances", pa.binary())])
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vs = open_blocks.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) == rows:
                    yield pa.RecordBatch.from_pylist([block(len(v), *open_blocks.pop(len(v)))], schema)
        for size, (ids, vs) in open_blocks.items():
            yield pa.RecordBatch.from_pylist([block(size, ids, vs)], schema)

    return vectors.mapInArrow(run, "size int, block string, n int, ids binary, vectors binary, distances binary")


def search_cell(q_ids, q, q_dist, c_ids, c, c_dist, k: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(query's row, rank, candidate's id, score) of the k best of one block for each query of another; pairs evaluated."""
    big = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    exact = int(big) ** 2 * max(1, q.shape[1]) < EXACT
    qf, cf = (q.astype(float), c.astype(float)) if exact else (q.astype(object), c.astype(object))
    q2, c2 = (q.astype(float) ** 2).sum(1), (c.astype(float) ** 2).sum(1)
    q_dist, c_dist = q_dist.astype(np.float32), np.ascontiguousarray(c_dist.T.astype(np.float32))
    out, seen = [], 0
    for i in range(len(q)):
        low = np.zeros(len(c), np.float32)
        for d, x in zip(c_dist, q_dist[i], strict=True):
            np.maximum(low, np.abs(d - x), out=low)
        low = np.maximum(low.astype(float) - 1e-6 * (low + c_dist.max(initial=0) + q_dist[i].max(initial=0)), 0)  # float32's error
        bound = (q2[i] + c2 - low * low) / 2
        bound += 1 + 1e-9 * (q2[i] + c2)
        bound[c_ids == q_ids[i]] = -np.inf
        order = np.argsort(-bound)
        best_s, best_i = np.zeros(0, cf.dtype), np.zeros(0, np.int64)
        at, step = 0, 64
        while at < len(order) and bound[order[at]] > -np.inf and (len(best_s) < k or bound[order[at]] >= best_s[-1]):
            some = order[at : at + step]
            some = some[bound[some] > -np.inf]
            at, step, seen = at + step, step * 2, seen + len(some)
            s, ids = np.concatenate([best_s, cf[some] @ qf[i]]), np.concatenate([best_i, c_ids[some]])
            keep = np.lexsort((ids, -s))[:k] if exact else np.array(sorted(range(len(s)), key=lambda j: (-s[j], ids[j]))[:k], int)
            best_s, best_i = s[keep], ids[keep]
        out += [(i, r + 1, int(best_i[r]), int(best_s[r])) for r in range(len(best_s))]
    return out, seen


def numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks with consecutive numbers; there are as many rows as blocks, and only their keys are sorted in one place."""
    keys = blocks.select("block").withColumn(name, F.row_number().over(Window.orderBy("block")) - 1)
    return blocks.join(keys, "block")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """queries, candidates: vec_id and v, as of usable(). Returns query_id, rank, vec_id, score."""
    chosen = choose_pivots(candidates, pivots)
    qs = numbered(materialise(pivot_table(queries.dropDuplicates(["vec_id", "v"]), chosen, query_block), "queries"), "qb")
    cs = numbered(materialise(pivot_table(candidates, chosen, candidate_block), "candidates"), "cb")
    n_q, n_c = qs.count(), cs.count()
    left = qs.select(F.col("size"), "qb", *(F.col(x).alias("q_" + x) for x in ("ids", "vectors", "distances")), F.explode(F.sequence(F.lit(0), F.lit(max(n_c, 1) - 1))).alias("cb"))
    right = cs.select("size", "cb", *(F.col(x).alias("c_" + x) for x in ("ids", "vectors", "distances")), F.explode(F.sequence(F.lit(0), F.lit(max(n_q, 1) - 1))).alias("qb"))
    cells = left.join(right, ["size", "qb", "cb"]).repartition(max(1, min(n_q * n_c, 20_000)), "qb", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                side = {}
                for s in "qc":
                    ids = np.frombuffer(row[s + "_ids"], np.int64)
                    side[s] = (ids, np.frombuffer(row[s + "_vectors"], np.int64).reshape(len(ids), -1) if row["size"] else np.zeros((len(ids), 0), np.int64), np.frombuffer(row[s + "_distances"]).reshape(len(ids), -1) if row[s + "_distances"] else np.zeros((len(ids), 0)))
                found, _ = search_cell(*side["q"], *side["c"], k)
                ids = side["q"][0]
                yield pa.RecordBatch.from_arrays([pa.array([f"{row['size']}-{row['qb']}-{x[0]}" for x in found], pa.string()), pa.array([int(ids[x[0]]) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())], names=["q", "query_id", "vec_id", "score"])

    best = cells.mapInArrow(run, "q string, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
