"""Operator 11: alignment of two tokenizers' tokens by galloping intersection of their end offsets.

Every text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). Both cover the same bytes, so each is
an ascending list of end offsets. The shorter list drives: each of its ends is looked for in the longer by exponential
steps from where its predecessors stopped, then by halving; in numpy, all ends of a part take their steps at once. A
driver's end that is found cuts both lists into groups. The rank of an end is the number of smaller ends in the longer
list, so the differences of neighbouring ranks are the ranges of tokens that a driver's token overlaps: its links.

Texts are worked through in blocks. A block keeps its distinct id pairs with their counts, and of each text the pairs'
numbers in that list, as variable-length integers. Pair counts are summed up over blocks, the highest of each B id is
found, and both come back to the blocks that asked: what is shuffled is distinct pairs a block, never links.

Defined cases: null and empty texts, and texts whose joined bytes of A or B aren't a space and the text, have no tokens:
zeros and an empty digest; they add nothing to the counts. Repeated rows count as often as they stand there; null keys
stay; an empty table gives no rows; only the named columns are read. A text longer than a block is a block by itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import materialise, slices, table, tidy
from .packing import LONG_PIECE, Ids

#: Rows and bytes of text of a block.
ROWS, BYTES = 4096, 2_000_000
#: Ends that start from one rank when they look for theirs.
STRIDE = 32
#: B ids in a pair's number.
SHIFT = 1 << 24


def ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The number of elements of `long` below each of `short`; both ascending.

    Every STRIDE-th element is placed first, by the same search; the others gallop from its rank.
    """
    n, m = len(short), len(long)
    low = np.zeros(n, np.int64) if n <= STRIDE else np.repeat(ranks(short[::STRIDE], long), STRIDE)[:n]
    high = np.full(n, m, np.int64)
    going, step = np.arange(n), 1
    while len(going):  # exponential: low only passes smaller elements
        probe = low[going] + step - 1
        inside = probe < m
        below = inside & (long[np.minimum(probe, m - 1)] < short[going])
        stop = going[~below & inside]
        high[stop] = probe[~below & inside]
        low[going[below]] = probe[below] + 1
        going, step = going[below], 2 * step
    going = np.flatnonzero(low < high)
    while len(going):  # binary
        middle = (low[going] + high[going]) >> 1
        below = long[middle] < short[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


@dataclass
class Aligned:
    """Links (numbers of an A and of a B token) in order, and whether each A and B token ends a group."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Tokens of texts that lie end to end, by their ends; both lists have the same last end."""
    turned = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if turned else (ends_a, ends_b)
    if not len(short):
        none = np.zeros(0, np.int64)
        return Aligned(none, none, none.astype(bool), none.astype(bool))
    rank = ranks(short, long)
    met = long[np.minimum(rank, len(long) - 1)] == short
    first = np.concatenate([[0], rank[:-1] + met[:-1]])
    n = rank - first + 1
    driver = np.repeat(np.arange(len(short)), n)
    other = np.arange(len(driver)) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    cut = np.zeros(len(long), bool)
    cut[rank[met]] = True
    return Aligned(other, driver, cut, met) if turned else Aligned(driver, other, met, cut)


class Digits:
    """Decimal ids with a byte behind each, as rows of bytes."""

    def __init__(self, most: int):
        self.width = len(str(most)) + 1
        self.table = np.zeros((most + 1, self.width), np.uint8)
        self.size = np.zeros(most + 1, np.int64)
        for i in range(most + 1):
            s = str(i).encode()
            self.table[i, : len(s)] = np.frombuffer(s, np.uint8)
            self.size[i] = len(s)


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, digits: Digits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of "a1,a2|b1;..." of all groups, and where each A and each B token's part ends in them."""
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    upto_a, upto_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    at_a = np.arange(len(ids_a)) + np.concatenate([[0], upto_b])[group_a]
    at_b = np.arange(len(ids_b)) + upto_a[group_b]
    n = len(ids_a) + len(ids_b)
    ids, behind = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    behind[at_a[cut_a]], behind[at_b[cut_b]] = ord("|"), ord(";")
    rows, size = digits.table[ids], digits.size[ids]
    rows[np.arange(n), size] = behind
    ends = np.cumsum(size + 1)
    return rows[np.arange(digits.width) <= size[:, None]], ends[at_a], ends[at_b]


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of 7 bits, lowest first, and the number of bytes of each."""
    x = x.astype(np.uint64)
    parts, n = [], np.ones(len(x), np.int64)
    for k in range(10):
        rest = x >> np.uint64(7 * k)
        if k and not rest.any():
            break
        n[rest > 0] = k + 1
        parts.append((rest & np.uint64(127)).astype(np.uint8))
    rows = np.stack(parts, 1) if len(x) else np.zeros((0, 1), np.uint8)
    rows[np.arange(rows.shape[1]) < n[:, None] - 1] |= 128
    return rows[np.arange(rows.shape[1]) < n[:, None]], n


def from_varints(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(raw) else np.zeros(0, np.int64)


class Vocabularies:
    """Both encoders, with the bytes of their tokens."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece

        self.ids = Ids(spec)
        self.library = None
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        vocab = json.loads(spec)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of.get(c, 63) for c in t)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.pieces
        self.bytes_b = [bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace("▁", " ").encode() for i, t in ((i, p.id_to_piece(i)) for i in range(p.get_piece_size()))]
        self.size_a, self.size_b = (np.array([len(x) for x in xs]) for xs in (self.bytes_a, self.bytes_b))
        self.digits = Digits(max(len(self.bytes_a), len(self.bytes_b)))

    def encode_a(self, text: str) -> list[int]:
        if not LONG_PIECE.search(text):
            return self.ids.fast.encode_ordinary(text)
        if self.library is None:
            self.library = self.ids.slow()
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, or none of either."""
        none = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if not text:
            return none
        whole = (" " + text).encode()
        a, b = self.encode_a(" " + text), self.pieces.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return none
        return np.array(a, np.int32), np.array(b, np.int32)


_KNOWN: dict[int, Vocabularies] = {}


def block_of(texts: list[str | None], v: Vocabularies) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Columns of a block's texts (n_a, n_b, n_groups, n_links, groups_sha256, pairs), its distinct pairs and their counts."""
    coded = [v.encode(t) for t in texts]
    n_a, n_b = (np.array([len(c[i]) for c in coded], np.int64) for i in (0, 1))
    ids_a, ids_b = (np.concatenate([c[i] for c in coded] or [np.zeros(0, np.int32)]) for i in (0, 1))
    del coded
    x = align(np.cumsum(v.size_a[ids_a]), np.cumsum(v.size_b[ids_b]))
    pair = ids_a[x.a].astype(np.int64) * SHIFT + ids_b[x.b]
    code, distinct = pd.factorize(pair)
    counts = np.bincount(code, minlength=len(distinct))
    text_of = np.repeat(np.arange(len(texts)), n_a)
    n_links = np.bincount(text_of[x.a], minlength=len(texts))
    n_groups = np.bincount(text_of[x.cut_a], minlength=len(texts))
    said, _, ends_b = spelled(ids_a, ids_b, x.cut_a, x.cut_b, v.digits)
    said = said.tobytes()
    upto = np.concatenate([[0], ends_b])[np.concatenate([[0], np.cumsum(n_b)])]
    hashes = [hashlib.sha256(said[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
    # of each text: steps between its distinct pairs' numbers, and how often each stands there
    both, often = np.unique(text_of[x.a] * max(len(distinct), 1) + code, return_counts=True)
    owner, number = np.divmod(both, max(len(distinct), 1))
    new = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]
    step = np.where(new, number, np.diff(number, prepend=0))
    raw, width = varints(np.stack([step, often], 1).ravel())
    at = np.concatenate([[0], np.cumsum(width)])[2 * np.searchsorted(owner, np.arange(len(texts) + 1))]
    raw = raw.tobytes()
    pairs = [raw[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes, "pairs": pairs}, distinct, counts


def summed(pairs: list[bytes], total: np.ndarray, best: np.ndarray) -> tuple[list[int], list[int]]:
    """n_best and count_sum of each text of a block; total, best: of the block's pairs, by number."""
    n_best, count_sum = [], []
    for raw in pairs:
        x = from_varints(np.frombuffer(raw, np.uint8))
        number, often = np.cumsum(x[::2]), x[1::2]
        n_best.append(int(often[best[number]].sum()))
        count_sum.append(int((often * total[number]).sum()))
    return n_best, count_sum


def aligned(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text: key, block, n_a, n_b, n_groups, n_links, groups_sha256, pairs (see block_of); the first of a block also has the block's distinct pairs and counts.

    vocabulary, model: paths of the files on the driver, sent once to each executor.
    """
    with open(vocabulary, encoding="utf-8") as f, open(model, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # the vocabularies: a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hash(sent.value)
        v = _KNOWN[h] if h in _KNOWN else _KNOWN.setdefault(h, Vocabularies(*sent.value))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, ROWS, BYTES):
                cols, distinct, counts = block_of(part.column(1).to_pylist(), v)
                more = [None] * (part.num_rows - 1)
                arrays = [part.column(0), pa.array([block] * part.num_rows, pa.int64()), *(pa.array(x) for x in cols.values())]
                arrays += [pa.array([x.tolist(), *more], pa.list_(pa.int64())) for x in (distinct, counts)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "block", *cols, "distinct", "counts"])
                block += 1

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, distinct array<long>, counts array<long>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(tidy(run), schema)


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, number, pair) of the blocks' distinct pairs, and pair, a_id, b_id, links and best of all pairs of the corpus."""
    asked = rows.where("distinct IS NOT NULL").select("block", F.posexplode(F.arrays_zip("distinct", "counts")).alias("number", "p")).select("block", "number", F.col("p.distinct").alias("pair"), F.col("p.counts").alias("n"))
    totals = materialise(asked.groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b_id", F.pmod("pair", F.lit(SHIFT))), "alignment-pairs")
    most = totals.groupBy("b_id").agg(F.max("links").alias("most"))
    known = totals.join(most, "b_id").select("pair", F.floor(F.col("pair") / SHIFT).alias("a_id"), "b_id", "links", (F.col("links") == F.col("most")).alias("best"))
    return asked.drop("n"), known


def align_tokens(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    rows = materialise(aligned(docs, vocabulary, model, key, text), "alignment-texts")
    asked, known = pair_counts(rows)
    told = asked.join(known.select("pair", "links", "best"), "pair").select(F.col("block").alias("asked_by"), "number", "links", "best")
    out = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(texts: pa.Table, stats: pa.Table) -> pa.Table:
        total, best = np.zeros(stats.num_rows, np.int64), np.zeros(stats.num_rows, bool)
        number = stats["number"].to_numpy()
        total[number], best[number] = stats["links"].to_numpy(), stats["best"].to_numpy()
        n_best, count_sum = summed(texts["pairs"].to_pylist(), total, best)
        return texts.drop_columns(["block", "pairs"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).select(out)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.drop("distinct", "counts").groupBy("block").cogroup(told.groupBy("asked_by")).applyInArrow(finish, schema).withColumnRenamed("key", key)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the byte-level and the piece vocabulary."""
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
