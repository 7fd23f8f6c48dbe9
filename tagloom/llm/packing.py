"""Operator 7: packing of token sequences by cutting-stock column generation.

A text's ids and the end id are cut into full sequences; what is left of each text is an item of 1 to 1023 ids. The
histogram of their lengths is a cutting-stock problem: its linear program is solved by column generation, each new
pattern priced by a knapsack's dynamic program over the duals. The counts of its full patterns are rounded down; what that
leaves is filled by full patterns of a bounded knapsack, longest items first. Items are ranked within their length and
the ranks dealt to the patterns' places, which is arithmetic on a table of bounded size.

Items that fill no sequence exactly (more long ones than there are partners for) are laid end to end in a stream that is
cut at sequence ends, the last part at powers of two. So no sequence is padded.

What the driver holds is bounded by the sequence length: a histogram of 1023 lengths, a basis of as many patterns.

Defined cases: null and empty texts are the end id alone; rows are packed as they stand, so repeated rows are packed
repeatedly; an empty table gives no pieces; only the named columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import materialise, slices, table, tidy

LENGTH = 1024
END_ID = 0
#: The linear program is solved to this share of its value, or stops after so many columns: a bound on the driver's time.
#: No item is lost by that: exhaust() fills sequences with whatever its rounded patterns leave.
GAP, COLUMNS = 0.03, 600
#: Fixed value: how byte-level vocabularies of this family split texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with longer pieces go to the library whose time isn't quadratic in a piece.
LONG_PIECE = re.compile(r"\S{500}|\s{500}")


class Ids:
    """Ids of texts by a byte-level BPE vocabulary."""

    def __init__(self, spec: str):
        import tiktoken

        data = json.loads(spec)
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes([byte_of[c] for c in t]): i for t, i in data["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spec, self.full = spec, None
        self.special = [t["content"] for t in data.get("added_tokens", [])]
        self.kind = np.dtype(id_kind(data))

    def slow(self):
        """The library itself, made when first needed."""
        if self.full is None:
            import tokenizers

            self.full = tokenizers.Tokenizer.from_str(self.spec)
            self.full.no_truncation()
            self.full.no_padding()
        return self.full

    def of(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or LONG_PIECE.search(text):
            return self.slow().encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def id_kind(data: dict) -> str:
    """Type in which ids of a vocabulary are kept between the steps."""
    return "<u2" if max([*data["model"]["vocab"].values(), *(t["id"] for t in data.get("added_tokens", []))]) < 1 << 16 else "<u4"


_IDS: dict[int, Ids] = {}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, vocabulary: str, key: str, text: str) -> DataFrame:
    """A row for each text: key, block and row (its place), doc_tokens, crcs of its full sequences and their rank in the block, and its rest: length, rank among the rests of that length in the block, crc, ids."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hash(spec.value)
        ids_of = _IDS[h] if h in _IDS else _IDS.setdefault(h, Ids(spec.value))
        block, ranks, row, full = TaskContext.get().partitionId(), Counter(), 0, 0
        for batch in batches:
            for part in slices(batch, 1, 256, 500_000):
                out = []
                for t in part.column(1).to_pylist():
                    ids = np.array([*ids_of.of(t or ""), END_ID], np.uint32)
                    n = len(ids) // LENGTH
                    rest = ids[n * LENGTH :]
                    out.append((block, row, len(ids), [crc(ids[i * LENGTH : (i + 1) * LENGTH]) for i in range(n)], full, len(rest), ranks[len(rest)], crc(rest), rest.astype(ids_of.kind).tobytes()))
                    row, full = row + 1, full + n
                    ranks[len(rest)] += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["key", "block", "row", "doc_tokens", "crcs", "full_rank", "rest", "rest_rank", "rest_crc", "rest_ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(tidy(run), f"key {kind}, block int, row long, doc_tokens long, crcs array<long>, full_rank long, rest int, rest_rank long, rest_crc long, rest_ids binary")


class Knapsack:
    """Most valuable fillings of every room up to `room`; prices[l]: of an item of length l (index 0 unused)."""

    def __init__(self, prices: np.ndarray, room: int):
        self.prices, best, last = prices, np.zeros(room + 1), np.zeros(room + 1, int)
        for c in range(1, room + 1):
            top = min(c, len(prices) - 1)
            value = best[c - top : c][::-1] + prices[1 : top + 1]
            k = int(value.argmax())
            if value[k] > best[c - 1] + 1e-12:
                best[c], last[c] = value[k], k + 1
            else:
                best[c] = best[c - 1]
        self.best, self.last, self.room = best, last, room

    def filling(self, room: int) -> Counter:
        found = Counter()
        while room > 0:
            k = int(self.last[room])
            if k:
                found[k] += 1
            room -= k or 1
        return found


def generate_columns(counts: dict[int, int], room: int = LENGTH, gap: float = GAP) -> list[tuple[Counter, float]]:
    """Patterns (copies of each length) and how often to use them: the linear program's solution up to `gap`."""
    lengths = sorted(k for k, n in counts.items() if n)
    if not lengths:
        return []
    at = {k: i for i, k in enumerate(lengths)}
    need = np.array([counts[k] for k in lengths], float)
    # a basis to begin with: pairs that fill a sequence where there are enough of the shorter, else copies of one length
    basis = []
    for k in lengths:
        other = room - k
        basis.append(Counter({k: 1, other: 1}) if k > room // 2 and counts.get(other, 0) >= counts[k] and other in at else Counter({k: room // k}))
    # its matrix has the diagonal and one more entry for each pair, whose row has no other pair in its own column: the inverse is closed.
    # No linear-algebra library is called here: its threads can stop for good in a process that holds a session.
    diagonal = np.array([p[k] for k, p in zip(lengths, basis, strict=True)], float)
    inverse, x = np.diag(1 / diagonal), need / diagonal
    for j, p in enumerate(basis):
        if len(p) == 2:
            i = at[room - lengths[j]]
            inverse[i, j] = -1 / diagonal[i]
            x[i] -= need[j] / diagonal[i]
    least = sum(k * n for k, n in counts.items()) / room
    # rounding loses a part of a sequence for each length: no use in a closer solution than a small share of that
    slack = 0.02 * len(lengths)
    duals = inverse.sum(0)
    for _ in range(COLUMNS):
        if x.sum() <= least * (1 + gap) + slack:
            break
        prices = np.zeros(room + 1)
        prices[lengths] = np.maximum(duals, 0)
        sack = Knapsack(prices, room)
        value = float(sack.best[room])
        if value <= 1 + 1e-9 or x.sum() / value >= x.sum() * (1 - gap) - slack:
            break
        pattern = sack.filling(room)
        rows, copies = [at[k] for k in pattern], np.array([*pattern.values()], float)
        step = (inverse[:, rows] * copies).sum(1)
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        row = inverse[out] / step[out]
        duals = duals + (1 - (duals[rows] * copies).sum()) * row
        inverse -= np.outer(step, row)
        inverse[out] = row
        x = np.maximum(x - step * ratio[out], 0)
        x[out] = ratio[out]
        basis[out] = pattern
    return [(p, float(v)) for p, v in zip(basis, x, strict=True) if v > 0]


@dataclass
class Plan:
    """Where items go. places: (length, from rank, to rank, copies, first sequence or -1, first offset, stride).

    With a sequence: item t of the places, t = copies * i + j, lies in sequence first + i at offset + length * j. Without:
    it lies in the stream at offset + stride * i + length * j.
    """

    places: list[tuple[int, int, int, int, int, int, int]]
    patterns: int  # sequences filled by patterns
    stream: int  # ids in the stream


def exact_filling(counts: dict[int, int], room: int) -> Counter | None:
    """Items of the given counts that fill the room to the last id, rather long ones than short ones; None if none do.

    The knapsack's dynamic program with bounded copies, over sums as the bits of a number.
    """
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for k in sorted((k for k, n in counts.items() if n > 0 and k <= room), reverse=True):
        for _ in range(min(counts[k], room // k)):
            more = (reach | reach << k) & full
            if more == reach:
                break
            steps.append((reach, k))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    if not reach >> room & 1:
        return None
    found = Counter()
    for before, k in reversed(steps):
        if not before >> room & 1:
            found[k] += 1
            room -= k
    return found


def exhaust(counts: dict[int, int], room: int = LENGTH) -> list[tuple[Counter, int]]:
    """Full patterns for what the rounded program leaves, longest items first, each as often as there are items for it.

    Every pattern uses up the items of one of its lengths, so there are about as many patterns as lengths.
    """
    left, out = Counter({k: n for k, n in counts.items() if n > 0}), []
    for k in sorted(left, reverse=True):
        while left[k] > 0:
            left[k] -= 1
            found = exact_filling(left, room - k)
            left[k] += 1
            if found is None:
                break  # no partners: these go to the stream
            found[k] += 1
            n = min(left[v] // m for v, m in found.items())
            for v, m in found.items():
                left[v] -= n * m
            out.append((found, n))
    return out


def plan(counts: dict[int, int]) -> Plan:
    """Full patterns of the linear program, rounded down; full patterns for the rest; the stream for what fits nowhere."""
    places, used, sequence, stream = [], Counter(), 0, 0

    def place(pattern: Counter, n: int) -> None:
        nonlocal sequence
        at = 0
        for k, m in sorted(pattern.items(), reverse=True):
            places.append((k, used[k], used[k] + n * m, m, sequence, at, LENGTH))
            used[k] += n * m
            at += k * m
        sequence += n

    for pattern, often in generate_columns(counts):
        if sum(k * m for k, m in pattern.items()) == LENGTH:
            n = min([int(often + 1e-6), *((counts[k] - used[k]) // m for k, m in pattern.items() if m)])
            if n > 0:
                place(pattern, n)
    for pattern, n in exhaust({k: n - used[k] for k, n in counts.items()}):
        place(pattern, n)
    for k, n in sorted(counts.items(), reverse=True):
        if used[k] < n:
            places.append((k, used[k], n, 1, -1, stream, k))
            stream += k * (n - used[k])
    return Plan(places, sequence, stream)


def stream_pieces(at: int, length: int, total: int) -> list[tuple[int, int, int, int]]:
    """(from, length, sequence, offset) of the pieces of an item at a place of the stream; the stream's last part is cut at powers of two."""
    whole, out, begin = total // LENGTH, [], at
    while begin < at + length:
        q = begin // LENGTH
        if q < whole:
            first, end, seq = q * LENGTH, (q + 1) * LENGTH, q
        else:
            first, seq, left = whole * LENGTH, whole, total - whole * LENGTH
            size = 1 << (left.bit_length() - 1)
            while begin >= first + size:
                first, seq, left = first + size, seq + 1, left - size
                size = 1 << (left.bit_length() - 1)
            end = first + size
        stop = min(end, at + length)
        out.append((begin - at, stop - begin, seq, begin - first))
        begin = stop
    return out


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        kind = id_kind(json.load(f))
    rows = materialise(tokenised(docs, vocabulary, key, text), "packing-rows")
    # items of each length, and full sequences (as length 0), in the blocks before
    by_block = rows.where("rest > 0").groupBy("rest", "block").agg(F.count("*").alias("n")).unionByName(rows.groupBy("block").agg(F.sum(F.size("crcs")).alias("n")).select(F.lit(0).alias("rest"), "block", "n"))
    before = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(by_block.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-bases")
    counts = {r.rest: r.n for r in bases.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # LENGTH rows at most
    counts.pop(0, None)
    p = plan(counts)
    left = p.stream % LENGTH
    first_full = p.patterns + p.stream // LENGTH + bin(left).count("1")

    full_base = bases.where("rest = 0").select("block", "base")
    full = rows.where(F.size("crcs") > 0).select("key", "block", "doc_tokens", "full_rank", F.posexplode("crcs").alias("i", "ids_crc32")).join(full_base, "block")
    full = full.select("key", (F.col("i") * F.lit(LENGTH)).cast("long").alias("start"), F.lit(LENGTH).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(first_full) + F.col("base") + F.col("full_rank") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    schema = "rest int, lo long, hi long, copies long, first long, at long, stride long"
    places = F.broadcast(spark.createDataFrame(p.places, schema))  # as many rows as the patterns have lengths: bounded by LENGTH
    items = rows.where("rest > 0").select("key", "block", "row", "doc_tokens", "rest", "rest_rank", "rest_crc").join(bases.where("rest > 0").select("block", "rest", "base"), ["block", "rest"])
    items = items.withColumn("rank", F.col("base") + F.col("rest_rank")).join(places, "rest").where("rank >= lo AND rank < hi")
    t = F.col("rank") - F.col("lo")
    instance, within = F.floor(t / F.col("copies")), F.col("at") + F.pmod(t, F.col("copies")) * F.col("rest")
    items = items.withColumns({"instance": instance, "within": within})
    start = (F.col("doc_tokens") - F.col("rest")).alias("start")
    whole = items.where("first >= 0").select("key", start, F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("instance")).cast("long").alias("sequence_id"), F.col("within").cast("long").alias("offset"))
    streamed = items.where("first < 0").select("block", "row", (F.col("within") + F.col("instance") * F.col("stride")).cast("long").alias("place"))
    streamed = rows.select("key", "block", "row", "doc_tokens", "rest", "rest_ids").join(streamed, ["block", "row"]).select("key", "doc_tokens", "rest", "rest_ids", "place")
    total, first_stream = p.stream, p.patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for k, n, rest, raw, place in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(raw, kind)
                for a, size, seq, off in stream_pieces(place, rest, total):
                    for c, v in zip(cols, (k, n - rest + a, size, crc(ids[a : a + size]), n, first_stream + seq, off), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    type_ = docs.schema[key].dataType.simpleString()
    cut = streamed.mapInArrow(tidy(run), f"key {type_}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(whole).unionByName(cut).withColumnRenamed("key", key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: what is kept, in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
