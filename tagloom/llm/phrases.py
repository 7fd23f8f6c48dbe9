"""Operator 12: phrases of words that belong together, counted by an FM-index per shard.

Texts are cut into pieces and words; a shard is the words of one language that one task meets, up to SHARD, as symbols
with a separator between pieces. Its index are the Burrows-Wheeler transforms of the sequence and of its reverse, with
suffixes ordered by their first 8 symbols, which is as deep as phrases are followed. A phrase is an interval in both;
extending it by a word to the right is a step of the reverse index, to the left one of the forward index, and the counts
of smaller symbols in the interval keep the other side in step. numpy extends all intervals of a level at once.

Counts of a level are summed up over the shards of a task and then over all. A phrase is followed only if all its parts
that are one word shorter reach the least count over the whole corpus; which do is told to shards by a bit map of bounded
size, and what a map lets through wrongly falls out by its sum. So shards write their indexes once and are read once a
level; for pairs, most of which are rare, once more before: places of hashes are counted there, and only pairs whose
place reaches the least count are counted themselves.

Scores are exact integers in 38 digits. A phrase whose extension by one word, to either side, is as frequent lies inside
a longer one and is dropped; counts only fall with length, so one word decides.

Defined cases: null and empty texts have no words; a null lang is `und`; rows count as often as they stand there; ties
in score and count go to the smaller phrase by bytes; an empty table gives no rows; only the named columns are read.
Words are told apart by 64 bits of hash with their language. Long texts are cut between pieces, where no phrase is; a
piece longer than a shard is a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import hash_of, prefix_hash
from .common import bit_array, bits_for, give_back, has_bit, materialise, maybe_in, settings, settled, slices, spent_shuffles, table, text_buffers, tidy
from .passages import spark_hash
from .shingles import LOWER, mix
from .wordids import pieces_of, row_hash, word_bounds

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a shard, about; rows and bytes that are looked at at once.
SHARD, ROWS, BYTES = 500_000, 4096, 500_000
#: Rows that a task sends at once, and that it holds to put equal ones together.
SENT, SUMMED = 100_000, 1_000_000
#: Shards are read by no more tasks than this for each core: so a task has more equal phrases to put together the more text there is.
TASKS = 4
#: A shard's row is some megabytes: readers and workers take one at a time.
SINGLE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
#: Texts come to a task in batches of so many bytes; a long text is a batch.
FED = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
#: Pages of the index hold one transform each: else all of a file are one page, which codecs take whole, outside the heap.
PAGES = {"parquet.page.size.row.check.min": "1"}
BREAK, GAP = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP[[32, 9]] = True


def order_of(seq: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """Positions of a sequence, as a ring, in the order of at least their first `depth` symbols: by doubling."""
    if not len(seq):
        return np.zeros(0, np.int64)
    rank, size = seq.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1)
        key += np.roll(rank, -size)
        order = np.argsort(key)
        size *= 2
        if size >= depth:
            return order
        key = key[order]
        rank[order] = np.concatenate([[False], key[1:] != key[:-1]]).cumsum()
        del order


def transform(seq: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, in the suffixes' order."""
    return seq[order_of(seq) - 1]


class Side:
    """A transform with its last-to-first mapping."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        order = np.sort(bwt.astype(np.int64) << 32 | np.arange(len(bwt))) & 0xFFFFFFFF
        self.first = np.empty(len(bwt), np.int64)
        self.first[order] = np.arange(len(bwt))


class Phrases:
    """Phrases of one length in a shard: words (symbols, a row each), interval starts in the forward and the reverse index, counts."""

    def __init__(self, words: np.ndarray, starts: list[np.ndarray], n: np.ndarray):
        self.words, self.starts, self.n = words, starts, n

    def take(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], [x[keep] for x in self.starts], self.n[keep])


class Index:
    """Bidirectional FM-index of a sequence of symbols from 1; 0 separates pieces."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray):
        self.sides = [Side(forward), Side(backward)]
        self.size = int(forward.max(initial=0)) + 1
        counts = np.bincount(forward, minlength=self.size)
        starts = np.cumsum(counts) - counts
        symbols = np.arange(1, self.size)
        self.words = Phrases(symbols[:, None].astype(np.int32), [starts[1:], starts[1:].copy()], counts[1:])

    def extend(self, p: Phrases, right: bool) -> Phrases:
        """All phrases with one word more on that side: a step in the index that reads it, counts of smaller words move the other."""
        side = self.sides[right]
        total = int(p.n.sum())
        begin = np.cumsum(p.n) - p.n
        owner = np.repeat(np.arange(len(p.n)), p.n)
        at = np.arange(total) + np.repeat(p.starts[right] - begin, p.n)
        bits = max(total - 1, 0).bit_length()
        key = np.sort((owner * self.size + side.bwt[at]) << bits | np.arange(total))
        group = key >> bits
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[:total])
        n = np.diff(np.append(new, total))
        of, symbol = np.divmod(group[new], self.size)
        stepped = side.first[at[key[new] & ((1 << bits) - 1)]]
        other = p.starts[not right][of] + new - begin[of]
        words = np.concatenate([p.words[of], symbol[:, None]] if right else [symbol[:, None], p.words[of]], 1).astype(np.int32)
        return Phrases(words, [other, stepped] if right else [stepped, other], n).take(np.flatnonzero(symbol > 0))


class Builder:
    """Words of one language, to be made a shard."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.known: list[tuple[np.ndarray, pa.Array]] = []
        self.n = 0

    def add(self, ids: np.ndarray, new: np.ndarray, words: tuple[np.ndarray, pa.Array]) -> None:
        """ids of words, whether each begins a piece, and the distinct ids, ascending, with their words."""
        self.parts.append((ids, new))
        self.known.append(words)
        self.n += len(ids)

    def shard(self) -> dict:
        _, first = np.unique(np.concatenate([x for x, _ in self.known]), return_index=True)
        words = pa.concat_arrays([w for _, w in self.known]).take(pa.array(first))
        ids, new = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.known = [], []  # else held twice
        vocab, counts = np.unique(ids, return_counts=True)
        at = new.cumsum()
        seq = np.zeros(len(ids) + int(at[-1]), np.int32)
        at += np.arange(-1, len(ids) - 1)
        seq[at] = np.searchsorted(vocab, ids) + 1
        del ids, new, at
        return {"n": self.n, "forward": transform(seq).tobytes(), "backward": transform(seq[::-1].copy()).tobytes(), "vocab": vocab, "counts": counts, "words": words}


def pick(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings between these places of UTF-8 data."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])


def language_words(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, pa.Array]]]:
    """For ranges of texts that lie end to end: a language's number, and what Builder.add takes. langs: of each text; seeds: of each language."""
    for a, z in pieces_of(data, BREAK):
        piece = LOWER[data[a:z]]
        inside = offsets[(offsets > a) & (offsets < z)] - a
        starts, ends = word_bounds(~(BREAK | GAP)[piece], np.concatenate([[0], inside, [z - a]]))
        if not len(starts):
            continue
        text = np.searchsorted(offsets, starts + a, "right") - 1
        sentence = np.cumsum(BREAK[piece])[starts]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1])])
        lang = langs[text]
        ids = mix(hash_of(prefix_hash(piece), starts, ends) ^ seeds[lang]).view(np.int64)
        for k in np.unique(lang).tolist():
            some = np.flatnonzero(lang == k)
            known, first = np.unique(ids[some], return_index=True)
            yield k, ids[some], new[some], (known, pick(piece, starts[some[first]], ends[some[first]]))


INDEX = "lang string, n long, forward binary, backward binary, vocab array<long>, counts array<long>, words array<string>"


def shards(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each shard: its language, number of words, both transforms, and its distinct words with their ids and counts."""

    def row(name: str, b: Builder) -> pa.RecordBatch:
        x = b.shard()
        listed = [pa.array([x["n"]], pa.int64()), pa.array([x["forward"]], pa.binary()), pa.array([x["backward"]], pa.binary())]
        listed += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.array(x["vocab"]), pa.array(x["counts"]), x["words"].cast(pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array([name]), *listed], names=["lang", "n", "forward", "backward", "vocab", "counts", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Builder] = {}
        for batch in batches:
            for part in slices(batch, 1, ROWS, BYTES):
                code = part.column(0).dictionary_encode()
                names = code.dictionary.to_pylist()
                seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in names], np.uint64)
                for k, ids, new, words in language_words(*text_buffers(part.column(1)), code.indices.to_numpy(), seeds):
                    b = open_.setdefault(names[k], Builder())
                    b.add(ids, new, words)
                    if b.n >= SHARD:
                        yield row(names[k], open_.pop(names[k]))
                        give_back()
        for name, b in open_.items():
            yield row(name, b)

    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(tidy(run), INDEX)


def columns(length: int) -> list[str]:
    return [f"w{i + 1}" for i in range(length)]


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of phrases, given as rows of ids, in a bit map."""
    return spark_hash(row_hash([np.ascontiguousarray(ids[:, i]) for i in range(ids.shape[1])])) & (bits - 1)


def fits(ids: np.ndarray, maps: dict[int, tuple[np.ndarray, int]]) -> np.ndarray:
    """Whether all parts of the longest length that maps know, of phrases given as rows of ids, may be frequent; phrases of that length are looked up themselves."""
    size = min(max(maps), ids.shape[1])
    held, bits = maps[size]
    ok = np.ones(len(ids), bool)
    for i in range(ids.shape[1] - size + 1):
        ok &= has_bit(held, places(ids[:, i : i + size], bits))
    return ok


def together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers and their counts, equal rows once. The parts are taken out of their list, as they would be held twice."""
    rows, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort(rows.T)
    rows, n = rows[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])[: len(n)])
    return rows[new], np.add.reduceat(n, new) if len(n) else n


def summed(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of numbers and their counts, equal ones put together as far as SUMMED rows go."""
    held, total = [], 0
    for x in found:
        held.append(x)
        total += len(x[1])
        if total >= SUMMED:
            held = [together(held)]
            total = len(held[0][1])
            if 2 * total > SUMMED:
                yield held[0]
                held, total = [], 0
    if held:
        yield together(held)


def counted(index: DataFrame, length: int, maps: dict[int, tuple[np.ndarray, int]], bits: int = 0) -> DataFrame:
    """w1, w2, ... and n: the phrases of a length in the shards of each task whose parts may be frequent. With bits: place (in a bit map of that size) and n."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(maps)  # 32 MB a length at most
    names, kind = ([*columns(length), "n"], "long") if not bits else (["place", "n"], "int")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                forward, backward = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int32) for k in (0, 1))
                vocab = np.concatenate([[0], batch.column(2)[i].values.to_numpy()])
                x = Index(forward, backward)
                p = x.words.take(np.flatnonzero(fits(vocab[x.words.words], sent.value)))
                for size in range(2, length + 1):
                    p = x.extend(p, right=size % 2 == 0)
                    p = p.take(np.flatnonzero(fits(vocab[p.words], sent.value)))
                found, n = vocab[p.words], p.n
                del x, p
                yield (places(found, bits).astype(np.int32)[:, None], n) if bits else (found, n)
                give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in summed(phrases(batches)):
            for at in range(0, len(n), SENT):
                some = [*rows[at : at + SENT].T, n[at : at + SENT]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int32() if bits else pa.int64()) for c in some], names=names)

    tasks = TASKS * spark.sparkContext.defaultParallelism
    return index.select("forward", "backward", "vocab").coalesce(tasks).mapInArrow(tidy(run), ", ".join(f"{c} {kind}" for c in names))


def frequent_places(index: DataFrame, length: int, maps: dict[int, tuple[np.ndarray, int]], least: int) -> tuple[np.ndarray, int]:
    """A bit map of the places that phrases of a length reach `least` times, and its size: a bit for some eight words, within 128 KB and 32 MB."""
    words = index.agg(F.sum("n")).first()[0]
    bits = 1 << min(max((words // 8).bit_length(), 20), 28)
    with settings(index.sparkSession, SINGLE):
        many = counted(index, length, maps, bits).groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return bit_array(many, "place", bits, placed=True), bits


def frequent(docs: DataFrame, text: str, lang: str, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index; lang and n (words); and words (array of ids) and n of all phrases of up to `longest` words that occur `least` times."""
    with settings(docs.sparkSession, FED):
        index = materialise(shards(docs, text, lang), "phrases-index", PAGES)
    words = index.select(F.explode(F.arrays_zip("vocab", "counts")).alias("x")).select(F.col("x.vocab").alias("w1"), F.col("x.counts").alias("n"))
    levels, maps = [], {}
    for length in range(1, longest + 1):
        if length == 2:
            maps[length] = frequent_places(index, length, maps, least)
        rows = words if length == 1 else counted(index, length, maps)
        with settings(docs.sparkSession, SINGLE):
            level = materialise(rows.groupBy(*columns(length)).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases-level")
        levels.append(level.select(F.array(*columns(length)).alias("words"), "n"))
        keys = level.select(F.xxhash64(*columns(length)).alias("key"))
        if keys.isEmpty():
            break
        size = bits_for(keys)
        maps[length] = (bit_array(keys, "key", size), size)
    return index, index.groupBy("lang").agg(F.sum("n").alias("n_words")), reduce(DataFrame.unionByName, levels)


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exactly: products of up to 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1000)) * wide(a) * wide(n), wide(l) * wide(r))


def scored(known: DataFrame) -> DataFrame:
    """words, a, score, l, r, left_more and right_more (the highest count with one word more on that side, if frequent) of phrases of two words or more; known: words, lang, n_words and n of all frequent ones."""
    size = F.size("words")
    phrases = known.where(size > 1).select("words", "lang", "n_words", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("words", 1, F.col("k")), "tail": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    counts = known.select("words", "n")
    cuts = cuts.join(counts.select(F.col("words").alias("head"), F.col("n").alias("l")), "head").join(counts.select(F.col("words").alias("tail"), F.col("n").alias("r")), "tail")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n_words"), F.col("l"), F.col("r")))
    best = cuts.groupBy("words", "lang", "a", "n_words").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = phrases.where(size > 2)
    sides = longer.select(F.slice("words", 2, size - 1).alias("words"), F.col("a").alias("left_more"), F.lit(None).cast("long").alias("right_more"))
    sides = sides.unionByName(longer.select(F.slice("words", 1, size - 1).alias("words"), F.lit(None).cast("long").alias("left_more"), F.col("a").alias("right_more")))
    sides = sides.groupBy("words").agg(F.max("left_more").alias("left_more"), F.max("right_more").alias("right_more"))
    return best.join(sides, "words", "left").select("words", "lang", "a", F.col("n_words").alias("n"), "c.score", "c.l", "c.r", "left_more", "right_more")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, share: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, left_more, right_more: each language's best phrases of 2 to `longest` words.

    A phrase is dropped if one word more leaves `share` per cent of its count.
    """
    index, totals, known = frequent(docs, text, lang, least, longest)
    langs = index.select("lang", F.explode("vocab").alias("id")).distinct()
    first = known.select(F.element_at("words", 1).alias("id")).distinct()
    langs = langs.join(first, "id", "left_semi").join(totals, "lang")
    known = materialise(known.withColumn("id", F.element_at("words", 1)).join(langs, "id").drop("id"), "phrases-known")
    kept = scored(known).where(100 * F.coalesce(F.greatest("left_more", "right_more"), F.lit(0)) < share * F.col("a"))
    order = [F.col("score").desc(), F.col("a").desc()]
    best = kept.withColumn("tied", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("tied") <= top).drop("tied")
    best = materialise(best, "phrases-best")
    named = best.select("words", F.posexplode("words").alias("at", "id"))
    ids = materialise(named.select("id").distinct(), "phrases-words")
    spelt = index.select(F.explode(F.arrays_zip("vocab", "words")).alias("x")).select(F.col("x.vocab").alias("id"), F.col("x.words").alias("word"))
    spelt = maybe_in(spelt, F.col("id"), ids, "id", bits_for(ids)).where("maybe").groupBy("id").agg(F.min("word").alias("word"))
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    out = best.join(named.join(spelt, "id").groupBy("words").agg(phrase.alias("phrase")), "words")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_more", "right_more")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to five words of each language."""
    with spent_shuffles(spark):
        return settled(lambda: collocations(table(spark, sf_dir, "documents")).drop("left_more", "right_more"), "phrases")


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, k.k AS k, array_to_string(w[i.i:i.i + k.k - 1], ' ') AS phrase FROM w, generate_series(1, 5) k(k), generate_series(1, len(w)) i(i) WHERE i.i + k.k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
s AS (SELECT lang, k, phrase, c, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
e AS (SELECT lang, phrase, max(c) AS c FROM (SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, c FROM s UNION ALL SELECT lang, array_to_string(w[2:], ' '), c FROM s) GROUP BY ALL),
d AS (SELECT s.lang, s.phrase FROM s LEFT JOIN e ON s.lang = e.lang AND s.phrase = e.phrase WHERE e.c IS NULL OR e.c < s.c),
c AS (SELECT s.lang, s.phrase, s.c AS a, l.c AS l, r.c AS r, n.n, s.x AS cut, 1000::HUGEINT * s.c * n.n // (l.c::HUGEINT * r.c) AS score
      FROM (SELECT *, unnest(generate_series(1, k - 1)) AS x FROM s) s JOIN n ON n.lang = s.lang
      JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:s.x], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.x + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM c),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b JOIN d ON b.lang = d.lang AND b.phrase = d.phrase WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z WHERE rank <= 2000
"""
