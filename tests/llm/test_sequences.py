"""Token alignment, phrases and repeated passages against brute force: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import alignment, bpe, doubling, packing, phrases, wordids

SCHEMA = "doc_id long, text string, lang string, doc long, tag string, words string, block string, first string"
RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(1, 9))) for _ in range(150)]
SMALLEST = -(1 << 63)


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", "", ",", ". "]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, passage, rows = [prose(90) for _ in range(14)], prose(70), []
    rows += base + base[:4] + [x + " tail" for x in base[3:7]] + [" ".join("new" if i % 31 == 7 else w for i, w in enumerate(x.split())) for x in base[6:10]]
    rows += [prose(20) + "\n" + passage + "\t" + prose(15) for _ in range(4)] + [" ".join(passage.split()[i : i + 14]) for i in range(5)]
    rows += [None, "", " \n\t\x0b ", "a", "same same " * 40, "same same " * 9, prose(3000), "x" * 3000, "ein Wort" + " zu viel" * 30, "é ñ 京都 <|endoftext|> </s> <s>", "▁ under ▁▁score", "½ ² Ⅷ \x00 \x85 x y", "tab\tand  two   spaces", "A B C. a b c! A b C"]
    rows += ["One two three four five. " * 30, "ONE TWO THREE four five; " * 20]
    out = [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(rows)]
    return [*out, (3, rows[3], "en"), (3, prose(30), "en"), (None, base[1], "en"), (None, base[1] + " more", "de")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, 1, "t", "w", "b", "f") for i, t, lang in texts], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- alignment


def test_galloping_ranks():
    rng = random.Random(1)
    for _ in range(200):
        x, y = (np.array(sorted(rng.sample(range(1, 500), rng.randint(1, 300)))) for _ in range(2))
        assert (alignment.ranks(x, y) == np.searchsorted(y, x)).all()
    assert len(alignment.ranks(np.zeros(0, np.int64), np.arange(3))) == 0


def test_varints():
    x = np.array([0, 1, 127, 128, 300, 1 << 20, 1 << 40, 5])
    assert (alignment.from_varints(alignment.varints(x)[0]) == x).all()
    assert len(alignment.from_varints(np.zeros(0, np.uint8))) == 0


def aligned_plainly(texts):
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: i for i, c in enumerate(bpe.byte_chars())}
    found, counts = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        size_a = [bytes(byte_of[c] for c in a_of.id_to_token(i)) for i in a]
        size_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(size_a) != (" " + text).encode() or b"".join(size_b) != (" " + text).encode():
            continue
        owner = lambda xs: [i for i, x in enumerate(xs) for _ in x]
        links = list(dict.fromkeys(zip(owner(size_a), owner(size_b), strict=True)))
        ends = [set(np.cumsum([len(x) for x in xs]).tolist()) for xs in (size_a, size_b)]
        groups, ga, gb, i, j, end = [], [], [], 0, 0, 0
        for cut in sorted(ends[0] & ends[1]):
            ga, gb = [], []
            end_a = end_b = end
            while end_a < cut:
                ga.append(a[i])
                end_a, i = end_a + len(size_a[i]), i + 1
            while end_b < cut:
                gb.append(b[j])
                end_b, j = end_b + len(size_b[j]), j + 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            end = cut
        ids = [(a[x], b[y]) for x, y in links]
        counts.update(ids)
        found[-1] = len(a), len(b), groups, ids
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()


def align(df):
    return alignment.align_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def test_alignment(docs, texts, empty, monkeypatch):
    want = Counter((i, *x) for (i, _, _), x in zip(texts, aligned_plainly([t for _, t, _ in texts]), strict=True))
    monkeypatch.setattr(alignment, "ROWS", 7)
    got = align(docs)
    assert Counter(map(tuple, got.collect())) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert align(empty).collect() == []
    assert [tuple(r)[1:] for r in align(docs.where("text = '' OR text IS NULL")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


# --- phrases


def phrases_plainly(rows, least, top):
    f, n, out = {}, Counter(), []
    for _, text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in candidates.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) for q in [p[i:j]] if a >= c[q]}
        kept = []
        for p, a in candidates.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return Counter(out)


def test_phrases(docs, texts, empty, monkeypatch):
    got = phrases.collocations(docs, 4, 60)
    assert Counter(map(tuple, got.drop("left_more", "right_more").collect())) == phrases_plainly(texts, 4, 60)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(docs, 10_000).collect() == []
    for r in got.where("left_more IS NOT NULL").collect():
        assert r.left_more < r.a


def test_phrases_of_small_shards_and_parts(docs, texts, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 40)
    monkeypatch.setattr(phrases, "BYTES", 200)
    monkeypatch.setattr(wordids, "PART", 64)
    assert Counter(map(tuple, phrases.collocations(docs.coalesce(1), 3, 80).drop("left_more", "right_more").collect())) == phrases_plainly(texts, 3, 80)


def test_index_counts_and_extends_both_ways():
    rng = random.Random(2)
    pieces = [[rng.randint(1, 4) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    seq = np.array([x for p in pieces for x in [*p, 0]], np.int32)
    for sides in ([True] * 4, [False] * 4, [True, False, True, False], [False, False, True, True]):
        index = phrases.Index(phrases.transform(seq), phrases.transform(seq[::-1].copy()))
        p = index.words
        for right in sides:
            p = index.extend(p, right)
            k = p.words.shape[1]
            want = Counter(tuple(x[i : i + k]) for x in pieces for i in range(len(x) - k + 1))
            assert dict(zip(map(tuple, p.words.tolist()), p.n.tolist(), strict=True)) == want


def test_scores_pass_64_bits(spark):
    cases = [(10**12, 10**13, 3 * 10**12, 2 * 10**12), (10**9 + 7, 10**15 + 3, 10**9 + 9, 10**10 + 1), (100, 1000, 333, 700)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = [x.s for x in df.select(phrases.score(*(F.col(c) for c in ("a", "n", "l", "r"))).alias("s")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in cases]


# --- repeated passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_plainly(rows, size=13):
    first, split = {}, [(SMALLEST if i is None else i, WORD.findall(t or "")) for i, t, _ in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, i), i)
    for i, w in split:
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


def longest_plainly(rows, size=13):
    """Words of the longest window of size * 2^k that a smaller doc has too."""
    out, split = {}, [(SMALLEST if i is None else i, WORD.findall(t or "")) for i, t, _ in rows]
    for at, (i, w) in enumerate(split):
        out[at], n = 0, size
        while n <= len(w):
            held = {tuple(v[k : k + n]) for j, v in split if j < i for k in range(len(v) - n + 1)}
            if not any(tuple(w[k : k + n]) in held for k in range(len(w) - n + 1)):
                break
            out[at], n = n, 2 * n
    return out.values()


def test_doubling(docs, texts, empty):
    got = doubling.remove_repeats(docs, with_text=True)
    want = Counter((i, *x, n) for (i, _, _), x, n in zip(texts, repeats_plainly(texts), longest_plainly(texts), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept, r.longest) for r in got.collect()) == want
    assert max(longest_plainly(texts)) >= 52
    assert doubling.remove_repeats(empty).collect() == []
    assert [r.n_removed for r in doubling.remove_repeats(docs.where("doc_id = 3")).collect()] == [0, 0, 0]


@pytest.mark.parametrize("size", [2, 5])
def test_doubling_of_other_lengths_in_parts(docs, texts, size, monkeypatch):
    monkeypatch.setattr(doubling, "PART", 50)
    monkeypatch.setattr(doubling, "BYTES", 3000)
    monkeypatch.setattr(wordids, "PART", 128)
    got = doubling.remove_repeats(docs, size)
    want = Counter((i, *x[:3]) for (i, _, _), x in zip(texts, repeats_plainly(texts, size), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


# --- packing


def test_plan_of_all_lengths_inside_a_session(spark):
    assert spark.range(10).count() == 10
    counts = Counter({k: 1 + k * 7 % 11 for k in range(1, 1024)})
    p = packing.plan(counts)
    assert p.patterns * 1024 + p.stream == sum(k * n for k, n in counts.items())
    used = Counter()
    for pattern, often in packing.generate_columns(counts):
        for k, n in pattern.items():
            used[k] += n * often
    assert all(abs(used[k] - n) < 1e-6 for k, n in counts.items())


def test_rare_pairs_are_not_sent(spark):
    """Equal phrases of a task's shards are put together, and pairs that are rare in all of them aren't sent."""
    texts = [f"red apples green pears w{k} v{k}" for k in range(200)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(16)
    index = phrases.shards(docs)
    assert index.count() == 16
    maps = {1: (np.full(1 << 17, 255, np.uint8), 1 << 20)}
    every = phrases.counted(index, 2, maps).groupBy("w1", "w2").agg(F.sum("n").alias("n")).collect()
    frequent = {(r.w1, r.w2): r.n for r in every if r.n >= 40}
    maps[2] = phrases.frequent_places(index, 2, maps, 40)
    sent = phrases.counted(index, 2, maps).collect()
    assert 0 < len(frequent) < len(every) / 2
    assert {(r.w1, r.w2) for r in sent} == set(frequent) and sum(r.n for r in sent) == sum(frequent.values())
    twice = list(phrases.summed(iter([(np.array([[1, 2], [3, 4]]), np.array([5, 6])), (np.array([[3, 4]]), np.array([7]))])))
    assert [(r.tolist(), n.tolist()) for r, n in twice] == [([[1, 2], [3, 4]], [5, 13])]


def test_memory_of_a_shard():
    """Making a shard of full size takes 30 MB beyond its words; it took 42 while it held what it no longer used."""
    rng = np.random.default_rng(1)
    words = np.minimum(rng.zipf(1.3, phrases.SHARD), 100_000) * 7919
    built = phrases.Builder()
    for ids in np.array_split(words, 4):
        new = rng.random(len(ids)) < 0.1
        known = np.unique(ids)
        built.add(ids, new | (np.arange(len(ids)) == 0), (known, pa.array([f"w{x}" for x in known.tolist()], pa.large_string())))
    tracemalloc.start()
    made = built.shard()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made["n"] == phrases.SHARD and made["counts"].sum() == phrases.SHARD
    assert peak < 36e6


def test_texts_of_phrases_come_in_small_batches(spark, monkeypatch):
    """While the index is made, a task gets texts of some 2 MB at once, not 10,000 whatever their length."""
    docs = spark.createDataFrame([("red apples, " * 20_000, "en")] * 40, "text string, lang string").coalesce(1)
    seen, write = {}, phrases.materialise

    def spied(df, tag, *more):
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        seen.setdefault(tag, sizes.agg(F.max("n")).first()[0])
        return write(df, tag, *more)

    monkeypatch.setattr(phrases, "materialise", spied)
    assert phrases.frequent(docs, "text", "lang", 100, 2)[0].agg(F.sum("n")).first()[0] == 40 * 40_000
    assert seen["phrases-index"] < 3_000_000
