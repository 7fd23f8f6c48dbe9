"""Training-data operators against brute force and libraries; nulls, empty and long texts, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tagloom.llm import bpe, iblt, induced, langid, lines, neardup, packing, passages, pivots, toxicity, warc
from tagloom.llm.common import materialise, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, __maybe string, maybe boolean"
RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(1, 9))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages and lines, and all the odd cases."""
    base = [prose(120) for _ in range(25)]
    passage, rows = prose(110), []
    rows += base + base[:5] + [x + " tail" for x in base[3:9]] + [" ".join(w if i % 40 else "new" for i, w in enumerate(x.split())) for x in base[8:14]]
    rows += [prose(40) + "\n" + passage + "\n" + prose(30) for _ in range(5)] + [prose(9) + "\nsame line\nother line\n" + prose(9) for _ in range(4)]
    rows += [None, "", " \n\t ", "a", "a b c d", "a b c d", "é" * 300 + "è" * 300, "12 34 !!", prose(4000), "x" * 3000, "x" * 3000, "<|endoftext|> 'S it's Σς 京都", "½ ² Ⅷ ① ٣"]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def texts():
    rows = corpus()
    return [*rows, (3, rows[3][1]), (None, prose(30))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "m", True) for i, t in texts], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, texts, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    want = Counter()
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, tuple(ids), t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == want
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out)
    assert bpe.encode(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_bpe_words_cost_what_their_letters_do():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        code = bpe.encoder(f.read())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rng, merges = random.Random(3), []
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14))) + rng.choice(["", "!", "'s", "...", "é1"]) for _ in range(20_000)]
    words += ["".join(rng.choice("aeinorst") for _ in range(n)) for n in (100_000, 1_000_000)]  # 8.4 s at 40,000 letters when each prefix was joined anew
    merge, code.merge = code.merge, merges.append
    ids = code.encode_batch([*words[:-1], " ".join(words[:9000])])
    began = time.process_time()
    long = code.encode_batch(words[-1:])[0]
    assert time.process_time() - began < 60
    code.merge = merge
    assert not merges  # no pair of tokens is merged from its symbols to see whether it stays
    assert ids == [" ".join(map(str, x.ids)) for x in t.encode_batch([*words[:-1], " ".join(words[:9000])], add_special_tokens=False)]
    assert long == " ".join(map(str, t.encode(words[-1], add_special_tokens=False).ids))
    for (left, right), fit in code.fits.items():
        assert fit == (merge((code.symbols(left) if left else []) + code.symbols(right)) == ([left, right] if left else [right]))
    for again in (words[0], words[0] + " <|endoftext|>"):
        code.held = bpe.KEEP_CHARS + 1  # it starts anew
        assert code.encode_batch([again]) == [" ".join(map(str, t.encode(again, add_special_tokens=False).ids))]
        assert len(code.chunks) < 10


def test_warc(spark):
    big = "<p>" + "é" * 900
    rows = [(1, "http://a", big), (2, None, big), (5, "u\r\nX: y", big), (3, "s", "small"), (4, "s", "small"), (6, "n", None), (None, "z", big), (7, "l", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"{shared_dir(spark)}/test-warc"
    files = materialise(warc.normalise(materialise(warc.write_archives(warc.page_records(pages), folder + "/raw"), "raw"), folder + "/normal"), "normal")
    out = {r.page_id: r for r in warc.read_records(files, with_payload=True).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in out.items() if i in (1, 2, 5, None, 3, 4)} == {1: ("revisit", 5), 2: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None)}
    assert out[7].payload == b"x" * 3_000_000
    assert warc.page_records(pages.limit(0)).count() == 0


def test_pivots(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (None, [0.0] * 6), (7, rows[7][1]), (404, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = pivots.usable(df, "vec_id", "embedding")
    got = Counter(map(tuple, pivots.top_k(v.where("vec_id % 50 = 0"), v, 5, query_block=3, candidate_block=37).collect()))
    ok = [(r.vec_id, r.v) for r in v.collect()]
    want = Counter()
    for q, x in [o for o in ok if o[0] % 50 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q))[:5]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if (x and 100 * len(x & y) >= 75 * len(x | y)) or (sets[a][0] is not None and sets[a][0] == sets[b][0]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)), i == least.get(find(k))) for k, (i, s) in enumerate(sets))


def test_near_duplicates(docs, texts, empty, monkeypatch):
    want = brute_components(texts)
    assert Counter(map(tuple, neardup.near_duplicates(docs.select("doc_id", "text")).collect())) == want
    monkeypatch.setattr(neardup, "LONG", 2)  # lists by whole sets
    assert Counter(map(tuple, neardup.near_duplicates(docs.select("doc_id", "text")).collect())) == want
    assert neardup.near_duplicates(empty.select("doc_id", "text")).count() == 0


def test_near_duplicates_in_large_groups(spark):
    rng = random.Random(8)
    core, rows = prose(60, rng).split(), []
    for i in range(150):
        w = list(core)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(core[:45]) + " " + prose(rng.randint(5, 30), rng)) for i in range(80)]
    got = Counter(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_components(rows)


def brute_passages(rows, n=400):
    raws = [(t or "").encode() for _, t in rows]

    def covered(n):
        where = Counter()
        for r in raws:
            where.update(r[i : i + n] for i in range(len(r) - n + 1))
        for r in raws:
            gone = np.zeros(len(r) + 2, bool)
            for k in range(len(r) - n + 1):
                if where[r[k : k + n]] > 1:
                    gone[k + 1 : k + n + 1] = True
            edge = np.diff(gone.astype(int))
            yield gone[1:-1], list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))

    out, cleaned = Counter(), []
    for (i, _), r, (gone, runs), (near, parts) in zip(rows, raws, covered(n), covered(240)):
        words = [(b, e) for b, e in parts if len(r[b:e].split()) >= 50]
        out[(i, len(r), int(gone.sum()), len(runs), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest(), len(words))] += 1
        for b, e in words:
            gone[b:e] = True
        cleaned.append((i, bytes(np.frombuffer(r, np.uint8)[~gone]).decode("utf-8", "ignore"), bool(gone.any())))
    return out, cleaned


SHORT = " ".join(random.Random(5).choice([w for w in WORDS if len(w) < 7]) for _ in range(57))


def test_passages(spark, docs, texts, empty, monkeypatch):
    texts = [*texts, *((100 + k, prose(20) + "\n" + SHORT + "\n" + prose(20 + k)) for k in range(3))]  # passages of less than 400 bytes
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "m", True) for i, t in texts], SCHEMA).repartition(5)
    want, cleaned = brute_passages(texts)
    assert sum(n for row, n in want.items() if row[0] in (100, 101, 102) and row[-1] == 1 and row[2] == 0) == 3
    run = lambda: Counter(map(tuple, passages.remove_passages(docs.select("doc_id", "text")).drop("runs").collect()))
    assert run() == want
    monkeypatch.setattr(passages, "SHARD", 5000)
    monkeypatch.setattr(passages, "HOT", 1500)  # window by window
    assert run() == want
    assert passages.remove_passages(empty).count() == 0
    kept = Counter((r.doc_id, r.text or "", r.n_chars) for r in passages.stage(spark, docs, "").collect())
    assert kept == Counter((i, t, len(t)) for i, t, cut in cleaned if not cut or t.split())


@pytest.mark.parametrize("more", [{}, {"base": 3, "budget": 10}])
def test_suffix_order(more):
    rng = random.Random(3)
    for _ in range(120):
        k, n = rng.choice([1, 2, 3, 200]), rng.randint(1, 90)
        t = bytes(rng.randrange(k) for _ in range(n))
        t = (t[: n // 3] * 4)[: n + 5] or t if rng.random() < 0.4 else t
        order, common = induced.suffix_order(np.frombuffer(t, np.uint8), 10**6, True, **more)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        for a, b, c in zip(want, want[1:], common[1:].tolist()):
            assert t[a : a + c] == t[b : b + c] and t[a + c : a + c + 1] != t[b + c : b + c + 1]


def test_lines(spark, docs, texts, empty):
    got = {(r.doc_id, r.text) for r in lines.stage(spark, docs, "").collect()}
    seen, want = set(), set()
    for i, t in sorted({x for x in texts if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 1):
            pair = (ls[k], ls[k + 1])
            if pair in seen and any(x.strip(" ") for x in pair):
                gone |= {k, k + 1}
            seen.add(pair)
        kept = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        if not gone or kept.strip(" "):
            want.add((i, kept))
    assert got == want | {(i, t) for i, t in texts if t is None}
    assert lines.stage(spark, empty, "").count() == 0
    assert len({r.text for r in lines.remove_lines(spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb")], "doc_id long, text string"), 3).collect()}) == 3


def test_long_single_lines(spark):
    long, short = prose(50), prose(49)
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{long}"), (3, f"e\n{short}\nf"), (4, f"g\n{short}\nh"), (5, f"  {long}"), (6, None), (7, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    want = dict(rows[:6]) | {2: "c\nd"}
    assert {i: r.text for i, r in out.items()} == want
    assert out[2].n_chars == 3
    assert {r.text for r in lines.stage(spark, docs, "").collect()} == {t for _, t in rows}


def test_packing(docs, texts, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    fill, by_doc = Counter(), Counter()
    for r in out:
        fill[r.sequence_id] += r.length
        by_doc[r.doc_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in fill.values())
    spans = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip([(-1, 0, 0), *spans], spans))
    want = Counter()
    ids = {}
    for i, x in texts:
        ids[i] = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] += len(ids[i])
    assert by_doc == want
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in out)
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_column_generation_packs_well():
    counts = {600: 100, 424: 90, 512: 50, 100: 40}
    plan = packing.plan(counts)
    assert plan.patterns * 1024 + plan.stream == sum(k * n for k, n in counts.items())
    assert sum(hi - lo for _, lo, hi, *_ in plan.places) == sum(counts.values())
    assert plan.patterns >= 100


def test_patterns_take_nearly_all():
    rng = random.Random(6)
    counts = Counter(rng.randint(1, 1023) if rng.random() < 0.7 else rng.randint(1, 200) for _ in range(10_000))
    p = packing.plan(counts)
    total = sum(k * n for k, n in counts.items())
    assert p.patterns * 1024 + p.stream == total and p.patterns * 1024 >= 0.95 * total
    dealt, fill = Counter(), Counter()
    for k, lo, hi, copies, first, at, _ in p.places:
        dealt[k] += hi - lo
        for t in range(hi - lo if first >= 0 else 0):
            fill[first + t // copies] += k
    assert dealt == counts and set(fill.values()) == {1024} and len(fill) == p.patterns
    for _ in range(200):  # fillings are exact, within the counts, and found if there are any
        some = Counter(rng.randint(1, 12) for _ in range(rng.randint(0, 6)))
        room, sums = rng.randint(1, 30), {0}
        for k, n in some.items():
            sums |= {s + k * m for s in sums for m in range(n + 1)}
        found = packing.exact_filling(some, room)
        assert (found is not None) == (room in sums)
        assert found is None or (sum(k * m for k, m in found.items()) == room and all(m <= some[k] for k, m in found.items()))


def test_ids_as_the_library_over_random_text():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        ids = packing.Ids(f.read())
    rng, signs = random.Random(7), "aZ9 '\t\n\r\x0b\x85\u00a0\u2028\u3000.,!-_<|>éßЖ京ا\u0301½²Ⅷ\u200d😀\U000e0001"
    for _ in range(3000):
        n = rng.randint(0, 40)
        x = "".join(rng.choice(signs) if rng.random() < 0.6 else chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(n))
        assert list(ids.of(x)) == ids.slow().encode(x, add_special_tokens=False).ids


def test_fingerprints(docs, texts, empty):
    out = iblt.fingerprints(docs.select("doc_id", "text")).collect()
    order = sorted({(i, t or "") for i, t in texts}, key=lambda x: (x[0] is not None, x[0] or 0))
    after = {a: b for a, b in zip(order, order[1:] + order[:1])}
    units = lambda x: set(re.findall(r"[^\n]{1,240}", x))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints, want = {}, Counter()
    for i, t in texts:
        x, y = t or "", after[(i, t or "")][1]
        h = len(x) // 2
        e = x[: len(x) - h] + y[:h]
        want[(i, len(x), hashlib.sha256(e.encode()).hexdigest(), round(like(units(x), units(e)), 9), round(like(units(x), units(y)), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == want
    by_id = dict(texts)
    for r in out:
        assert prints.setdefault(by_id[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert iblt.fingerprints(empty).count() == 0


def test_langid_held_out(spark, docs, empty):
    rows = [r for r in langid.op5_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert sum(r.lang_pred == r.lang for r in rows) > 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.learn(docs), ["doc_id"]).collect()}
    odd = {i for i, t in corpus() if not any(unicodedata.category(c)[0] == "L" for c in t or "")}
    assert {i for i, p in out.items() if p == "und"} == odd
    assert langid.predict(empty, langid.learn(empty), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(empty), ["doc_id"]).collect()} == {"und"}
    assert langid.quotas({"a": 5, "b": 1000, "c": 2000}, 300) == {"a": 5, "b": 147, "c": 148}
    code = langid.codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 5


def test_toxicity_held_out(spark, docs, empty):
    rows = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in hit) >= 0.9 * len(hit)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert {(r.score, r.predicted) for r in toxicity.predict(docs, model, ["doc_id"]).collect()} == {(0.0, 0)}
    some = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))  # rows of one doc_id among them
    model = toxicity.learn(some, some.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    out = toxicity.predict(docs, model, ["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert {r.predicted for r in out if r.doc_id is not None and not re.search(r"[^\W\d_]", dict(corpus())[r.doc_id] or "")} == {0}
    assert toxicity.predict(empty, model, ["doc_id"]).count() == 0


def test_pipeline_stages(spark, docs, empty):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, kept, "/root/testdata/sf0.001"), "test-stage")
        assert kept.columns == docs.columns
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").agg(F.countDistinct("doc_id")).first()[0] > 20
