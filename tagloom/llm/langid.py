"""Operator 5: language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over character n-grams predicts each bit. A text's language is the
codeword of least loss, each bit's loss weighted by that classifier's margin (exponential loss of the signed margin,
bits weighted by their accuracy on the learning rows). Texts whose two nearest codewords lie close are flagged.

Learned from a bounded sample of labelled rows (SAMPLE, dealt evenly to the languages, so that a rare one is learned
too); predictions cover every whole text. A word's classifier
outputs are computed once for each distinct word and summed over the text.

Defined cases: a null text or one without any letter is `und` with score 0; null labels aren't learned from; with a
single language every text with letters gets it; with none, `und`. An empty table gives no rows. Repeated rows give
repeated results; only the named columns are read.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, slices, table, tidy
from .words import WordTable, grams, words_of

#: Rows the classifier is fitted on, at most.
SAMPLE = 3000
BUCKETS, LEAST, MOST = 8192, 1, 4
EPOCHS, RATE, DECAY = 150, 0.5, 1e-4
#: Below this difference of the two best scores a text is ambiguous.
AMBIGUOUS = 0.2
UND = "und"


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All distinct splits for few languages; for many, the random code of largest least distance among a hundred."""
    if n <= 6:
        rest = [x for x in itertools.product([-1, 1], repeat=n - 1) if -1 in x] if n > 1 else [()]
        return np.array([[1, *x] for x in rest]).T if n > 1 else np.ones((1, 1), int)
    rng, bits = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n)))
    tries = [rng.choice([-1, 1], (n, bits)) for _ in range(100)]
    return max(tries, key=lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i)))


def buckets_of(word: str) -> np.ndarray:
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams(word, LEAST, MOST)])


def fit(texts: list[str], langs: list[str]) -> Model:
    """Logistic classifiers for all bits at once, by full-batch descent with Nesterov's momentum."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.ones((0, 1), int), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    code = codewords(len(names))
    x, cache = np.zeros((len(texts), BUCKETS), np.float32), {}
    for i, t in enumerate(texts):
        if counts := Counter(words_of(t)):
            for w in counts:
                if w not in cache:
                    cache[w] = buckets_of(w)
            ids = [cache[w] for w in counts]
            x[i] = np.bincount(np.concatenate(ids), np.repeat([*counts.values()], [len(k) for k in ids]), BUCKETS)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    # columns to a common scale: rare n-grams would otherwise learn slowly
    scale = 1 / np.sqrt((x**2).mean(0) + 1e-7)
    x *= scale
    y = code[[names.index(v) for v in langs]].astype(np.float32)
    share = np.array([1 / max(1, langs.count(n)) for n in langs], np.float32)[:, None]
    share /= max(share.sum(), 1e-9)
    w, b, v = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.zeros((BUCKETS, code.shape[1]), np.float32)
    step = RATE / max(1.0, float((x**2).sum(1).mean()))
    for _ in range(EPOCHS):
        ahead = w + 0.9 * v
        g = share * -y / (1 + np.exp(np.clip(y * (x @ ahead + b), -30, 30)))
        v = 0.9 * v - step * (x.T @ g + DECAY * ahead)
        w, b = w + v, b - RATE * g.sum(0)
    right = ((np.sign(x @ w + b) == y) * share).sum(0)
    return Model(names, code, w * scale[:, None], b, np.maximum(right - 0.5, 0.01))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of margins: number of the nearest codeword, score in 0..1, whether the runner-up is close."""
    loss = np.exp(-np.clip(margins, -8, 8)[:, None, :] * model.code[None]) @ (model.trust / model.trust.sum())
    near = -np.log(loss + 1e-12)
    p = np.exp(near - near.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = p[np.arange(len(p)), best]
    second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return best, top, top - second < AMBIGUOUS


def margins_of(texts: list[str], model: Model, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Bit margins of each text, and whether it has a letter."""
    sums = np.stack([words.sums(words_of(t)) for t in texts])
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias, sums[:, -1] > 0


def word_table(model: Model) -> WordTable:
    def row(word: str) -> np.ndarray:
        ids = buckets_of(word)
        return np.append(model.weights[ids].sum(0), len(ids))

    return WordTable(row, model.code.shape[1] + 1)


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Rows of each language: even shares, and what small languages leave goes to the others."""
    out, left = {}, sample
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(1, left // (len(counts) - i)))
        left -= out[name]
    return out


def learn(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the whole texts of at most `sample` rows (or one for each language, if those are more) with text and lang."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(key, "text", "lang")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a number for each language
    if not counts:
        return fit([], [])
    parts = [bounded_sample(rows.where(F.col("lang") == name), key, n) for name, n in sorted(quotas(counts, sample).items())]
    found = functools.reduce(DataFrame.unionByName, parts).toPandas().sort_values([key, "lang"], kind="stable")
    return fit(found.text.tolist(), found.lang.tolist())


def predict(docs: DataFrame, model: Model, more: list[str]) -> DataFrame:
    """The columns `more` of docs with lang_pred, score and ambiguous for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and buckets x bits: doesn't grow with rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words = m.__dict__.setdefault("words", None) or word_table(m)
        m.words = words  # kept with the model, for the worker's next task
        for batch in batches:
            for part in slices(batch, 0, 1024, 8_000_000):
                texts = [t or "" for t in part.column(0).to_pylist()]
                margins, letters = margins_of(texts, m, words)
                letters &= len(m.langs) > 0
                best, score, close = decode(margins, m) if m.langs else (np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool))
                pred = [m.langs[k] if ok else UND for k, ok in zip(best, letters, strict=True)]
                cols = [*part.columns[1:], pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(close | ~letters)]
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(more))] + ["lang_pred", "score", "ambiguous"])

    kinds = [docs.schema[c].dataType.simpleString() for c in more]
    schema = "".join(f"c{i} {k}, " for i, k in enumerate(kinds)) + "lang_pred string, score double, ambiguous boolean"
    out = docs.select(F.col("text"), *(F.col(c) for c in more)).mapInArrow(tidy(run), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(more)), "lang_pred", "score", "ambiguous")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a third of the documents is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out")
    model = learn(docs.where(~held))
    return predict(docs.select("text", "doc_id", held), model, ["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told (no letters, or no nearest codeword) go."""
    model = learn(docs.select("doc_id", "text", "lang"))
    cols = docs.columns
    return predict(docs, model, cols + [c for c in ["text"] if c not in cols]).where(F.col("lang_pred") != UND).select(*cols)
