"""Operator 2: toxicity by a bag of subword embeddings, averaged, under a linear softmax.

A word stands for itself and its character n-grams, each a hashed row of an embedding table; a text's vector is the
mean of the rows of all its words, rare rows weighing more (inverse document frequency), and a softmax over two classes
follows. Table and softmax are trained together, in numpy, by AdaGrad, both labels with equal weight in sum. As
misspellings share n-grams with the words they come from, they get similar vectors.

Texts are scored in windows of WINDOW words that overlap by half, so a passage counts alike in short and in long texts:
the softmax is linear in the mean, so each word adds two numbers, kept by the worker. The score is the probability of
the same softmax with its two margins, that of the highest window and that of the whole text, brought to scale on
learning rows that the table hasn't seen. On sf0.1 (120 held-out rows of label 1, six of which show nothing, and 870 of
label 0) they catch 109 with 10 false; under like settings the highest window's alone caught 105 where both caught 109.

Learned from a bounded sample of labelled rows (SAMPLE), whole texts. Defined cases: null, empty and letterless
texts get the learned rate of label 1 at most 0.29 (predicted 0); without rows of both labels to learn from every text
gets that, so 0 without any rows; repeated rows give repeated results; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, slices, table, tidy
from .words import WordTable, words_of

#: Labelled rows the model is fitted on, at most: of label 1 half of them, the rest of label 0.
SAMPLE = 3000
BUCKETS, WIDTH, LEAST, MOST = 1 << 16, 8, 3, 6
FOLDS, STEPS, BATCH, RATE = 3, 700, 32, 0.15
WINDOW = 48
#: Rows of margin 0 added to each mean, so that a few words decide less.
FEW = 240
THRESHOLD = 0.3


@dataclass
class Model:
    table: np.ndarray  # of each bucket: what it adds to the margin of label 1
    rare: np.ndarray  # of each bucket: its weight in a mean
    curve: np.ndarray | None  # of the softmax's margins: constant, highest window, mean of the text; None: nothing was learned
    base: float


def bag_of(text: str) -> list[str]:
    """The distinct words of a text in order of first use: a word that fills a page counts once."""
    return list(dict.fromkeys(words_of(text)))


def buckets_of(word: str) -> np.ndarray:
    """Buckets of the word and of its n-grams between boundary signs; they are cut from its bytes, where characters begin."""
    crc, raw = zlib.crc32, f"<{word}>".encode("utf-8", "surrogatepass")
    at = range(len(raw) + 1) if word.isascii() else [i for i, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
    n = len(at) - 1
    found = [crc(raw), *(crc(raw[at[i] : at[i + k]]) for k in range(LEAST, MOST + 1) for i in range(n - k + 1))]
    return np.array(found, np.int64) % BUCKETS


def rarity(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weight of each bucket: the logarithm of texts by texts that hold it, 1 in the mean."""
    held = np.bincount(np.concatenate([ids for ids, _ in bags]), minlength=BUCKETS)
    rare = np.log((1 + len(bags)) / (1 + held)).astype(np.float32)
    return rare / max(float(rare[held > 0].mean()), 1e-6)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """bags: distinct buckets of each text and how often they occur in it. Returns the margin that each bucket adds, and its weight."""
    rare = rarity(bags)
    bags = [(ids, n * rare[ids]) for ids, n in bags]
    bags = [(ids, (w / (w.sum() + FEW)).astype(np.float32)) for ids, w in bags]
    share = (0.5 * len(labels) / np.maximum(np.bincount(labels, minlength=2), 1)).astype(np.float32)[labels]
    rng = np.random.default_rng(seed)
    emb = ((rng.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    top, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_emb, g_top, g_bias = np.full(BUCKETS, 1e-8, np.float32), np.full_like(top, 1e-8), np.full(2, 1e-8, np.float32)
    for _ in range(-(-STEPS * BATCH // max(1, len(bags)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            ids, ws = np.concatenate([bags[i][0] for i in some]), np.concatenate([bags[i][1] for i in some])
            size = [len(bags[i][0]) for i in some]
            starts = np.cumsum([0, *size[:-1]])
            mean = np.add.reduceat(emb[ids] * ws[:, None], starts, 0)
            z = mean @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= share[some][:, None] / len(some)
            back = np.repeat(p @ top.T, size, 0) * ws[:, None]
            d_top, d_bias = mean.T @ p, p.sum(0)
            uniq, where = np.unique(ids, return_inverse=True)
            d_emb = np.stack([np.bincount(where, back[:, k], len(uniq)) for k in range(WIDTH)], 1).astype(np.float32)
            g_emb[uniq] += (d_emb**2).mean(1)
            g_top += d_top**2
            g_bias += d_bias**2
            emb[uniq] -= RATE * d_emb / np.sqrt(g_emb[uniq])[:, None]
            top -= RATE * d_top / np.sqrt(g_top)
            bias -= RATE * d_bias / np.sqrt(g_bias)
    return emb @ (top[:, 1] - top[:, 0]) * rare, rare


def word_table(table_: np.ndarray, rare: np.ndarray) -> WordTable:
    """A word's summed margin and the weight of its rows."""

    def row(word: str) -> np.ndarray:
        ids = buckets_of(word)
        return np.array([table_[ids].sum(), rare[ids].sum()])

    return WordTable(row, 2)


def features(text: str, words: WordTable) -> np.ndarray:
    """(1, mean margin of the highest window, mean margin of the text), without the bias."""
    ws = bag_of(text)
    if not ws:
        return np.zeros(3)
    ids = words.ids(ws)  # may replace words.rows
    run = np.concatenate([np.zeros((1, 2)), np.cumsum(words.rows[ids].astype(float), 0)])
    starts = np.arange(0, max(len(ws) - WINDOW // 2, 1), WINDOW // 2)
    ends = np.minimum(starts + WINDOW, len(ws))
    starts = np.maximum(ends - WINDOW, 0)
    part = run[ends] - run[starts]
    return np.array([1, (part[:, 0] / (part[:, 1] + FEW)).max(), run[-1, 0] / (run[-1, 1] + FEW)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * w)
    return w


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """Fit the margins' scale on texts that the table hasn't learned by heart, in FOLDS parts; then train on all."""
    weight = np.ones(len(labels)) if weight is None else weight
    base = float(weight @ labels / weight.sum()) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.ones(BUCKETS, np.float32), None, base)
    cache: dict[str, np.ndarray] = {}
    bags = []
    for t in texts:
        ids = [cache[w] if w in cache else cache.setdefault(w, buckets_of(w)) for w in bag_of(t)] or [np.zeros(1, int)]
        bags.append(np.unique(np.concatenate(ids), return_counts=True))
    fold_of = np.random.default_rng(3).permutation(len(bags)) % FOLDS
    xs = np.zeros((len(bags), 3))
    for k in range(FOLDS):
        learn = np.flatnonzero(fold_of != k)
        words = word_table(*train([bags[i] for i in learn], labels[learn]))
        for i in np.flatnonzero(fold_of == k):
            xs[i] = features(texts[i], words)
    return Model(*train(bags, labels), logistic(xs, labels, weight), base)


def score(texts: list[str], model: Model, words: WordTable) -> np.ndarray:
    least = min(model.base, 0.29)
    if model.curve is None:
        return np.full(len(texts), least)
    x = np.stack([features(t, words) for t in texts])
    p = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
    return np.where(x[:, 0] > 0, p, least)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Fit on at most `sample` rows, those of label 1 first up to half of them.

    The shares of the labels among all labelled rows weight the sampled ones.
    """
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}  # two rows
    ones = min(totals.get(1, 0), sample // 2)
    picked = bounded_sample(labels.where("toxic = 1"), "doc_id", sample // 2).union(bounded_sample(labels.where("toxic = 0"), "doc_id", sample - ones))
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # at most `sample` rows
    found = found.toPandas().sort_values("doc_id")
    y = found.toxic.to_numpy(int)
    weight = np.array([totals.get(k, 0) / max(1, (y == k).sum()) for k in y])
    return fit([t or "" for t in found.text], y, weight)


def predict(docs: DataFrame, model: Model, more: list[str]) -> DataFrame:
    """The columns `more` of docs with score and predicted for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words = m.__dict__.setdefault("words", None) or word_table(m.table, m.rare)
        m.words = words  # kept with the model, for the worker's next task
        for batch in batches:
            for part in slices(batch, 0, 1024, 8_000_000):
                p = score([t or "" for t in part.column(0).to_pylist()], m, words)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p), pa.array(p >= THRESHOLD).cast(pa.int32())], names=[f"c{i}" for i in range(len(more))] + ["score", "predicted"])

    kinds = [docs.schema[c].dataType.simpleString() for c in more]
    out = docs.select(F.col("text"), *(F.col(c) for c in more)).mapInArrow(tidy(run), "".join(f"c{i} {k}, " for i, k in enumerate(kinds)) + "score double, predicted int")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(more)), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; a quarter of the documents is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    model = learn(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return predict(docs.select("text", "doc_id", held.alias("held_out")), model, ["doc_id", "held_out"])
