"""Toxicity score from subword-bag embeddings.

A word is the bag of its character n-grams (and itself), hashed into ``BUCKETS``; a text is the mean over its words (a word's
repetitions count by their logarithm, and ``SHRINK`` words without any vector are added, so that a few words can't swing a
short text) of the mean of their n-gram vectors; two softmax outputs read that mean. Vectors and outputs are trained together by numpy, on the
driver, from a sample of at most ``TRAIN_ROWS`` labelled rows (the lowest id digests: the bound is a parameter and the same
at every size). An unseen misspelling shares most n-grams with the word it imitates, hence its score.

As the outputs are linear, a word's share in the score is one number, worked out once per distinct word in each worker:
scoring is a broadcast of one number per bucket (half a megabyte), a map over whole texts, and no shuffle.

Defined results: null or empty text (or white space only) is scored by the bias alone; a null ``doc_id`` is in the training
part and keeps null; repeated rows get equal scores; without labelled rows of both classes every score is the share of
label 1 (0 without labels); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

BUCKETS, DIM = 1 << 16, 8
GRAMS = (3, 4, 5)
TRAIN_ROWS = 6_000
EPOCHS, BATCH, RATE, DECAY = 5, 64, 0.05, 1e-4
#: N-grams of fewer training texts than this keep no vector.
LEAST_TEXTS = 10
SHRINK = 20
#: Means are scaled up by this, so that a word in fifty moves the outputs at the usual rate of learning.
SCALE = 60.0
HELD = 200_000
FOLDS = 5


@dataclass
class Model:
    """One number per bucket and a bias; ``score`` is the softmax's share of label 1."""
    weight: np.ndarray
    bias: float

    def score(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(means + self.bias, -40, 40)))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams and, for each, the number of its word. Every word has at least one: itself."""
    cleaned = [w.strip(".,;:!?\"'()[]{}<>|%#$&*-_/\\") or w for w in words]
    marked = [f"<{w}>" for w in cleaned]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), size)
    buckets, owners = [], []
    mix, prime = np.uint64(0x9E3779B97F4A7C15), np.uint64(1_000_003)
    with np.errstate(over="ignore"):
        rolling = code + np.uint64(1)
        for n in range(2, max(GRAMS) + 1):
            if len(rolling) < 2:
                break
            rolling = rolling[:-1] * prime + code[n - 1:] + np.uint64(1)
            if n in GRAMS:
                inside = owner[: len(rolling)] == owner[n - 1:]
                buckets.append(rolling[inside] + np.uint64(n))
                owners.append(owner[: len(rolling)][inside])
        ends = np.cumsum(size)
        power = np.cumprod(np.full(int(size.max(initial=1)), prime, np.uint64))
        place = np.arange(len(code)) - np.repeat(ends - size, size)
        whole = np.add.reduceat((code + np.uint64(1)) * power[place], ends - size) if len(marked) else np.empty(0, np.uint64)
        buckets.append(whole)
        owners.append(np.arange(len(marked)))
        hashed = np.concatenate(buckets) * mix
    return (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(owners)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text as a sparse mean: buckets and their weights."""
    counted = Counter(text.lower().split())
    if not counted:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    bucket, owner = subwords(list(counted))
    counts = 1 + np.log(np.fromiter(counted.values(), np.float64, len(counted)))
    each = counts / (counts.sum() + SHRINK) / np.bincount(owner)
    index, at = np.unique(bucket, return_inverse=True)
    return index, np.bincount(at, weights=each[owner]).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, dim: int = DIM, epochs: int = EPOCHS) -> Model:
    """Vectors and softmax together, by Adam on mini-batches of sparse means."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), -40.0 if share == 0 else 40.0)
    texts = np.zeros(BUCKETS, np.int64)
    for index, _ in rows:
        texts[index] += 1
    kept = texts >= min(LEAST_TEXTS, 1 + len(rows) // 100)
    draw = np.random.default_rng(seed)
    params = [draw.uniform(-0.1, 0.1, (BUCKETS, dim)).astype(np.float32) / dim * kept[:, None], draw.normal(0, 0.5, (dim, 2)).astype(np.float32), np.array(
        [np.log(1 - share), np.log(share)], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs)
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            # rows stay as compact as they came (two bytes a number); only a batch is spread out
            index = np.concatenate([rows[i][0] for i in chosen]).astype(np.int64)
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])[kept[index]]
            value = (np.concatenate([rows[i][1] for i in chosen])[kept[index]]).astype(np.float32) * np.float32(SCALE)
            index = index[kept[index]]
            used, at = np.unique(index, return_inverse=True)
            dense = np.zeros((len(chosen), len(used)), np.float32)
            dense[owner, at] = value
            hidden = dense @ params[0][used]
            logits = hidden @ params[1] + params[2]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[chosen]) / len(chosen)
            grads = (dense.T @ (error @ params[1].T) + DECAY * params[0][used], hidden.T @ error, error.sum(0))
            step += 1
            for k, grad in enumerate(grads):
                rowset = used if k == 0 else slice(None)
                first[k][rowset] = 0.9 * first[k][rowset] + 0.1 * grad
                second[k][rowset] = 0.99 * second[k][rowset] + 0.01 * grad * grad
                m, v = first[k][rowset] / (1 - 0.9 ** min(step, 200)), second[k][rowset] / (1 - 0.99 ** min(step, 2000))
                params[k][rowset] -= rate * m / (np.sqrt(v) + 1e-7)
    vectors, out, bias = (p.astype(np.float64) for p in params)
    return Model(vectors @ (out[:, 1] - out[:, 0]) * SCALE, float(bias[1] - bias[0]))


def _mean(words: Counter, known: dict[str, float]) -> float:
    times = [1 + math.log(n) for n in words.values()]
    return sum(n * known[w] for n, w in zip(times, words)) / (sum(times) + SHRINK)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, folds: int = FOLDS) -> Model:
    """Model of the labelled rows outside the held-out fold; ``most`` bounds the sample that reaches the driver."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"), folds))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    texts = documents(docs).join(F.broadcast(sample), "doc_id")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.string()), "toxic": batch.column("toxic").cast(pa.int32()),
                "index": pa.array([i.astype(np.uint16).tobytes() for i, _ in made], pa.binary()),
                "value": pa.array([v.astype(np.float16).tobytes() for _, v in made], pa.binary())})

    got = texts.mapInArrow(featurize, "doc_id string, toxic int, index binary, value binary").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    rows = [(np.frombuffer(i, np.uint16), np.frombuffer(v, np.float16)) for i, v in zip(got["index"], got["value"])]
    return train(rows, got["toxic"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row, doc_id, score`` of every whole text: ``row`` holds all given columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            texts = [t.lower().split() for t in batch.column("text").to_pylist()]
            new = list({w for words in texts for w in words if w not in known})
            for at in range(0, len(new), 50_000):
                part = new[at:at + 50_000]
                bucket, owner = subwords(part)
                known.update(zip(part, (np.bincount(owner, weights=weight[bucket]) / np.bincount(owner)).tolist()))
            means = np.array([_mean(Counter(words), known) for words in texts])
            if len(known) > HELD:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(Model(weight, bias).score(means), pa.float64())], names=["row", "doc_id", "score"])

    kind = whole.schema["row"].dataType.simpleString()
    return whole.mapInArrow(run, f"row {kind}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns as given."""
    return score(docs, fit(docs, labels, most)).filter("score < 0.5").select("row.*")


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, most))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
