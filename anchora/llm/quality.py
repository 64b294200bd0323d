"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import LOWER, Rolling, fold, text_parts

#: Words share this many vectors by hash, so the table's size does not grow with the vocabulary.
BUCKETS, WIDTH, NONZERO, WINDOW = 1 << 14, 48, 4, 2
#: Labelled rows that the network is fitted on at most, how many vector blocks are summed apart, and by how many tasks
#: each block before one task adds these up.
MAX_LABELLED, BLOCKS, SLOTS = 20_000, 16, 64

_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 others
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few non-zero entries of each bucket's random index vector."""
    rng = np.random.default_rng(7)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _tokens(offsets: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, length) of each run of one character class."""
    kind = _CLASS[buf]
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    solid = kind[start] != 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    bucket = (Rolling(LOWER[buf]).of(start, end) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.searchsorted(offsets, start, "right") - 1, end - start


def _context_sums(batches):
    """Per partition: for each block of buckets, the sums of their neighbours' index vectors and their counts."""
    places, signs = _index_vectors()
    sums, seen = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS)
    for batch in batches:
        for _, offsets, buf in text_parts(batch.column("text")):
            bucket, row, _ = _tokens(offsets, buf)
            seen += np.bincount(bucket, minlength=BUCKETS)
            for step in range(1, WINDOW + 1):
                near = row[step:] == row[:-step]
                a, b = bucket[:-step][near], bucket[step:][near]
                for x, y in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        sums += np.bincount(x * WIDTH + places[y, k], weights=signs[y, k], minlength=BUCKETS * WIDTH)
    table = np.concatenate([sums.reshape(BUCKETS, WIDTH), seen[:, None]], axis=1).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(table, BLOCKS)], pa.binary())], ["block", "data"])


def _add_blocks(batches):
    """One row for each block of a partition; rows are added as they come, so memory is that of the sums."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
            part = np.frombuffer(data.as_buffer(), np.float64)
            sums[block] = sums[block] + part if block in sums else part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "data"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of each bucket with its frequency weight in the last column, from all texts.

    Partitions add up locally, then SLOTS tasks for each block, then one; the driver gets one table of fixed size."""
    schema = "block int, data binary"
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_context_sums, schema)
    some = parts.withColumn("slot", F.spark_partition_id() % SLOTS).repartition("block", "slot").mapInArrow(_add_blocks, schema)
    rows = some.repartition("block").mapInArrow(_add_blocks, schema).collect()
    table = np.zeros((BUCKETS, WIDTH + 1))
    for r in rows:
        n = BUCKETS // BLOCKS
        table[r["block"] * n : (r["block"] + 1) * n] = np.frombuffer(r["data"], np.float64).reshape(n, WIDTH + 1)
    seen = table[:, -1]
    vectors = table[:, :-1] / np.maximum(seen[:, None], 1)
    vectors -= (vectors * seen[:, None]).sum(axis=0) / max(seen.sum(), 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weight = 1e-3 / (1e-3 + seen / max(seen.sum(), 1))
    return np.concatenate([vectors, weight[:, None]], axis=1).astype(np.float32)


def _features(vectors: np.ndarray, offsets: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Per text: weighted mean and spread of its word vectors, and a few shares that pooling loses."""
    n = len(offsets) - 1
    bucket, row, length = _tokens(offsets, buf)
    found = vectors[bucket]
    weight = found[:, -1:]
    found = found[:, :-1] * weight
    count = np.bincount(row, minlength=n)
    mean, square = np.zeros((n, WIDTH)), np.zeros((n, WIDTH))
    if len(row):
        has = np.flatnonzero(count)
        at = np.searchsorted(row, has)
        mean[has] = np.add.reduceat(found, at, axis=0)
        square[has] = np.add.reduceat(found * found, at, axis=0)
    least = np.maximum(count, 1)[:, None]
    mean, square = mean / least, square / least
    size = np.diff(offsets)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    kind = _CLASS[buf]
    share = [sums(kind == k) / np.maximum(size, 1) for k in range(4)]
    upper = sums((buf >= 65) & (buf <= 90)) / np.maximum(sums(kind == 1), 1)
    pair = np.unique(row * BUCKETS + bucket)
    distinct = np.bincount(pair // BUCKETS, minlength=n) / np.maximum(np.minimum(count, BUCKETS), 1)
    long = np.bincount(row, weights=length, minlength=n) / np.maximum(count, 1)
    shape = np.stack([*share, upper, distinct, np.log1p(size), np.log1p(long)], axis=1)
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), shape], axis=1)


class Network:
    """Two layers in numpy; its probabilities are divided by a temperature fitted on rows kept from training."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.weights = None
        if len(y) < 20 or y.min() == y.max():
            return
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        for _ in range(epochs):
            rng.shuffle(used)
            for at in range(0, len(used), 128):
                part = used[at : at + 128]
                h = np.tanh(x[part] @ w[0] + w[1])
                error = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[part]) / len(part)
                back = np.outer(error, w[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((x[part].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ error + 1e-4 * w[2], error.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] = w[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        logits = self._logits(x[held])
        loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self._logits(np.clip((x - self.mean) / self.scale, -6, 6)) / self.temperature))


def _vector_udf(vectors: np.ndarray):
    def pooled(column: pa.Array) -> pa.Array:
        rows = [x for _, offsets, buf in text_parts(column, 1 << 20) for x in _features(vectors, offsets, buf)]
        return pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(pooled, "array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_labelled: int = MAX_LABELLED) -> Network:
    """A network fitted on at most ``max_labelled`` rows of ``labels`` (doc_id, quality), the first by a hash of the id."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "quality", _vector_udf(vectors)("text").alias("x")).orderBy("doc_id").limit(2 * max_labelled).toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, 2 * WIDTH + 8))
    return Network(x, rows["quality"].to_numpy(np.float64))


def quality_score(text: Column, vectors: np.ndarray, network: Network) -> Column:
    def judge(column: pa.Array) -> pa.Array:
        parts = [network.score(_features(vectors, offsets, buf)) for _, offsets, buf in text_parts(column, 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(judge, "double")(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5); columns of these names go.

    Word vectors come from all texts, the network from the rows that ``labels`` (doc_id, quality) names. A null text
    counts as empty and is scored like any other, a very long one by one task. Equal scores of 0.5 are predicted 1. With fewer than 20 labelled rows, or one label only, all scores are
    the labels' smoothed share. Repeated rows stay; an empty table gives none."""
    vectors = word_vectors(docs)
    network = fit_quality(docs, labels, vectors, max_labelled)
    out = docs.withColumn("score", quality_score(F.col("text"), vectors, network))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 3) != 1)
    return score_quality(docs, labels).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
