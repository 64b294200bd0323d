"""Exact nearest vectors: blocks with angle ranges to pivots, met best first, left out once they can hold nothing nearer."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.plans.tables import written

#: Pivots, and the vectors they are chosen from; both reach the driver, whatever the table's size.
PIVOTS, CANDIDATES = 32, 1024
#: How many times as many blocks a query block may have met after each round.
GROWTH = 8
#: What rounding may take from a bound.
SLACK = 1e-6

BLOCK = "block string, low array<double>, high array<double>, matrix binary, keys array<{}>"


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True) if matrix.size else np.ones((len(matrix), 1))
    return matrix / np.where(norm == 0, 1, norm)


def _matrix(vec: pa.Array) -> np.ndarray:
    """Unit vectors of a list column; rows of several widths are an error."""
    width = len(vec[0])
    if pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(vec), width)).as_py():
        raise ValueError("vectors of one table differ in length")
    return _unit(vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), width))


def _angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(matrix @ pivots.T, -1, 1))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, candidates: int = CANDIDATES) -> np.ndarray:
    """Unit vectors far from each other: of the ``candidates`` rows with the least hash, each the farthest from those before."""
    rows = vectors.select("vec").orderBy(F.xxhash64("vec")).limit(candidates).collect()
    if not rows:
        return np.zeros((0, 0))
    if len({len(r["vec"]) for r in rows}) > 1:
        raise ValueError("vectors of one table differ in length")
    held = _unit(np.array([r["vec"] for r in rows], np.float64))
    chosen = [0]
    nearest = held @ held[0]
    while len(chosen) < min(pivots, len(held)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, held @ held[chosen[-1]])
    return held[chosen]


def blocks_of(table: DataFrame, key: str, pivots: np.ndarray, rows: int) -> DataFrame:
    """``table`` (key, vec) as blocks of at most ``rows`` neighbours: keys, unit vectors as float64 bytes, and the least and
    the greatest angle to each pivot.

    Rows are range-sorted by their nearest pivot, their angle to it and their key, so that a pivot which holds most rows
    is spread over tasks; a task holds one block at a time. A block has rows of one nearest pivot, which costs at most as
    many short blocks as there are pivots and tasks."""
    kind = table.schema[key].dataType.simpleString()

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                angle = _angles(_matrix(batch.column("vec")), pivots)
                home = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(angle[np.arange(len(home)), home]), *batch.columns], ["home", "angle", "key", "vec"])

    def block(part: pa.Table):
        keys, vec = (part.column(c).combine_chunks() for c in ("key", "vec"))
        matrix = _matrix(vec)
        angle = _angles(matrix, pivots)
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        low, high = (pa.array([f(angle, axis=0).tolist()], pa.list_(pa.float64())) for f in (np.min, np.max))
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), low, high, pa.array([matrix.tobytes()], pa.binary()), lists], ["block", "low", "high", "matrix", "keys"])

    def pack(batches):
        left = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            left = new if left is None else pa.concat_tables([left, new])
            home = left.column("home").to_numpy()
            ends = np.append(np.flatnonzero(home[1:] != home[:-1]) + 1, len(home))
            at = 0
            for end in ends:
                while end - at >= rows or (at < end < len(home)):
                    yield block(left.slice(at, min(rows, end - at)))
                    at += min(rows, end - at)
            left = left.slice(at)
        if left is not None and left.num_rows:
            yield block(left)

    placed = table.select(F.col(key).alias("key"), "vec").mapInArrow(place, f"home int, angle double, key {kind}, vec array<double>")
    order = ("home", "angle", "key")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, BLOCK.format(kind))


def _meetings(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(q_block, block, bound, place): the most that a vector of a block can score for a query of a query block, and the
    block's place by it. Angles are a metric, so a block whose angles to a pivot are apart from the queries' by g is at
    least g away. Only the blocks' ranges are paired here, none of their vectors."""
    pairs = held.select("block", "low", "high").crossJoin(asked.select(F.col("block").alias("q_block"), F.col("low").alias("q_low"), F.col("high").alias("q_high")))
    gap = F.greatest(F.array_max(F.zip_with("low", "q_high", lambda a, b: a - b)), F.array_max(F.zip_with("q_low", "high", lambda a, b: a - b)), F.lit(0.0))
    bounded = pairs.select("q_block", "block", F.cos(gap).alias("bound"))
    return bounded.withColumn("place", F.row_number().over(W.partitionBy("q_block").orderBy(F.desc("bound"), "block")))


def _meet(pairs: DataFrame, kind: str, k: int) -> DataFrame:
    """The best ``k`` vectors of each meeting for each of its queries: one product of two matrices a row."""

    def run(batches):
        for batch in batches:
            for ids, matrix, asked_keys, wanted in zip(*(batch.column(c) for c in ("keys", "matrix", "q_keys", "q_matrix")), strict=True):
                names, keys = np.array(ids.as_py(), object), asked_keys.as_py()
                left = np.frombuffer(wanted.as_py(), np.float64).reshape(len(keys), -1)
                scores = left @ np.frombuffer(matrix.as_py(), np.float64).reshape(len(names), -1).T
                order = np.argsort(names, kind="stable")
                top = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
                n = top.shape[1]
                each = lambda c: pa.array(np.repeat([x[c] for x in keys], n), pa.int64())  # noqa: B023, E731
                found = [pa.array(names[top.ravel()].tolist(), ids.type.value_type), pa.array(np.take_along_axis(scores, top, 1).ravel())]
                yield pa.RecordBatch.from_arrays([each("b"), each("q"), *found], ["batch_id", "q_ord", "claim_id", "score"])

    return pairs.mapInArrow(run, f"batch_id long, q_ord long, claim_id {kind}, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(best, met): the ``k`` most similar vectors of each query, as ``vector_top_k`` gives them, and the pairs of blocks
    (q_block, block, place) whose vectors were multiplied.

    Query blocks meet the blocks in order of their bounds, first one, then GROWTH times as many a round; what was found so
    far leaves out the blocks that cannot reach the k-th score of any query of the block. A round is one table of k rows a
    query; rounds grow with the logarithm of the number of blocks."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    kind = vectors.schema["claim_id"].dataType.simpleString()
    held = vectors.where(sound).select("claim_id", F.col("vec").cast("array<double>").alias("vec"))
    key = F.struct(F.col("batch_id").cast("long").alias("b"), F.col("q_ord").cast("long").alias("q"))
    asked = queries.where(sound).select(key.alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    pivots = choose_pivots(held)
    spark = vectors.sparkSession
    best = spark.createDataFrame([], f"batch_id long, q_ord long, claim_id {kind}, score double, rank int")
    if not len(pivots):
        return best, spark.createDataFrame([], "q_block string, block string, place int")
    held = written(blocks_of(held, "claim_id", pivots, block))
    asked = written(blocks_of(asked, "key", pivots, max(1, block // 4)))
    meetings = _meetings(asked, held)
    whose = asked.select(F.col("block").alias("q_block"), F.explode("keys").alias("key")).select("q_block", F.col("key.b").alias("batch_id"), F.col("key.q").alias("q_ord"))
    last = held.count()
    order = W.partitionBy("batch_id", "q_ord").orderBy(F.desc("score"), "claim_id")
    done, met = 0, meetings.select("q_block", "block", "place").limit(0)
    while done < last:
        upto = max(1, done * GROWTH)
        # a query that holds fewer than k yet wants every block
        kth = whose.join(best.where(F.col("rank") == k), ["batch_id", "q_ord"], "left").groupBy("q_block").agg(F.min(F.coalesce("score", F.lit(-2.0))).alias("least"))
        open_ = meetings.where((F.col("place") > done) & (F.col("place") <= upto)).join(kth, "q_block").where(F.col("bound") >= F.col("least") - SLACK)
        now = open_.select("q_block", "block", "place")
        pairs = now.join(asked.select(F.col("block").alias("q_block"), F.col("keys").alias("q_keys"), F.col("matrix").alias("q_matrix")), "q_block").join(held.select("block", "keys", "matrix"), "block")
        both = best.drop("rank").unionByName(_meet(pairs, kind, k))
        best = written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        met, done = met.unionByName(now), upto
    return best, met


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(batch_id, q_ord, claim_id, score, rank): the ``k`` most similar unit vectors of each query vector.

    A null or empty vector, or one with a null or NaN place, is none: such queries find nothing, such rows are not found.
    A vector of length 0 scores 0 with all; ties go by claim_id; repeated rows each count; vectors of several widths are
    an error; an empty table gives none. ``block``: vectors of one block; a query block has a quarter of them."""
    return search(vectors, queries, k, block)[0]
