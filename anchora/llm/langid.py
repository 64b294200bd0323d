"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import fold, text_parts

#: N-grams kept in a language's profile, and taken from a document.
PROFILE, ORDERS = 400, (1, 2, 3)
#: Text bytes looked at together; one longer text stands alone.
PART_BYTES = 256 << 10


def _grams(offsets: np.ndarray, buf: np.ndarray, row_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key << 24 | n-gram) values of the texts and their counts. N-grams are of 1 to 3 UTF-8 bytes of
    lower-cased text; each run of bytes below 0x80 that are no letters counts as one blank."""
    letter = (buf >= 128) | ((buf >= 97) & (buf <= 122))
    first = np.zeros(len(buf), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= first
    text = np.where(letter, buf, np.uint8(32))[keep]
    row, first = np.repeat(row_key.astype(np.uint64) << np.uint64(24), np.diff(offsets))[keep], first[keep]
    found, gram = [], text.astype(np.uint32)
    for n in ORDERS:
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | text[n - 1 :]
        crosses = [first[k : len(first) - n + 1 + k] for k in range(1, n)]  # a text begins inside the n-gram
        inside = ~np.logical_or.reduce(crosses) if crosses else text != 32
        found.append(row[n - 1 :][inside] | gram[inside])
    values = np.sort(np.concatenate(found))
    if not len(values):
        return values, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(np.append(at, len(values)))


def _count_grams(batches):
    """Per partition: (lang, gram, n)."""
    langs: dict[str, int] = {}
    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def add_up() -> None:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        held[:] = [(keys, np.bincount(back, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64))]

    for batch in batches:
        codes = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], np.uint64)
        for first, offsets, buf in text_parts(batch.column("text"), PART_BYTES):
            held.append(_grams(offsets, buf, codes[first : first + len(offsets) - 1]))
            if sum(len(k) for k, _ in held[1:]) > len(held[0][0]) + 500_000:
                add_up()
    add_up()
    keys, sums = held[0]
    names = np.array(list(langs), dtype=object)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names[(keys >> np.uint64(24)).astype(np.int64)] if len(keys) else [], pa.string()), pa.array((keys & np.uint64(0xFFFFFF)).astype(np.int64)), pa.array(sums)], ["lang", "gram", "n"]
    )


def train_profiles(samples: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each lang of ``samples`` (text, lang), ties by n-gram.

    All samples are counted; only ``size`` n-grams for each language reach the driver."""
    rows = samples.where(F.col("lang").isNotNull()).select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), "lang")
    counts = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, size).alias("top"))
    return {r["lang"]: [g["gram"] for g in r["top"]] for r in best.orderBy("lang").collect()}


def predict_language(text: Column, profiles: dict[str, list[int]], size: int = PROFILE) -> Column:
    """struct(lang, score): the profile at the least out-of-place distance from the text's ``size`` most frequent
    n-grams (ties: the first lang by name), and one less the distance over the largest one possible.

    A text that is null or has no letter gets ``und`` and 0, as does any text when there are no profiles."""
    names = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.uint64)
    ranks = np.full((len(names), len(grams) + 1), size, np.int32)
    for k, name in enumerate(names):
        ranks[k, np.searchsorted(grams, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def judge(column: pa.Array) -> pa.Array:
        langs, scores = [], []
        for _, offsets, buf in text_parts(column, PART_BYTES):
            n_rows = len(offsets) - 1
            keys, n = _grams(offsets, buf, np.arange(n_rows))
            row = (keys >> np.uint64(24)).astype(np.int64)
            order = np.lexsort((-n, row))  # stable: equal counts stay in n-gram order
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < size
            row, gram, rank = row[order][top], (keys & np.uint64(0xFFFFFF))[order][top], rank[top]
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            at[grams[at] != gram] = len(grams)  # in no profile
            total = np.empty((len(names), n_rows))
            for k in range(len(names)):
                there = ranks[k, at]
                total[k] = np.bincount(row, weights=np.where(there < size, np.abs(there - rank), size), minlength=n_rows)
            most = np.maximum(np.bincount(row, minlength=n_rows) * size, 1)
            best = np.argmin(total, axis=0)
            langs.append(best)
            scores.append(1 - total[best, np.arange(n_rows)] / most)
        best, score = np.concatenate(langs) if langs else np.zeros(0, int), np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(np.array(names, object)[best], pa.string()), pa.array(score)], ["lang", "score"])

    unknown = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if not names:
        return unknown
    judged = F.arrow_udf(judge, "lang string, score double")(F.lower(F.coalesce(text, F.lit(""))))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), judged).otherwise(unknown)


def identify_language(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced), profiles learnt from ``samples``.

    One row for each row, repeats included; an empty table gives none."""
    profiles = train_profiles(samples)
    found = docs.withColumn("_found", predict_language(F.col("text"), profiles))
    return found.withColumns({"lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")


def keep_known_languages(docs: DataFrame, samples: DataFrame, min_score: float = 0.2) -> DataFrame:
    """``docs`` without texts that have no letter, or are far from every language of ``samples``; columns stay.

    Without any samples there is nothing to reject by but the missing letters."""
    profiles = train_profiles(samples)
    if not profiles:
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    return docs.where(predict_language(F.col("text"), profiles)["score"] >= min_score)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify_language(docs.select("doc_id", "text"), docs.where(fold(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
