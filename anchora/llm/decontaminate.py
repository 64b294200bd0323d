"""Benchmark decontamination by spaced seeds, in native column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import semi_by_id, written

_WIDE = ("111011", "10000001111")
#: By the number of replaced tokens: the least width, and masks (tokens that a seed reads are 1) of which one at least
#: fits between the replaced tokens of any window of that width or more, wherever they are.
FAMILIES = {
    1: (5, ("1111", "11011", "11101", "10111")),
    2: (10, ("110111", "11100011", "1100010011")),
    3: (15, _WIDE),
    4: (20, _WIDE),
}
#: Above this many seeds the benchmark side is shuffled, not broadcast.
BROADCAST_SEEDS = 2_000_000
#: Above this many documents with hits their ids are shuffled, not broadcast.
BROADCAST_DOCS = 200_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def masks_for(width: int, share: float) -> tuple[str, ...]:
    """Masks that hit every alignment of ``width`` tokens with a ``share`` of equal ones.

    Beyond FAMILIES it is one run: what is equal falls into one part more than what is replaced, so the longest of
    these parts has the mean's length at least."""
    replaced = max(k for k in range(width) if k == 0 or (width - k) / width >= share)
    least, masks = FAMILIES.get(replaced, (width + 1, ()))
    return masks if width >= least else ("1" * -(-(width - replaced) // (replaced + 1)),)


def seeds(rows: DataFrame, key: str, masks: list[str], use: tuple[str, ...] | None = None) -> DataFrame:
    """(key, at, seed) for each mask (of those in ``use``) at each place of the token array ``t`` where its span fits.

    Token hashes are taken once; the places are a generator, so that seeds are compiled code and no array is copied."""
    hashed = rows.select(key, F.transform("t", lambda w: F.xxhash64(w)).alias("h"))
    use = masks if use is None else use
    least = min(len(m) for m in use)
    placed = hashed.where(F.size("h") >= least).select(key, "h", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("at"))
    seed = lambda k, m: F.xxhash64(F.lit(k), *[F.get("h", F.col("at") + i) for i, bit in enumerate(m) if bit == "1"])
    fits = lambda m: F.col("at") + len(m) <= F.size("h")
    each = F.array(*[F.when(fits(m), seed(masks.index(m), m)) for m in use])
    return placed.select(key, "at", F.explode(each).alias("seed")).where("seed is not null")


def _best_window(item: str, doc: str, shift: str, window: int) -> Column:
    """(matched, width) of the best aligned window: token equality at the shift, then sums over each window."""
    equal = f"transform({item}, (w, i) -> if(i + {shift} >= 0 and get({doc}, i + {shift}) = w, 1, 0))"
    width = f"least(size({item}), {window})"
    return F.expr(f"array_max(transform(sequence(1, size({item}) - {width} + 1), s -> aggregate(slice({equal}, s, {width}), 0, (a, b) -> a + coalesce(b, 0))))")


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = 20, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, matched, width, overlap) for each document with a benchmark passage.

    Seeds of ``docs`` (doc_id, text) and ``items`` (item_id, text) meet; each hit fixes an alignment, and a passage
    counts where some window of ``window`` tokens (all of a shorter item) has a ``share`` of equal tokens, so replaced
    words don't hide it. The masks of each width (masks_for) hit every such alignment. Null and empty texts match
    nothing; repeated rows give one row for each pair of ids; empty tables give none; other columns are ignored."""
    bench = written(items.select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0))
    width = F.least(F.size("t"), F.lit(window))
    families = {}
    for r in bench.select(width.alias("n")).distinct().collect():  # at most ``window`` rows
        families.setdefault(masks_for(r["n"], share), []).append(r["n"])
    families = families or {masks_for(window, share): [window]}
    masks = sorted({m for use in families for m in use})
    d = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    probe = reduce(DataFrame.union, [seeds(bench.where(width.isin(widths)), "item_id", masks, use) for use, widths in families.items()])
    n_seeds = bench.agg(F.sum(F.size("t"))).first()[0] or 0
    probe = probe.withColumnRenamed("at", "item_at")
    if n_seeds * len(masks) <= BROADCAST_SEEDS:
        probe = F.broadcast(probe)
    hits = seeds(d, "doc_id", masks).join(probe, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = written(hits.distinct())
    sized = hits.join(bench.select("item_id", F.size("t").alias("n")), "item_id")
    n_docs = hits.select("doc_id").distinct().count()
    ids = hits.select("doc_id").distinct()
    if n_docs <= BROADCAST_DOCS:
        ids = F.broadcast(ids)
    ids = ids.withColumnRenamed("doc_id", "_wanted")
    some = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    # a row for each hit, so that no document's hits are gathered; each keeps the item's length of the document only
    some = some.select(F.col("doc_id").alias("hit_id"), tokens(F.col("text")).alias("doc"))
    aligned = some.join(sized, F.col("doc_id").eqNullSafe(F.col("hit_id")))
    aligned = aligned.select("doc_id", "item_id", F.slice("doc", F.greatest(F.col("shift") + 1, F.lit(1)), F.col("n")).alias("doc"), F.least("shift", F.lit(0)).alias("from"))
    joined = aligned.join(bench, "item_id").withColumn("matched", _best_window("t", "doc", "`from`", window))
    scored = joined.select("doc_id", "item_id", "matched", F.least(F.size("t"), F.lit(window)).alias("width"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("width").alias("width"))
    return best.withColumn("overlap", F.col("matched") / F.col("width")).where(F.col("overlap") >= share)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 20, share: float = 0.8) -> DataFrame:
    """``docs`` without those in which a benchmark passage is found; all columns stay."""
    return semi_by_id(docs, find_overlaps(docs, items, window, share), anti=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
