"""Mentions, blocking, pair verdicts and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchora.functions.ids import entity_id
from anchora.functions.text import head_token, normalize_surface
from anchora.plans.components import components
from anchora.plans.tables import written


def collect_mentions(claims: DataFrame) -> DataFrame:
    """(mention, occurrences, n_sources, first_ord): subjects and non-null objects pooled."""
    pooled = claims.select("ord", "source_id", F.explode(F.array("subject", "object")).alias("mention")).where("mention is not null")
    return pooled.groupBy("mention").agg(F.count("*").alias("occurrences"), F.countDistinct("source_id").alias("n_sources"), F.min("ord").alias("first_ord"))


def block_survey(mentions: DataFrame) -> DataFrame:
    """One row: forms, blocks of equal normalised form, blocks of one, of several, and forms in the latter."""
    blocks = mentions.groupBy(normalize_surface(F.col("mention")).alias("block")).agg(F.countDistinct("mention").alias("n"))
    return blocks.agg(
        F.sum("n").alias("forms"), F.count("*").alias("blocks"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"),
        F.sum((F.col("n") > 1).cast("long")).alias("multi"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("collapsed"),
    )


def block_keys(mentions: DataFrame) -> DataFrame:
    """(mention, key): the normalised form and its head word; the empty key counts too."""
    return mentions.select("mention", F.explode(F.array_distinct(F.array(normalize_surface(F.col("mention")), head_token(F.col("mention"))))).alias("key"))


#: Mentions of a block that meet each other in one task.
TILE = 256


def candidate_pairs(mentions: DataFrame) -> DataFrame:
    """(left, right) with left < right for mentions that share a key. Blocks grow pairs with their square: for entities
    alone, ``lexical_entities`` needs none of them.

    A block of more than TILE mentions is cut into tiles by hash, and each pair of tiles is a group of its own in the join,
    so that no task holds a block; a mention is copied once for each tile of its block."""
    keys = written(block_keys(mentions.select("mention").distinct()))
    large = keys.groupBy("key").agg(F.ceil(F.count("*") / TILE).alias("tiles")).where("tiles > 1")
    tiled = keys.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("mention"), F.col("tiles")))
    rows = tiled.select("key", "mention", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("tiles") - 1)).alias("j"))
    columns = tiled.select("key", F.col("mention").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("i"), F.col("own").alias("j"))
    met = rows.join(columns, ["key", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("mention") < F.col("other")))
    return met.select(F.least("mention", "other").alias("left"), F.greatest("mention", "other").alias("right")).distinct()


def lexical_verdicts(pairs: DataFrame) -> DataFrame:
    """Verdicts without a model: the same where the normalised forms are equal."""
    return pairs.select("left", "right", (normalize_surface(F.col("left")) == normalize_surface(F.col("right"))).alias("same"))


def presented(verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verdicts in canonical order with a reason where their pair, either way round, was not presented."""
    v = verdicts.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "same")
    p = pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.lit(True).alias("_shown")).distinct()
    return v.join(p, ["left", "right"], "left").withColumn("reason", F.when(F.col("_shown").isNull(), "mention_not_in_pair")).drop("_shown")


def resolve_entities(mentions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(mention, entity_id, n_members): transitive closure of the accepted same-pairs; others stand alone."""
    names = mentions.select("mention").distinct()
    labels = components(verdicts.where("same").select("left", "right"))
    rooted = names.join(labels.select(F.col("id").alias("mention"), "label"), "mention", "left").select("mention", F.coalesce("label", "mention").alias("root"))
    return _entities(rooted)


def lexical_entities(mentions: DataFrame) -> DataFrame:
    """The same entities as by lexical verdicts over all pairs: equal forms are an equivalence, so one grouping does."""
    return _entities(mentions.select("mention").distinct().select("mention", normalize_surface(F.col("mention")).alias("root")))


def _entities(rooted: DataFrame) -> DataFrame:
    members = rooted.groupBy("root").agg(F.array_sort(F.collect_set("mention")).alias("mentions"))
    return members.select(entity_id(F.col("mentions")).alias("entity_id"), F.size("mentions").alias("n_members"), F.explode("mentions").alias("mention"))


def rates(tp, fp, fn) -> list:
    """precision and recall, 0.0 for an empty denominator."""
    share = lambda n, d: F.when(d == 0, F.lit(0.0)).otherwise(n / d)
    return [share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall")]


def score_pairs(gold: DataFrame, resolution: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row: tp, fp, fn, precision, recall over gold pairs (left, right, same); with ``pairs``, blocking recall too."""
    e = lambda c: resolution.select(F.col("mention").alias(c), F.col("entity_id").alias(f"_{c}"))
    g = gold.join(e("left"), "left", "left").join(e("right"), "right", "left").withColumn("_together", F.coalesce(F.col("_left") == F.col("_right"), F.lit(False)))
    n = lambda c: F.sum(c.cast("long"))
    counts = g.agg(n(F.col("same") & F.col("_together")).alias("tp"), n(~F.col("same") & F.col("_together")).alias("fp"), n(F.col("same") & ~F.col("_together")).alias("fn"))
    counts = counts.na.fill(0).select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
    if pairs is None:
        return counts
    shown = pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.lit(1).alias("_in")).distinct()
    same = gold.where("same").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).join(shown, ["left", "right"], "left")
    return counts.crossJoin(same.agg(F.coalesce(F.count("_in") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("blocking_recall")))
