"""Surveys of a claim corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchora.functions.text import HINGE, claim_triple, normalize_surface
from anchora.operators.anchor import ATTRIBUTIONS, MODES, PREDICATES
from anchora.operators.retrieve import containing


def attribution_survey(claims: DataFrame) -> DataFrame:
    return claims.groupBy("attribution").agg(F.count("*").alias("n_claims"), F.countDistinct("source_id").alias("n_sources"))


def other_voices(claims: DataFrame) -> DataFrame:
    """(claim_id, attribution, triple) of claims that the course does not make in its own name."""
    return claims.where("attribution <> 'course'").select("claim_id", "attribution", claim_triple(*(F.col(c) for c in ("subject", "predicate", "object", "polarity"))).alias("triple"))


def scope_buckets(verdicts: DataFrame) -> DataFrame:
    """(bucket, n, n_answers): assertions (answer_id, assertion, bucket) by how far their citations support them."""
    return verdicts.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("answer_id").alias("n_answers"))


def other_verbs(claims: DataFrame) -> DataFrame:
    """Normalised verbs of the catch-all predicate."""
    verb = normalize_surface(F.col("verb_phrase")).alias("verb")
    return claims.where("predicate = 'other'").groupBy(verb).agg(F.count("*").alias("n_claims"), F.countDistinct("source_id").alias("n_sources"))


def participation(claims: DataFrame, resolution: DataFrame) -> DataFrame:
    """Per entity: claims out and in, negated ones, and a count for each predicate, mode and attribution."""
    r = lambda c: resolution.select(F.col("mention").alias(c), "entity_id")
    ends = claims.join(r("subject"), "subject").withColumn("way", F.lit("out")).unionByName(claims.join(r("object"), "object").withColumn("way", F.lit("in")))
    n = lambda c: F.sum(c.cast("long"))
    return ends.groupBy("entity_id").agg(
        n(F.col("way") == "out").alias("n_out"), n(F.col("way") == "in").alias("n_in"), n(F.col("polarity") == "negated").alias("n_negated"),
        *(n(F.col(c) == v).alias(f"n_{v}") for c, values in (("predicate", PREDICATES), ("mode", MODES), ("attribution", ATTRIBUTIONS)) for v in values),
    )


def qualified_uses(claims: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per concept: claims whose subject holds it, and how many of them are conditional or negated."""
    c = concepts.select(F.lower("concept").alias("concept")).distinct()
    hit = containing(claims.withColumn("_text", F.lower("subject")), c.where("concept <> ''").withColumn("needle", F.col("concept")), "_text")
    n = lambda x: F.sum(x.cast("long"))
    return hit.groupBy("concept").agg(F.count("*").alias("n_claims"), n(F.col("mode") == "conditional").alias("n_conditional"), n(F.col("polarity") == "negated").alias("n_negated"))


def rerouted_descriptions(claims: DataFrame, concept: str) -> DataFrame:
    """Conditional claims about the concept whose quote hinges on a condition and whose predicate is not requires."""
    return claims.where((F.lower("subject") == concept.lower()) & F.col("evidence").rlike(HINGE) & (F.col("mode") == "conditional") & (F.col("predicate") != "requires"))


def repeat_runs(runs: DataFrame) -> DataFrame:
    """Spread of the true positives over repeated runs."""
    return runs.groupBy("config").agg(F.avg("tp").alias("mean"), F.stddev_samp("tp").alias("stdev"), F.min("tp").alias("least"), F.max("tp").alias("most"))


def content_hash(table: DataFrame, order: list[str]) -> DataFrame:
    """One row, the hash of all rows: SHA-256 over their number and the sums of four parts of their own SHA-256 hashes.

    Sums do not depend on the rows' order and are added up before the shuffle, so no task gathers hashes. A null counts as
    a value of its own."""
    row = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\0NULL\0")) for c in order)), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 13 * k, 13), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = table.select(row.alias("h")).agg(F.count("*").cast("string").alias("n"), *(F.coalesce(part(k), F.lit("0")).alias(f"s{k}") for k in range(4)))
    return sums.select(F.sha2(F.concat_ws(":", "n", *(f"s{k}" for k in range(4))), 256).alias("content_hash"))


def passages_hash(sources: DataFrame) -> DataFrame:
    """One row, the hash of all passages' ids and texts."""
    return content_hash(sources, ["id", "text"])
