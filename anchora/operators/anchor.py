"""Quotes anchored to their source, claims extracted from model replies, and checks of what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchora.functions.ids import claim_id
from anchora.functions.text import bracket_repair, normalise_concepts, squeeze
from anchora.plans.tables import large

#: Closed vocabularies of a claim (fixed values).
PREDICATES = ("is", "causes", "expresses", "requires", "contrasts_with", "makes", "creates", "undoes", "other")
POLARITIES = ("affirmed", "negated")
MODES = ("assertion", "normative", "conditional", "question")
ATTRIBUTIONS = ("course", "ego", "others", "hypothetical")
_REQUIRED = {"subject": None, "verb_phrase": None, "evidence": None, "predicate": PREDICATES, "polarity": POLARITIES, "mode": MODES, "attribution": ATTRIBUTIONS}


def anchor_evidence(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """``candidates`` (source_id, evidence) with evidence_start, evidence_end and reason (null where anchored)."""
    s = sources.select(F.col("id").alias("source_id"), F.col("text").alias("_text"))
    both = candidates.join(large(s), "source_id", "left")
    first = F.coalesce(F.expr("locate(evidence, _text)"), F.lit(0))
    again = F.coalesce(F.expr("locate(evidence, _text, locate(evidence, _text) + 1)"), F.lit(0))
    blank = F.coalesce(squeeze(F.col("evidence")) == "", F.lit(True))
    reason = F.when(blank | (first == 0), "not_found").when(again > 0, "ambiguous")
    out = both.withColumn("reason", reason)
    start = F.when(F.col("reason").isNull(), first - 1)
    return out.withColumns({"evidence_start": start, "evidence_end": start + F.length("evidence")}).drop("_text")


def anchor_guard(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims whose source is unknown, whose span is out of bounds or no longer reads ``evidence``, with the problem."""
    s = sources.select(F.col("id").alias("source_id"), F.col("text").alias("_text"))
    text = F.expr("substring(_text, evidence_start + 1, evidence_end - evidence_start)")
    problem = (
        F.when(F.col("_text").isNull(), "unknown_source")
        .when((F.col("evidence_start") < 0) | (F.col("evidence_end") > F.length("_text")) | (F.col("evidence_start") >= F.col("evidence_end")), "out_of_bounds")
        .when(text != F.col("evidence"), "changed")
    )
    return claims.join(s, "source_id", "left").withColumn("problem", problem).where("problem is not null").drop("_text")


def parse_claim_replies(replies: DataFrame) -> DataFrame:
    """(key, status, cand_ord and the candidate's fields): the claims of each model reply.

    One wrong type, missing field or unknown value fails the whole key, which then has one row with status ``failed``.
    JSON types are those of the text: a number is no string."""
    fields = ("subject", "verb_phrase", "object", "predicate", "polarity", "mode", "attribution", "evidence")
    # an item's fields are taken out of it at once; free text is read with its JSON type, and no other type reads as an allowed word
    text = [f for f in fields if not _REQUIRED.get(f)]
    value = lambda c, f: F.try_variant_get(c[f], "$", "string")
    kind = lambda c, f: F.coalesce(F.schema_of_variant(c[f]), F.lit("VOID")).alias(f"{f}_type")
    typed = lambda c: F.struct(*(value(c, f).alias(f) for f in fields), *(kind(c, f) for f in text))
    item = f"array<struct<{', '.join(f'{f}: variant' for f in fields)}>>"
    items = F.try_variant_get(F.try_parse_json(bracket_repair(F.col("reply"))), "$.claims", item)
    r = replies.select("key", F.transform(items, typed).alias("items"))

    def valid(c):
        good = c["object_type"].isin("STRING", "VOID")
        for field, allowed in _REQUIRED.items():
            good = good & (F.coalesce(c[field].isin(*allowed), F.lit(False)) if allowed else c[f"{field}_type"] == "STRING")
        return good

    candidate = lambda c, i: F.struct(F.lit("candidate").alias("status"), i.cast("int").alias("cand_ord"), *(c[f].alias(f) for f in fields))
    none = F.lit(None).cast("string")
    failed = F.array(F.struct(F.lit("failed").alias("status"), F.lit(None).cast("int").alias("cand_ord"), *(none.alias(f) for f in fields)))
    ok = F.col("items").isNotNull() & F.coalesce(F.forall("items", valid), F.lit(False))
    return r.select("key", F.explode(F.when(ok, F.transform("items", candidate)).otherwise(failed)).alias("c")).select("key", "c.*")


def extract_claims(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """One outcome table of replies (key = source id): status claim (with claim_id and span), rejected (with reason) or failed."""
    parsed = parse_claim_replies(replies).withColumnRenamed("key", "source_id")
    found = anchor_evidence(parsed, sources)
    status = F.when(F.col("status") == "failed", "failed").when(F.col("reason").isNotNull(), "rejected").otherwise("claim")
    found = found.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "rejected", F.col("reason")))
    new_id = claim_id(*(F.col(c) for c in ("source_id", "evidence", "subject", "predicate", "object", "polarity", "mode", "attribution")))
    return found.withColumn("claim_id", F.when(F.col("status") == "claim", new_id))


def extraction_summary(outcomes: DataFrame) -> DataFrame:
    """(status, reason, n)."""
    return outcomes.groupBy("status", "reason").agg(F.count("*").alias("n"))


def parse_concept_replies(replies: DataFrame) -> DataFrame:
    """(key, concepts): null where the reply is not {"concepts": [strings]}."""
    v = F.try_parse_json(F.col("reply"))
    items = F.try_variant_get(v, "$.concepts", "array<variant>")
    good = F.coalesce(F.forall(items, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    return replies.select("key", F.when(good, normalise_concepts(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))).alias("concepts"))


def parse_verdict_replies(replies: DataFrame) -> DataFrame:
    """(key, left, right, same): rows of {"verdicts": [{left, right, same}]} whose types are strict; others are left out."""
    v = F.try_parse_json(F.col("reply"))
    rows = replies.select("key", F.explode(F.try_variant_get(v, "$.verdicts", "array<variant>")).alias("c"))
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("c", f"$.{f}", "variant")), F.lit("VOID"))
    rows = rows.where((kind("left") == "STRING") & (kind("right") == "STRING") & (kind("same") == "BOOLEAN"))
    return rows.select("key", *(F.try_variant_get("c", f"$.{f}", t).alias(f) for f, t in (("left", "string"), ("right", "string"), ("same", "boolean"))))


def reanchor(claims: DataFrame, mapping: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims moved to their new source ids (mapping: source_id, new_id), their stored quotes anchored again."""
    moved = claims.drop("evidence_start", "evidence_end").join(mapping, "source_id", "left").withColumn("source_id", F.coalesce("new_id", "source_id")).drop("new_id")
    return anchor_evidence(moved, sources)
