"""Audits of answers, their failures, and of the judges themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.functions.text import extract_markers, plausible_query_terms
from anchora.operators.grounding import INCOMPLETE, PARSE, PROVIDER
from anchora.operators.retrieve import find_claims, merge_round_robin
from anchora.plans.tables import written


#: Why a judge gave no verdict; any other reason counts as unscored.
FAILURES = (PROVIDER, PARSE, INCOMPLETE)


def citation_audit(answers: DataFrame) -> DataFrame:
    """Answers (case_id, answer, gathered: array of claim ids) with marked, unknown and unused ids, the last two sorted."""
    marked = F.array_distinct(extract_markers(F.col("answer")))
    return answers.withColumns(
        {"marked": marked, "unknown": F.array_sort(F.array_except(marked, F.col("gathered"))), "unused": F.array_sort(F.array_except(F.col("gathered"), marked))}
    )


def audit_answers(answers: DataFrame, cases: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (case, criterion) with status, all gating: non_empty, citation_integrity, required_evidence_present.

    answers: (case_id, answer, cited: array of (claim_id, source_id)); cases: (case_id and the arrays must_include_claims,
    must_include_any_claims, must_include_sources, must_include_any_sources); sources: (id). Integrity fails on a marker
    whose claim is not cited, on a claim cited twice and on a source that the corpus lacks. A case that requires nothing
    is not evaluated for evidence; a null array requires nothing."""
    ids = lambda field: F.transform("cited", lambda c: c[field])
    a = citation_audit(answers.withColumn("gathered", ids("claim_id")))
    known = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("known")).distinct()
    lost = answers.select("case_id", F.explode(F.array_distinct(ids("source_id"))).alias("source_id")).join(known, "source_id", "left_anti")
    a = a.join(lost.select("case_id", F.lit(True).alias("lost")).distinct(), "case_id", "left").join(cases, "case_id")
    none = F.array().cast("array<string>")
    need = {n: F.coalesce(F.col(n), none) for n in ("must_include_claims", "must_include_any_claims", "must_include_sources", "must_include_any_sources")}
    all_of = lambda n, have: F.size(F.array_except(need[n], have)) == 0
    any_of = lambda n, have: (F.size(need[n]) == 0) | F.arrays_overlap(need[n], have)
    claims, cited_sources = F.col("gathered"), ids("source_id")
    whole = (F.size("unknown") == 0) & (F.size(F.array_distinct("gathered")) == F.size("gathered")) & F.col("lost").isNull()
    present = all_of("must_include_claims", claims) & any_of("must_include_any_claims", claims) & all_of("must_include_sources", cited_sources) & any_of("must_include_any_sources", cited_sources)
    asked = sum((F.size(c) for c in need.values()), F.lit(0)) > 0
    status = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    checks = {"non_empty": status(F.regexp_replace("answer", r"(?U)\s", "") != ""), "citation_integrity": status(whole), "required_evidence_present": F.when(~asked, "not_evaluated").otherwise(status(present))}
    rows = [F.struct(F.lit(k).alias("name"), c.alias("status")) for k, c in checks.items()]
    return a.select("case_id", F.explode(F.array(*rows)).alias("c")).select("case_id", "c.name", F.lit("gating").alias("kind"), "c.status", F.lit(None).cast("double").alias("score"))


def case_verdicts(criteria: DataFrame) -> DataFrame:
    """(case_id, passed): false where any gating criterion failed."""
    return criteria.groupBy("case_id").agg((~F.bool_or((F.col("kind") == "gating") & (F.col("status") == "fail"))).alias("passed"))


def case_report(criteria: DataFrame, cases: DataFrame) -> DataFrame:
    """(intent, passed, total, rate), and a row for all cases with a null intent."""
    v = case_verdicts(criteria).join(cases.select("case_id", "intent"), "case_id")
    n = F.sum(F.col("passed").cast("long"))
    return v.rollup("intent").agg(n.alias("passed"), F.count("*").alias("total"), (n / F.count("*")).alias("rate"))


def advisory_means(criteria: DataFrame) -> DataFrame:
    return criteria.where("kind = 'advisory' and score is not null").groupBy("name").agg(F.avg("score").alias("mean_score"))


def judge_variability(trials: DataFrame) -> DataFrame:
    """Per case and criterion: trials with a score, their range, mean and spread (null for one)."""
    n = F.count("score")
    return trials.groupBy("case_id", "criterion").agg(
        n.alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean"), F.when(n > 1, F.stddev_pop("score")).alias("spread")
    )


def calibration_report(trials: DataFrame) -> DataFrame:
    """Per criterion, over trials (fixture_id, criterion, human, status, score, failure) with a human verdict of pass or
    fail: how many were judged at all, agreements, false passes and fails, and by reason those that were not evaluated;
    the share of agreements among all; fixtures whose status (not_evaluated included) changes; fixtures with more than
    one score, and the mean spread within these."""
    t = trials.where("human is not null and human <> 'not_applicable'")
    n = lambda c: F.sum(c.cast("long"))
    per = t.groupBy("criterion", "fixture_id").agg(F.countDistinct("status").alias("statuses"), F.count("score").alias("scores"), F.stddev_pop("score").alias("spread"))
    repeated = F.col("scores") > 1
    flips = per.groupBy("criterion").agg(n(F.col("statuses") > 1).alias("verdict_flips"), n(repeated).alias("fixtures_with_repeats"), F.avg(F.when(repeated, F.col("spread"))).alias("mean_spread"))
    missing = F.col("status") == "not_evaluated"
    agrees = ~missing & (F.col("status") == F.col("human"))
    false_pass = ~missing & ~agrees & (F.col("status") == "pass") & (F.col("human") == "fail")
    reason = F.coalesce("failure", F.lit(""))
    base = t.groupBy("criterion").agg(
        F.count("*").alias("judged"), n(agrees).alias("agree"), n(false_pass).alias("false_pass"), n(~missing & ~agrees & ~false_pass).alias("false_fail"),
        *(n(missing & (reason == f)).alias(f) for f in FAILURES), n(missing & ~reason.isin(*FAILURES)).alias("unscored"),
    )
    return base.join(flips, "criterion").withColumn("agreement_rate", F.col("agree") / F.col("judged"))


def split_leakage(fixtures: DataFrame) -> DataFrame:
    """Fixtures derived from one of another split."""
    f, o = fixtures.alias("f"), fixtures.alias("o")
    return f.join(o, F.expr("f.derived_from = o.fixture_id and f.split <> o.split")).select("f.fixture_id", "f.split", F.col("o.fixture_id").alias("origin"), F.col("o.split").alias("origin_split"))


def unapproved_fixtures(fixtures: DataFrame) -> DataFrame:
    return fixtures.where("approved_by is null or trim(approved_by) = ''")


def reachability(questions: DataFrame, claims: DataFrame, limit: int = 12) -> DataFrame:
    """(case_id, claim_id) that some plausible term of the question retrieves alone, or all terms as one batch."""
    terms = questions.select("case_id", F.posexplode(plausible_query_terms(F.col("question"))).alias("q_ord", "query"))
    queries = terms.select(F.col("case_id").alias("batch_id"), "q_ord", "query")
    hits = written(find_claims(claims, queries, limit))
    batch = merge_round_robin(hits.where("rank <= 5"), limit)
    return hits.select(F.col("batch_id").alias("case_id"), "claim_id").union(batch.select("batch_id", "claim_id")).distinct()


def classify_failures(cases: DataFrame, answers: DataFrame, reachable: DataFrame) -> DataFrame:
    """(case_id, claim_id, class) of required claims. Not gathered: A where some plausible term reaches the claim, else B;
    an any-of group counts as one and is listed whole only where none of it was gathered. Gathered but not marked in the
    answer: C, for claims that are each required.

    cases: (case_id, must_include_claims, must_include_any_claims); answers: (case_id, answer, gathered); reachable:
    (case_id, claim_id)."""
    a = citation_audit(answers).join(cases.select("case_id", "must_include_claims", "must_include_any_claims"), "case_id")
    none = F.array().cast("array<string>")
    each, some = F.coalesce("must_include_claims", none), F.coalesce("must_include_any_claims", none)
    group = F.when(F.arrays_overlap(some, F.col("gathered")), none).otherwise(some)
    missing = a.select("case_id", F.explode(F.array_union(F.array_except(each, F.col("gathered")), group)).alias("claim_id"))
    found = reachable.select("case_id", "claim_id", F.lit(True).alias("_found")).distinct()
    missing = missing.join(found, ["case_id", "claim_id"], "left").select("case_id", "claim_id", F.when(F.col("_found"), "A").otherwise("B").alias("class"))
    unused = a.select("case_id", F.explode(F.array_intersect(each, F.col("unused"))).alias("claim_id"), F.lit("C").alias("class"))
    return missing.union(unused)


def draft_labels(results: DataFrame) -> DataFrame:
    """Judge results as draft human verdicts."""
    return results.withColumn("human", F.when(F.col("status") == "not_evaluated", "not_applicable").otherwise(F.col("status")))


def layer_coverage(layers: DataFrame) -> DataFrame:
    """(layer, authored, total)."""
    return layers.groupBy("layer").agg(F.sum((F.col("status") == "authored").cast("long")).alias("authored"), F.count("*").alias("total"))


def first_appearance(rows: DataFrame, group: str, key: str, position: str) -> DataFrame:
    """Ordinals from 1 of the distinct keys of a group by where each is first seen."""
    first = rows.groupBy(group, key).agg(F.min(position).alias("first"))
    return first.withColumn("ordinal", F.dense_rank().over(W.partitionBy(group).orderBy("first", key)))
