"""Derived entries: rules, matching and scores."""

import itertools
import random

from pyspark.sql import functions as F

from anchora.operators import derived
from anchora.sources import runs

SIG = "struct<subject:string,predicate:string,object:string,polarity:string,mode:string,attribution:string>"
SCHEMA = (
    f"source_id string, variant_id string, annotation_id string, kind string, evidence string, support string, resolution string, condition_text string, scope string, attaches_to {SIG}, mention string, referent string, "
    f"base_concept string, reframed_proposition {SIG}, reframed_mode string, description_text string, describes string, start int, end int"
)
NAMES = [c.split()[0] for c in SCHEMA.replace(SIG, "x").split(", ")]


def entries(spark, rows):
    base = dict.fromkeys(NAMES) | {"source_id": "s", "evidence": "e", "support": "literal", "resolution": "resolved", "start": 0, "end": 5}
    return spark.createDataFrame([tuple((base | r)[n] for n in NAMES) for r in rows], SCHEMA)


def test_entry_rules(spark):
    rows = [
        {"annotation_id": "ok", "kind": "occurrence", "base_concept": "x"},
        {"annotation_id": "extra", "kind": "occurrence", "base_concept": "x", "mention": "m"},
        {"annotation_id": "less", "kind": "occurrence", "scope": " "},
        {"annotation_id": "ref", "kind": "resolved_reference", "mention": "it"},
    ]
    got = {(r["annotation_id"], r["violation"]) for r in derived.entry_violations(entries(spark, rows)).collect()}
    assert got == {("extra", "forbidden mention"), ("less", "missing base_concept"), ("less", "blank scope"), ("ref", "resolved without referent")}


def test_bundles_links_and_decisions(spark):
    rows = [
        {"annotation_id": "a", "kind": "occurrence", "base_concept": "x"},
        {"annotation_id": "a", "kind": "occurrence", "base_concept": "x", "variant_id": "v"},
        {"annotation_id": "d", "kind": "description", "description_text": "t", "describes": "a"},
        {"annotation_id": "d2", "kind": "description", "description_text": "t", "describes": "d"},
        {"annotation_id": "d3", "kind": "description", "description_text": "t", "describes": "none", "source_id": "z"},
    ]
    e = entries(spark, rows)
    passages = spark.createDataFrame([("s",)], "id string")
    assert {tuple(r) for r in derived.bundle_violations(e, passages).collect()} == {("s", "repeated entry"), ("z", "unknown passage")}
    assert {(r["annotation_id"], r["violation"]) for r in derived.link_violations(e).collect()} == {("d2", "target is a description"), ("d3", "no target")}
    decisions = spark.createDataFrame([("a", "accept"), ("d", "skip")], "annotation_id string, decision string")
    assert {r["annotation_id"] for r in derived.apply_decisions(e, decisions).collect()} == {"a"}


def test_matching_is_best():
    rnd = random.Random(2)
    for _ in range(200):
        n, m = rnd.randint(1, 4), rnd.randint(1, 4)
        edges = {(a, b): rnd.randint(1, 9) for a in range(n) for b in range(m) if rnd.random() < 0.6}
        got = derived.best_matching([(a, b, w) for (a, b), w in edges.items()])
        best = max(sum(edges.get((a, p[a]), 0) for a in range(n)) for p in itertools.permutations(range(max(n, m)), n))
        assert sum(edges[x] for x in got) == best
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)


def test_fidelity(spark):
    gold = [
        {"annotation_id": "g1", "kind": "occurrence", "base_concept": "The Ego.", "variant_id": "a"},
        {"annotation_id": "g2", "kind": "occurrence", "base_concept": "love", "variant_id": "b"},
        {"annotation_id": "g3", "kind": "description", "description_text": "t", "describes": "g1", "variant_id": "a", "start": 2, "end": 9},
    ]
    pred = [
        {"annotation_id": "p1", "kind": "occurrence", "base_concept": "ego"},
        {"annotation_id": "p2", "kind": "occurrence", "base_concept": "love", "start": 1},
        {"annotation_id": "p3", "kind": "description", "description_text": "t", "describes": "p1", "start": 3, "end": 8},
    ]
    got = {r["kind"]: (r["variant_id"], r["tp"], r["fp"], r["fn"]) for r in derived.fidelity(entries(spark, pred), entries(spark, gold)).collect()}
    assert got == {"occurrence": ("a", 1, 1, 0), "description": ("a", 1, 0, 0)}
    perfect = derived.fidelity(entries(spark, gold[:1] + gold[2:]), entries(spark, gold)).collect()
    assert all(r["precision"] == r["recall"] == 1.0 for r in perfect)


def test_references_conditions_and_unsupported(spark):
    sig = ("The Ego", "is", "fear.", "affirmed", "assertion", "course")
    gold = [
        {"annotation_id": "g1", "kind": "condition", "condition_text": "If so,", "scope": "x", "attaches_to": sig},
        {"annotation_id": "g2", "kind": "resolved_reference", "evidence": "take this gesture", "mention": "this", "referent": "love", "start": 100, "end": 117},
        {"annotation_id": "g3", "kind": "resolved_reference", "evidence": "and it is", "mention": "it", "resolution": "unresolved", "start": 200, "end": 209},
        {"annotation_id": "g4", "kind": "resolved_reference", "evidence": "and he is", "mention": "he", "resolution": "unresolved", "start": 300, "end": 309},
        {"annotation_id": "g5", "kind": "resolved_reference", "evidence": "so they say", "mention": "they", "referent": "all", "start": 400, "end": 411},
    ]
    pred = [
        {"annotation_id": "p1", "kind": "condition", "condition_text": "if so", "scope": "y", "attaches_to": ("ego", "is", "fear", "affirmed", "assertion", "course")},
        {"annotation_id": "p2", "kind": "resolved_reference", "evidence": "take this gesture", "mention": "this gesture", "referent": "love", "start": 100, "end": 117},
        {"annotation_id": "p3", "kind": "resolved_reference", "evidence": "it is", "mention": "it", "resolution": "unresolved", "start": 204, "end": 209},
        {"annotation_id": "p4", "kind": "resolved_reference", "evidence": "and he is", "mention": "he", "referent": "x", "start": 300, "end": 309},
        {"annotation_id": "p5", "kind": "resolved_reference", "evidence": "so they say", "mention": "they", "referent": "All.", "start": 400, "end": 411},
        {"annotation_id": "p6", "kind": "occurrence", "base_concept": "z", "start": 900, "end": 910},
    ]
    rows = derived.fidelity(entries(spark, pred), entries(spark, gold), spark.createDataFrame([("s",)], "source_id string")).collect()
    got = {r["kind"]: r.asDict() for r in rows}
    c, r, o = got["condition"], got["resolved_reference"], got["occurrence"]
    assert (c["tp"], c["fp"], c["fn"], c["fully_correct"], c["content_matches"], c["scope_matches"], c["attachment_matches"], c["unsupported"]) == (1, 0, 0, 0, 1, 0, 1, 1)
    assert (r["tp"], r["aligned"], r["fully_correct"], r["referent_matches"], r["abstention"], r["unsupported_resolution"], r["unsupported"]) == (4, 4, 2, 1, 1, 1, 2)
    assert (o["tp"], o["fp"], o["fn"], o["recall"], o["unsupported"]) == (0, 1, 0, None, 1)
    report = {x["dimension"]: (x["tp"], x["fp"], x["fn"]) for x in derived.fidelity_report(derived.fidelity(entries(spark, pred), entries(spark, gold))).collect()}
    assert report == {"condition": (1, 0, 0), "reference": (4, 0, 0), "qualification": (0, 1, 0)}


def test_gold_is_checked_as_a_whole_and_published(spark, tmp_path):
    import pytest

    good = entries(spark, [{"annotation_id": "a", "kind": "occurrence", "base_concept": "x", "evidence": "love"}])
    sources = spark.createDataFrame([("s", "all love is here"), ("t", "aa")], "id string, text string")
    assert derived.gold_violations(good, sources).count() == 0
    derived.publish_gold(good, sources, str(tmp_path / "gold"))
    assert [(r["start"], r["end"]) for r in runs.read_committed(spark, str(tmp_path / "gold"), "gold")["entries"].collect()] == [(4, 8)]
    bad = entries(spark, [{"annotation_id": "b", "kind": "occurrence", "evidence": "is"}, {"annotation_id": "c", "kind": "description", "description_text": "t", "describes": "none", "evidence": "l"}])
    found = {(r["annotation_id"], r["violation"]) for r in derived.gold_violations(bad, sources).collect()}
    assert found == {("b", "missing base_concept"), ("c", "evidence ambiguous"), ("c", "no target")}
    with pytest.raises(ValueError):
        derived.publish_gold(bad, sources, str(tmp_path / "never"))
    with pytest.raises(ValueError, match="never committed"):
        runs.read_committed(spark, str(tmp_path / "never"), "gold")
    golds = spark.createDataFrame([("s", True), ("t", False)], "source_id string, exhaustive boolean")
    kept = derived.adjudicated(golds, good, spark.createDataFrame([], "source_id string")).orderBy("source_id").collect()
    assert [(r["literal_status"], r["derived_status"], r["nothing_accepted"]) for r in kept] == [("unauthored", "authored", False), ("unauthored", "unauthored", True)]


def test_accepted_rows_are_not_broadcast(spark):
    golds = spark.createDataFrame([("a", "draft", "draft"), ("b", "draft", "draft")], "source_id string, literal_status string, derived_status string")
    some = spark.createDataFrame([("a",)], "source_id string")
    out = derived.adjudicated(golds, some, some.limit(0))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.source_id, r.derived_status) for r in out.collect()} == {("a", "authored"), ("b", "unauthored")}


def test_clusters_take_no_rounds_over_the_table(spark, monkeypatch):
    from anchora.plans import components

    monkeypatch.setattr(components, "written", None)  # the search over all edges is not asked for
    monkeypatch.setattr(derived, "components", None, raising=False)
    rows = [("s", "only", "occurrence", "p1", "g1", False, 0, 0, 9), ("s", "only", "occurrence", "p1", "g2", True, 0, 0, 9), ("s", "only", "occurrence", "p2", "g1", True, 0, 2, 12), ("s", "only", "occurrence", "p3", "g3", False, 0, 12, 20), ("t", "only", "occurrence", "p1", "g1", False, 0, 0, 5)]
    edges = spark.createDataFrame(rows, "source_id string, variant_id string, kind string, pred string, gold string, alike boolean, marks int, from int, to int")
    got = {(r.source_id, r.pred, r.gold) for r in derived._settle(edges).collect()}
    assert got == {("s", "p1", "g2"), ("s", "p2", "g1"), ("s", "p3", "g3"), ("t", "p1", "g1")}


def test_entries_dealt_by_source_need_no_shuffle_and_only_contested_ones_a_search(spark, monkeypatch):
    rows = lambda mark, drop: [{"source_id": f"s{k // 4}", "annotation_id": f"{mark}{k}", "kind": ("occurrence", "description")[k % 2], "base_concept": "x" if k % 2 == 0 else None, "description_text": "t" if k % 2 else None, "describes": f"{mark}{k - 1}" if k % 2 else None, "start": 100 * k, "end": 100 * k + 9} for k in range(12) if k not in drop]
    gold = entries(spark, [*rows("g", ()), {"source_id": "s0", "annotation_id": "g90", "kind": "occurrence", "base_concept": "y", "start": 4, "end": 12}])
    pred = entries(spark, [*rows("p", (3,)), {"source_id": "s0", "annotation_id": "p90", "kind": "occurrence", "base_concept": "x", "start": 4, "end": 12}])
    seen, plans, settle, keep = [], [], derived._settle, derived.written
    monkeypatch.setattr(derived, "_settle", lambda edges: seen.append(edges.count()) or settle(edges))
    monkeypatch.setattr(derived, "written", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d))
    both = derived.entry_sides(pred, gold).repartition("source_id")
    got = {r["kind"]: (r["tp"], r["fp"], r["fn"]) for r in derived.fidelity_report(derived.fidelity_sides(both)).withColumnRenamed("dimension", "kind").collect()}
    assert got == {"qualification": (6, 1, 1), "description": (5, 0, 1)}
    assert plans[0].count("Exchange") == 1 and "Window" in plans[0]
    assert seen == [4, 0]


def test_fidelity_of_crowded_passages_is_best(spark):
    rnd = random.Random(4)
    some = lambda mark, n: [{"source_id": f"s{s}", "annotation_id": f"{mark}{k}", "kind": "occurrence", "base_concept": rnd.choice("xyz"), "start": (a := rnd.randint(0, 12)), "end": a + rnd.randint(0, 8)} for s in range(40) for k in range(rnd.randint(1, n))]
    gold, pred = some("g", 5), some("p", 5)
    got = {r["source_id"]: (r["aligned"], r["fully_correct"]) for r in derived.fidelity(entries(spark, pred), entries(spark, gold)).collect()}
    for s in {r["source_id"] for r in gold}:
        p, g = ([r for r in side if r["source_id"] == s] for side in (pred, gold))
        edges = {(a, b): x["base_concept"] == y["base_concept"] for a, x in enumerate(p) for b, y in enumerate(g) if min(x["end"], y["end"]) > max(x["start"], y["start"])}
        best = derived.best_matching([(a, b, 1 + 10 * alike) for (a, b), alike in edges.items()])
        assert got[s] == (len(best), sum(edges[x] for x in best))


def test_entries_of_one_id_are_entries_of_their_own(spark):
    rows = lambda mark: [{"annotation_id": f"{mark}1", "kind": "occurrence", "base_concept": c} for c in "xxy"] + [{"annotation_id": f"{mark}2", "kind": "description", "description_text": "t", "describes": f"{mark}1", "start": 20, "end": 25}]
    got = {r["kind"]: (r["aligned"], r["tp"], r["fp"], r["fn"]) for r in derived.fidelity(entries(spark, rows("p")), entries(spark, rows("g"))).collect()}
    assert got == {"occurrence": (3, 3, 0, 0), "description": (1, 1, 0, 0)}
    wrong = {r["dimension"]: r["wrong"] for r in derived.oracle_check(entries(spark, rows("g")).withColumn("variant_id", F.when(F.col("base_concept") == "y", "v")), claims(spark)).collect()}
    assert wrong == dict.fromkeys(["occurrence", "description", "literal loose", "literal strict", "literal relaxed"], 0)


def claims(spark):
    return spark.createDataFrame([(1, "s", "a", "is", "b", "affirmed", "assertion", "course", 0, 5)], "ord long, source_id string, subject string, predicate string, object string, polarity string, mode string, attribution string, evidence_start int, evidence_end int")
