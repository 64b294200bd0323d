"""Judges' replies held against answers: grounding against a search over all placements, and each kind of failure."""

import json
import random
import re

from pyspark.sql import functions as F

from anchora.operators import audit, grounding

A, B, X = "a" * 16, "b" * 16, "f" * 16


def placements(answer, assertions):
    """All ways to place the assertions, by trying everything."""
    marks = [m.span() for m in re.finditer(grounding.MARKER, answer)]
    spots = [[(i, i + len(t)) for i in range(len(answer) - len(t) + 1) if answer.startswith(t, i)] for t in assertions]
    ways = [[]]
    for options in spots:
        ways = [w + [s] for w in ways for s in options if all(s[1] <= a or b <= s[0] for a, b in w)]
    clean = lambda w: all(sum(a <= x and y <= b for a, b in w) == 1 and not any(a < y and x < b and not (a <= x and y <= b) for a, b in w) for x, y in marks)
    return [w for w in ways if clean(w)]


def results(spark, rows):
    """rows: case_id, reply, error, answer, supplied, corpus_reality."""
    d = spark.createDataFrame(rows, "case_id string, reply string, error string, answer string, supplied array<string>, corpus_reality string").withColumn("n_elements", F.lit("extra"))
    out = grounding.judge_results(d.select("case_id", "reply", "error", "n_elements"), d.select("case_id", "answer", "supplied"), d.select("case_id", "corpus_reality"))
    return {(r["case_id"], r["name"]): (r["status"], r["score"], r["failure"]) for r in out.collect()}


def reply(*elements, **scores):
    return json.dumps({"semantic_grounding": [{"assertion": t, "supported_by_its_markers": ok} for t, ok in elements], **scores})


def test_each_outcome_of_grounding(spark):
    two = f"One [{A}]. Two [{B}]."
    rows = {
        "all": (reply((f"One [{A}]", True), (f"Two [{B}].", True)), two, [A, B], ("pass", 1.0, None)),
        "unsupported": (reply((f"One [{A}]", True), (f"Two [{B}].", False)), two, [A, B], ("fail", 0.5, None)),
        "not supplied": (reply((f"One [{A}]", True), (f"Two [{B}].", True)), two, [A], ("fail", 0.5, None)),
        "no marker": (reply((f"One [{A}]", True), (f"Two [{B}]", True), (".", True)), two, [A, B], ("not_evaluated", None, "incomplete_coverage")),
        "uncited": (reply(("Nothing cited", True)), "Nothing cited here", [A], ("fail", 0.0, None)),
        "uncovered": (reply((f"One [{A}]", True)), two, [A, B], ("not_evaluated", None, "incomplete_coverage")),
        "clipped": (reply((f"One [{A[:5]}", True), (f"Two [{B}]", True)), two, [A, B], ("not_evaluated", None, "incomplete_coverage")),
        "absent": (reply(("Three", True)), two, [A, B], ("not_evaluated", None, "parse_failure")),
        "twice": (reply((f"One [{A}]", True), (f"One [{A}]", True)), f"One [{A}]. One [{A}].", [A], ("not_evaluated", None, "incomplete_coverage")),
        "told apart": (reply((f"One [{A}]. Two [{B}]", True), (f"One [{A}]", True)), f"One [{A}]. Two [{B}]. One [{A}]", [A, B], ("pass", 1.0, None)),
        "nothing": (reply(), "I cannot say.", [], ("not_evaluated", None, None)),
        "null answer": (reply(), None, [], ("not_evaluated", None, None)),
        "none asserted": (reply(), two, [A, B], ("not_evaluated", None, "incomplete_coverage")),
        "blank": (reply((" ", True)), two, [A, B], ("not_evaluated", None, "parse_failure")),
        "no bool": ('{"semantic_grounding": [{"assertion": "One", "supported_by_its_markers": 1}]}', two, [A, B], ("not_evaluated", None, "parse_failure")),
        "no list": ('{"semantic_grounding": {}}', two, [A, B], ("not_evaluated", None, "parse_failure")),
        "no object": ("[]", two, [A, B], ("not_evaluated", None, "parse_failure")),
        "quote": (reply((rf"\E.* [{A}]", True)), rf"x \E.* [{A}]", [A], ("pass", 1.0, None)),
        "null supplied": (reply((f"One [{A}]", True), (f"Two [{B}].", True)), two, None, ("fail", 0.0, None)),
    }
    got = results(spark, [(k, r, None, a, s, "absent") for k, (r, a, s, _) in rows.items()])
    assert {k: got[k, "semantic_grounding"] for k in rows} == {k: want for k, (*_, want) in rows.items()}


def test_scores_abstention_and_failures(spark):
    said = reply(answers_question=0.6, synthesis_fidelity=1.7, epistemic_boundary=True, interpretation_marked="1", abstained=0.6)
    got = results(spark, [("a", f" {said}\n", None, "x", [], "sufficient"), ("b", reply(abstained=0.59), None, "x", [], "sufficient"), ("c", said, None, "x", [], "absent"), ("d", reply(), None, "x", [], "sufficient"), ("e", said, "down", "x", [], "absent"), ("f", None, None, "x", [], None)])
    assert [got["a", c] for c in grounding.SCALAR_CRITERIA] == [("pass", 0.6, None), ("pass", 1.0, None), ("not_evaluated", None, "parse_failure"), ("not_evaluated", None, "parse_failure")]
    assert [got[c, "premature_abstention"] for c in "abcdef"] == [
        ("fail", 0.6, None), ("pass", 0.59, None), ("not_evaluated", None, None), ("not_evaluated", None, "parse_failure"), ("not_evaluated", None, "provider_failure"), ("not_evaluated", None, "parse_failure"),
    ]
    assert {got["e", c][2] for c in (*grounding.SCALAR_CRITERIA, "semantic_grounding", "premature_abstention")} == {"provider_failure"}
    trials = spark.createDataFrame([(k, n, "pass", s, x, f) for (k, n), (s, x, f) in got.items()], "fixture_id string, criterion string, human string, status string, score double, failure string")
    report = {r["criterion"]: r for r in audit.calibration_report(trials).collect()}
    assert report["answers_question"]["provider_failure"] == 1 and report["answers_question"]["parse_failure"] == 3 and report["answers_question"]["unscored"] == 0


def test_placements_against_all_of_them(spark):
    rng = random.Random(2)
    pieces = ["x", "xx", "yx", f"[{A}]", f"[{B}]", f"x[{A}]", " "]
    answers = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    cases = [(f"c{k}", a, [a[i : i + n] for i, n in ((rng.randrange(len(a)), rng.choice([1, 2, 2, 3, 19, 20, 37])) for _ in range(rng.randrange(1, 5)))]) for k, a in enumerate(answers)]
    rows = spark.createDataFrame([(c, a, k, t) for c, a, ts in cases for k, t in enumerate(ts)], "case_id string, answer string, element int, assertion string")
    whole = spark.createDataFrame([(c, a, len(ts), len(re.findall(grounding.MARKER, a))) for c, a, ts in cases], "case_id string, answer string, n_elements int, n_markers int")
    spans = grounding.verbatim_spans(rows)
    assert sorted((r["case_id"], r["element"], r["start"]) for r in spans.collect()) == sorted((c, k, i) for c, a, ts in cases for k, t in enumerate(ts) for i in range(len(a)) if a.startswith(t, i))
    out = grounding.unique_partition(spans, grounding.marker_places(whole), whole.drop("answer")).collect()
    ways = {c: placements(a, ts) for c, a, ts in cases}
    assert {r["case_id"]: r["ways"] for r in out} == {c: min(len(w), 2) for c, w in ways.items()}
    assert {r["case_id"]: sorted((x["element"], x["start"], x["end"]) for x in r["chosen"]) for r in out if r["chosen"]} == {c: [(k, *s) for k, s in enumerate(w[0])] for c, w in ways.items() if len(w) == 1}
    assert len({len(w) for w in ways.values()}) > 2


def test_only_open_placements_are_searched(spark, monkeypatch):
    """Single places, equal wordings and uncovered markers are settled in their row; a wording with several places is searched."""
    two = f"One [{A}]. Two [{B}]. One [{A}]"
    settled = {
        "single": (reply((f"One [{A}].", True), (f"Two [{B}].", True), (f". One [{A}]", True)), two, "incomplete_coverage"),
        "told apart": (reply((f"One [{A}]. Two [{B}]", True), (f"One [{A}]", True)), two, None),
        "twice": (reply((f"One [{A}]", True), (f"Two [{B}]", True), (f"One [{A}]", True)), two, "incomplete_coverage"),
        "uncovered": (reply(("One", True), (f"Two [{B}]", True)), two, "incomplete_coverage"),
    }
    searched = {
        "three": (reply(("x", True), (f"x x [{A}]", True)), f"x x x [{A}]", "fail"),
        "chain": (reply((f"x[{A}]", True), (f"x[{A}]x", True), ("x", True)), f"x[{A}]x[{A}]x", "not_evaluated"),
    }
    got = results(spark, [(k, r, None, a, [A, B], "absent") for k, (r, a, _) in searched.items()])
    assert {k: got[k, "semantic_grounding"][0] for k in searched} == {k: want for k, (*_, want) in searched.items()}
    monkeypatch.setattr(grounding, "unique_partition", lambda *_: 1 / 0)
    got = results(spark, [(k, r, None, a, [A, B], "absent") for k, (r, a, _) in settled.items()])
    assert {k: got[k, "semantic_grounding"][2] for k in settled} == {k: want for k, (*_, want) in settled.items()}
