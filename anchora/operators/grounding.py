"""A judge's reply held against the answer that it judged: scores, abstention, and the grounding of every assertion.

A judge names assertions by their words. Where a wording stands more than once, its place is settled by what all of them
must do together: keep clear of each other, clip no marker and cover each marker once. Only one way of placing them counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.functions.text import clamp_score, let
from anchora.plans.tables import written

#: A citation marker, the criteria that a judge scores itself, and the score that passes (fixed values).
MARKER = r"\[([0-9a-f]{16})\]"
SCALAR_CRITERIA = ("answers_question", "synthesis_fidelity", "epistemic_boundary", "interpretation_marked")
THRESHOLD = 0.6
#: Why a criterion has no verdict (fixed values).
PROVIDER, PARSE, INCOMPLETE = "provider_failure", "parse_failure", "incomplete_coverage"


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("reply", f"$.{name}", kind)


def parsed_replies(replies: DataFrame) -> DataFrame:
    """Replies (case_id, reply, error, and more) with the reply as VARIANT and failure: a provider's error and a reply that
    is no JSON object are different facts."""
    bare = replies.withColumn("reply", F.btrim(F.col("reply"), F.lit(" \t\n\r")))
    read = bare.withColumns({"reply": F.try_parse_json("reply"), "_object": F.startswith("reply", F.lit("{"))})
    is_object = F.col("reply").isNotNull() & F.col("_object")
    return read.withColumn("failure", F.when(F.col("error").isNotNull(), PROVIDER).when(~F.coalesce(is_object, F.lit(False)), PARSE)).drop("error", "_object")


def _result(name: Column, score: Column, failing: Column, failure: Column) -> list[Column | str]:
    """A result's columns: not evaluated with ``failure`` where there is no score, else fail where ``failing``."""
    status = F.when(score.isNull(), "not_evaluated").when(failing, "fail").otherwise("pass")
    return ["case_id", name.alias("name"), status.alias("status"), score.alias("score"), F.when(score.isNull(), failure).alias("failure")]


def abstention_results(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``scores`` (corpus_reality, abstained, and failure where the whole reply has one) with status and failure.

    Only a case that the corpus suffices for is judged: it fails where the answer abstained, at ``threshold`` or above.
    Without a value it is not evaluated, for the reply's failure or as a parse failure; out of scope there is no failure."""
    inside = F.coalesce(F.col("corpus_reality") == "sufficient", F.lit(False)) & F.col("failure").isNull()
    status = F.when(~inside | F.col("abstained").isNull(), "not_evaluated").when(F.col("abstained") >= threshold, "fail").otherwise("pass")
    return scores.withColumns({"status": status, "failure": F.coalesce("failure", F.when(inside & F.col("abstained").isNull(), PARSE))})


def marker_places(answers: DataFrame, marker: str = MARKER) -> DataFrame:
    """(case_id, k, id, at, until) of each marker of (case_id, answer), in order; places count from 0, until is exclusive."""
    cut = answers.select("case_id", F.posexplode(F.arrays_zip(F.split("answer", marker).alias("text"), F.regexp_extract_all("answer", F.lit(marker), F.lit(1)).alias("id"))).alias("k", "p"))
    size = F.length("p.text") + F.coalesce(F.length("p.id") + 2, F.lit(0))
    ends = cut.withColumn("until", F.sum(size).over(W.partitionBy("case_id").orderBy("k")).cast("int"))
    return ends.where("p.id IS NOT NULL").select("case_id", "k", "p.id", (F.col("until") - F.length("p.id") - 2).alias("at"), "until")


def verbatim_spans(elements: DataFrame) -> DataFrame:
    """Each place, overlapping ones too, at which ``assertion`` stands in ``answer``: the rows with start and end."""
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(F.col("assertion"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.transform(F.split(F.col("answer"), literal, -1), lambda x: F.length(x))
    cut = elements.where(F.contains("answer", "assertion")).select("*", F.posexplode(pieces).alias("_k", "_n"))
    by = W.partitionBy("case_id", "element").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("start", F.coalesce(F.sum("_n").over(by), F.lit(0)).cast("int"))
    return cut.where((F.col("_k") > 0) | F.startswith("answer", "assertion")).withColumn("end", F.col("start") + F.length("assertion")).drop("_k", "_n")


def unique_partition(spans: DataFrame, markers: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, ways, chosen): how many ways there are (2 stands for more) to take one span (case_id, element, start, end)
    for each of a case's ``n_elements`` so that none overlap, none clips a marker (case_id, at, until) and each of the
    ``n_markers`` lies in one; and where there is just one, its (element, start, end) in order of place.

    Spans are taken from left to right. The next one must begin behind the last, and behind no marker that is still open,
    so what is covered follows from where the last one ended: ways that used the same elements and end at the same place are
    one state, which keeps their number up to two and one way. Cases whose elements have one span each need no search."""
    m = F.struct("at", "until")
    known = cases.join(markers.groupBy("case_id").agg(F.array_sort(F.collect_list(m)).alias("marks")), "case_id", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<at:int,until:int>>")))
    s = spans.select("case_id", "element", "start", "end").join(known.select("case_id", "marks"), "case_id")
    whole = lambda x: (F.col("start") <= x["at"]) & (x["until"] <= F.col("end"))
    meets = lambda x: (F.col("start") < x["until"]) & (x["at"] < F.col("end"))
    s = s.where(~F.exists("marks", lambda x: meets(x) & ~whole(x)))
    count = lambda test: F.size(F.filter("marks", test)).cast("int")
    s = s.select("case_id", "element", "start", "end", count(lambda x: x["until"] <= F.col("start")).alias("before"), count(whole).alias("held"))
    per = s.groupBy("case_id").agg(F.count("*").alias("n_spans"), F.countDistinct("element").alias("placed"))
    s = written(s.join(per, "case_id").join(cases, "case_id").where("placed = n_elements"))
    single, several = s.where("n_spans = n_elements"), s.where("n_spans > n_elements")
    clear = F.coalesce(F.lag("end").over(W.partitionBy("case_id").orderBy("start", "end")) <= F.col("start"), F.lit(True))
    fits = single.withColumn("clear", clear).groupBy("case_id").agg(F.bool_and("clear").alias("clear"), F.sum("held").alias("held"), F.first("n_markers").alias("n_markers"), F.array_sort(F.collect_list(F.struct("start", "end", "element"))).alias("chosen"))
    found = [fits.where("clear AND held = n_markers").select("case_id", F.lit(1).cast("long").alias("ways"), "chosen")]
    nothing = F.array().cast("array<int>")
    states = several.select("case_id").distinct().select("case_id", nothing.alias("used"), F.lit(0).alias("until"), F.lit(0).alias("covered"), F.lit(1).cast("long").alias("ways"), F.array().cast("array<struct<start:int,end:int,element:int>>").alias("chosen"))
    step = several.select("case_id", "element", "start", "end", F.col("before").alias("covered"), "held", "n_elements", "n_markers")
    while True:
        grown = states.join(step, ["case_id", "covered"]).where((F.col("start") >= F.col("until")) & ~F.array_contains("used", F.col("element")))
        grown = grown.select("case_id", F.array_sort(F.array_append("used", F.col("element"))).alias("used"), F.col("end").alias("until"), (F.col("covered") + F.col("held")).alias("covered"), "ways", F.array_append("chosen", F.struct("start", "end", "element")).alias("chosen"), "n_elements", "n_markers")
        grown = grown.groupBy("case_id", "used", "until", "covered").agg(F.least(F.sum("ways"), F.lit(2)).alias("ways"), F.min("chosen").alias("chosen"), F.first("n_elements").alias("n_elements"), F.first("n_markers").alias("n_markers"))
        grown = written(grown)
        done = F.size("used") == F.col("n_elements")
        found.append(grown.where(done & (F.col("covered") == F.col("n_markers"))).select("case_id", "ways", "chosen"))
        states = grown.where(~done).select("case_id", "used", "until", "covered", "ways", "chosen")
        if states.isEmpty():
            break
    ways = reduce(DataFrame.union, found).groupBy("case_id").agg(F.least(F.sum("ways"), F.lit(2)).alias("ways"), F.min("chosen").alias("chosen"))
    out = cases.select("case_id").join(ways, "case_id", "left").withColumn("ways", F.coalesce("ways", F.lit(0).cast("long")))
    return out.withColumn("chosen", F.when(F.col("ways") == 1, F.col("chosen")))


def _elements(parsed: DataFrame) -> DataFrame:
    """``parsed`` with elements, an array of (assertion, supported), null where the reply as a whole or one of them fails, and
    the failure of grounding, ``g_failure``."""
    part = lambda e, f, kind: F.try_variant_get(e, f"$.{f}", kind)
    kind_of = lambda e, f: F.coalesce(F.schema_of_variant(part(e, f, "variant")), F.lit(""))
    read = lambda e: F.struct(part(e, "assertion", "string").alias("assertion"), part(e, "supported_by_its_markers", "boolean").alias("supported"), ((kind_of(e, "assertion") == "STRING") & (kind_of(e, "supported_by_its_markers") == "BOOLEAN")).alias("typed"))
    sound = lambda e: e["typed"] & e["assertion"].rlike(r"(?U)\S")
    p = parsed.withColumn("elements", F.when(F.col("failure").isNull() & F.col("answered"), F.transform(_field("semantic_grounding", "array<variant>"), read)))
    p = p.withColumn("_good", F.coalesce(F.forall("elements", sound), F.lit(False)))
    lost = F.exists("elements", lambda e: ~F.contains(F.col("answer"), e["assertion"]))
    p = p.withColumn("g_failure", F.coalesce("failure", F.when(~F.col("_good"), PARSE).when(lost, PARSE)))
    return p.withColumn("elements", F.when(F.col("g_failure").isNull(), F.col("elements"))).drop("_good")


def _placed(rows: DataFrame, marker: str) -> DataFrame:
    """``rows`` of ``_elements`` with n_markers; ``chosen``, the spans (start, end, supported) of the elements where there is
    one way to place them and it follows from single places; and ``open``, whether that takes a search.

    Two equal wordings can change places, so there is never just one way. An element with one clean place has that one, and
    what overlaps it is no place of another element. If then each has one, or one has none, or no place holds some
    marker, the case is settled. Elements with more than two places are left to the search."""
    cut = F.arrays_zip(F.regexp_extract_all("answer", F.lit(marker), F.lit(1)).alias("id"), F.transform(F.split("answer", marker), lambda t: F.length(t)).alias("n"))
    step = lambda done, c: let(F.coalesce(F.element_at(done, -1)["until"], F.lit(0)) + c["n"], lambda at: F.array_append(done, F.struct(at.alias("at"), (at + F.length(c["id"]) + 2).alias("until"), c["id"].alias("id"))))
    none = F.array().cast("array<struct<at:int,until:int,id:string>>")
    marks = F.aggregate(F.filter(cut, lambda c: c["id"].isNotNull()), none, lambda done, c: F.when(F.size(done) == 0, F.array(F.struct(c["n"].alias("at"), (c["n"] + F.length(c["id"]) + 2).alias("until"), c["id"].alias("id")))).otherwise(step(done, c)))
    r = rows.withColumn("marks", F.when(F.col("elements").isNotNull(), marks)).withColumn("n_markers", F.size("marks"))

    find = lambda e, behind: F.when(behind > 0, F.position(e["assertion"], F.col("answer"), behind + 1)).otherwise(F.lit(0))
    first = F.transform("elements", lambda e: F.struct(e.alias("e"), F.position(e["assertion"], F.col("answer")).alias("p")))
    second = lambda x: F.struct(x["e"].alias("e"), x["p"].alias("p"), find(x["e"], x["p"]).alias("q"))
    span = lambda x, p: F.struct((p - 1).alias("start"), (p - 1 + F.length(x["e"]["assertion"])).alias("end"))
    clips = lambda s, m: (s["start"] < m["until"]) & (m["at"] < s["end"]) & ((m["at"] < s["start"]) | (s["end"] < m["until"]))
    clear = lambda spans: F.filter(spans, lambda s: ~F.exists("marks", lambda m: clips(s, m)))
    places = lambda x: F.when(x["q"] > 0, F.array(span(x, x["p"]), span(x, x["q"]))).otherwise(F.array(span(x, x["p"])))
    r = r.withColumn("c", F.transform(F.transform(first, second), lambda x: F.struct(x["e"]["supported"].alias("supported"), (find(x["e"], x["q"]) > 0).alias("more"), clear(places(x)).alias("at"))))
    r = r.withColumns({"n_elements": F.size("elements"), "_more": F.exists("c", lambda x: x["more"])})
    # no way, or more than one, for certain
    held = lambda m, spans: F.exists(spans, lambda s: (s["start"] <= m["at"]) & (m["until"] <= s["end"]))
    told_apart = F.size(F.array_distinct(F.transform("elements", lambda e: e["assertion"]))) == F.col("n_elements")
    covered = F.forall("marks", lambda m: F.exists("c", lambda x: held(m, x["at"])))
    r = r.withColumn("_may", told_apart & (F.col("_more") | (F.forall("c", lambda x: F.size(x["at"]) > 0) & covered)))
    fixed = F.transform(F.filter("c", lambda x: F.size(x["at"]) == 1), lambda x: F.get(x["at"], F.lit(0)))
    left = lambda x, taken: F.when(F.size(x["at"]) == 1, x["at"]).otherwise(F.filter(x["at"], lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"]))))
    r = r.withColumn("_fixed", F.when(F.col("_may") & ~F.col("_more"), fixed))
    r = r.withColumn("c", F.when(F.col("_fixed").isNotNull(), F.transform("c", lambda x: F.struct(x["supported"].alias("supported"), left(x, F.col("_fixed")).alias("at")))))
    r = r.withColumn("open", F.coalesce(F.col("_may") & (F.col("_more") | (F.forall("c", lambda x: F.size(x["at"]) > 0) & F.exists("c", lambda x: F.size(x["at"]) > 1))), F.lit(False)))
    one = F.array_sort(F.transform("c", lambda x: F.struct(F.get(x["at"], F.lit(0))["start"].alias("start"), F.get(x["at"], F.lit(0))["end"].alias("end"), x["supported"].alias("supported"))))
    r = r.withColumn("chosen", F.when(F.forall("c", lambda x: F.size(x["at"]) == 1), one))
    apart = F.forall(F.transform("chosen", lambda s, i: F.coalesce(F.get("chosen", i + 1)["start"] >= s["end"], F.lit(True))), lambda ok: ok)
    whole = F.aggregate("chosen", F.lit(0), lambda n, s: n + F.size(F.filter("marks", lambda m: (s["start"] <= m["at"]) & (m["until"] <= s["end"]))))
    return r.withColumn("chosen", F.when(apart & (whole == F.col("n_markers")), F.col("chosen"))).drop("c", "_more", "_may", "_fixed")


def _searched(judged: DataFrame, marker: str) -> DataFrame:
    """(case_id, score) of cases (case_id, answer, supplied, elements, n_elements, n_markers) whose placement takes a search;
    null where there is no way or more than one."""
    marks = marker_places(judged, marker)
    rows = judged.select("case_id", "answer", F.posexplode("elements").alias("element", "e")).select("case_id", "answer", "element", "e.assertion", "e.supported")
    ways = unique_partition(verbatim_spans(rows.drop("supported")), marks, judged.select("case_id", "n_elements", "n_markers"))
    placed = ways.where("ways = 1").select("case_id", F.explode("chosen").alias("c")).select("case_id", "c.element", "c.start", "c.end").join(rows.select("case_id", "element", "supported"), ["case_id", "element"])
    cited = placed.alias("p").join(marks.alias("m"), F.expr("p.case_id = m.case_id AND p.start <= m.at AND m.until <= p.end")).join(judged.select(F.col("case_id").alias("of"), "supplied"), F.col("p.case_id") == F.col("of"))
    resolves = cited.groupBy(F.col("p.case_id").alias("case_id"), "element").agg(F.bool_and(F.coalesce(F.array_contains("supplied", F.col("id")), F.lit(False))).alias("resolves"))
    counts = F.col("supported") & F.coalesce("resolves", F.lit(False))
    score = placed.join(resolves, ["case_id", "element"], "left").groupBy("case_id").agg(F.bround(F.avg(counts.cast("double")), 3).alias("score"))
    return judged.select("case_id").join(score, "case_id", "left")


def judge_results(replies: DataFrame, answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, name, kind, status, score, failure), all advisory, of every criterion of each reply (case_id, reply, error).

    answers: (case_id, answer, supplied); cases: (case_id, corpus_reality); one of each at most for a case. A reply that
    failed as a whole fails each criterion with its reason, abstention included; without an answer there is no grounding,
    without a case no abstention."""
    rows = replies.select("case_id", "reply", "error").join(answers.select("case_id", "answer", "supplied", F.lit(True).alias("answered")), "case_id", "left")
    rows = rows.join(cases.select("case_id", "corpus_reality", F.lit(True).alias("known")), "case_id", "left")
    return judge_rows(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("answered", "known")}))


def judge_rows(rows: DataFrame, threshold: float = THRESHOLD, marker: str = MARKER) -> DataFrame:
    """``judge_results`` of replies that carry their answer and case: (case_id, reply, error, answer, supplied, corpus_reality,
    answered, known). A missing score, or one that is no number, is a parse failure.

    Grounding: an assertion counts where the judge calls it supported, its span holds a marker, and all markers in it are of
    supplied claims; the score is the share of those that count, and only all of them pass. A malformed element, or an
    assertion that the answer does not have word for word, is a parse failure; no way or several ways to place the
    assertions are incomplete coverage; an answer without markers and without assertions is not evaluated, which is no
    failure.

    All of it is worked out row by row and written once, but for the few cases whose placement takes a search."""
    parsed = parsed_replies(rows.withColumn("answer", F.coalesce("answer", F.lit(""))))
    scored = parsed.withColumns({"scores": F.array(*(clamp_score(_field(c, "variant")) for c in SCALAR_CRITERIA)), "abstained": clamp_score(_field("abstained", "variant"))})
    p = _placed(_elements(scored).drop("reply"), marker)
    resolves = lambda s: let(F.filter("marks", lambda m: (s["start"] <= m["at"]) & (m["until"] <= s["end"])), lambda held: (F.size(held) > 0) & F.forall(held, lambda m: F.coalesce(F.array_contains("supplied", m["id"]), F.lit(False))))
    good = F.size(F.filter("chosen", lambda s: s["supported"] & resolves(s)))
    p = p.withColumn("g_score", F.when(F.size("elements") > 0, F.when(F.col("chosen").isNotNull(), F.bround(good / F.col("n_elements"), 3))))
    p = p.withColumn("search", F.when(F.col("open"), F.struct("answer", "supplied", "elements", "n_elements", "n_markers")))
    p = p.withColumn("g_failure", F.coalesce("g_failure", F.when(F.col("n_elements") + F.col("n_markers") > 0, INCOMPLETE)))
    p = written(p.select("case_id", "failure", "scores", "abstained", "corpus_reality", "answered", "known", "g_score", "g_failure", "search"))

    result = lambda name, kept, score, failing, failure: F.when(kept, F.struct(F.lit(name).alias("name"), F.when(score.isNull(), "not_evaluated").when(failing, "fail").otherwise("pass").alias("status"), score.alias("score"), F.when(score.isNull(), failure).alias("failure")))
    each = [(name, F.when(F.col("failure").isNull(), F.get("scores", F.lit(k)))) for k, name in enumerate(SCALAR_CRITERIA)]
    found = [result(name, F.lit(True), score, score < threshold, F.coalesce("failure", F.lit(PARSE))) for name, score in each]
    found.append(result("semantic_grounding", F.col("answered") & F.col("search").isNull(), F.col("g_score"), F.col("g_score") < 1, F.col("g_failure")))
    a = abstention_results(p.select("*", F.col("failure").alias("whole")), threshold)
    # a case out of scope has no failure and no score
    judged = F.when(F.col("known"), F.struct(F.lit("premature_abstention").alias("name"), F.col("status"), F.when(F.col("status") != "not_evaluated", F.col("abstained")).alias("score"), F.col("failure").alias("failure")))
    a = a.withColumn("abstention", judged).withColumn("failure", F.col("whole"))
    out = a.select("case_id", F.explode(F.array_compact(F.array(*found, F.col("abstention")))).alias("r")).select("case_id", "r.*")
    search = p.where("search IS NOT NULL").select("case_id", "search.*")
    if not search.isEmpty():
        out = out.unionByName(_searched(search, marker).select(*_result(F.lit("semantic_grounding"), F.col("score"), F.col("score") < 1, F.lit(INCOMPLETE))))
    return out.withColumn("kind", F.lit("advisory"))
