"""Derived readings of passages: rules they must keep, decisions on drafts, and their score against gold.

Entries are rows: source_id, variant_id, annotation_id, kind, evidence, support, resolution and the fields of their kind;
anchored ones have start and end."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.functions.text import evidence_overlap, normalize_surface, squeeze
from anchora.operators.anchor import anchor_evidence
from anchora.operators.score import SIDE, score_sides
from anchora.plans.tables import large, written
from anchora.sources import runs

#: Fields that a kind may have, those it must have marked by a star (fixed values).
FIELDS = {
    "condition": ("condition_text*", "scope", "attaches_to*"),
    "resolved_reference": ("mention*", "referent"),
    "occurrence": ("base_concept*", "scope"),
    "requirement": ("reframed_proposition*", "reframed_mode"),
    "description": ("description_text*", "describes*"),
}
SIGNATURE = ("predicate", "polarity", "mode", "attribution")
#: What a pair of entries is compared on beside reading alike as a whole.
MARKS = ("content", "scope", "attachment", "mention", "gold_unresolved", "pred_unresolved", "referent")
#: Kinds whose presence is counted apart from how they read.
PRESENT = ("condition", "resolved_reference")
TEXTS = ("condition_text", "scope", "mention", "referent", "base_concept", "reframed_mode", "description_text", "describes")
CONTENT = (*TEXTS, "attaches_to", "reframed_proposition")


def entry_violations(entries: DataFrame) -> DataFrame:
    """(annotation_id, violation): fields that the kind forbids or lacks, blank strings, and references whose referent
    does not fit their resolution."""
    rules = []
    for field in CONTENT:
        may = [k for k, fs in FIELDS.items() if field in fs or f"{field}*" in fs]
        need = [k for k, fs in FIELDS.items() if f"{field}*" in fs]
        rules.append(F.when(F.col(field).isNotNull() & ~F.col("kind").isin(*may), f"forbidden {field}"))
        rules.append(F.when(F.col(field).isNull() & F.col("kind").isin(*need), f"missing {field}") if need else F.lit(None).cast("string"))
    rules += [F.when(squeeze(F.col(f)) == "", f"blank {f}") for f in (*TEXTS, "evidence", "source_id")]
    reference = F.col("kind") == "resolved_reference"
    rules.append(F.when(reference & (F.col("resolution") == "resolved") & F.col("referent").isNull(), "resolved without referent"))
    rules.append(F.when(reference & (F.col("resolution") == "unresolved") & F.col("referent").isNotNull(), "unresolved with referent"))
    rules.append(F.when(~F.col("kind").isin(*FIELDS), "unknown kind"))
    return entries.select("annotation_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def bundle_violations(entries: DataFrame, passages: DataFrame) -> DataFrame:
    """(source_id, violation): entries of unknown passages, and ids that are there twice among shared entries (null
    variant) and those of one variant."""
    foreign = entries.join(passages.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("source_id", F.lit("unknown passage").alias("violation"))
    variants = entries.where("variant_id is not null").select("source_id", "variant_id").distinct()
    shared = entries.where("variant_id is null").select("source_id", "annotation_id").join(large(variants), "source_id", "left").select("source_id", "variant_id", "annotation_id")
    own = entries.where("variant_id is not null").select("source_id", "variant_id", "annotation_id")
    twice = shared.unionByName(own).groupBy("source_id", "variant_id", "annotation_id").count().where("count > 1")
    blank = entries.where("trim(variant_id) = ''").select("source_id", F.lit("blank variant").alias("violation"))
    return foreign.union(twice.select("source_id", F.lit("repeated entry").alias("violation"))).union(blank).distinct()


def link_violations(entries: DataFrame) -> DataFrame:
    """Descriptions whose target is not an entry of their own variant (or shared), or is itself a description."""
    d = entries.where("kind = 'description'").select("source_id", "variant_id", "annotation_id", "describes")
    t = entries.select(F.col("source_id").alias("s"), F.col("variant_id").alias("v"), F.col("annotation_id").alias("t"), F.col("kind").alias("target_kind"))
    near = (F.col("source_id") == F.col("s")) & (F.col("describes") == F.col("t")) & (F.col("v").isNull() | F.col("variant_id").eqNullSafe(F.col("v")))
    linked = d.join(large(t), near, "left")
    return linked.select("source_id", "annotation_id", F.when(F.col("t").isNull(), "no target").when(F.col("target_kind") == "description", "target is a description").alias("violation")).where("violation is not null")


def apply_decisions(draft: DataFrame, decisions: DataFrame) -> DataFrame:
    """Draft entries that were accepted; what has no decision is skipped, and a variant without accepted entries is gone."""
    return draft.join(large(decisions.where("decision = 'accept'").select("annotation_id").distinct()), "annotation_id", "left_semi")


def adjudicated(golds: DataFrame, accepted: DataFrame, accepted_claims: DataFrame) -> DataFrame:
    """``golds`` (source_id and more) with each layer's status anew, authored only where it gained rows, and
    nothing_accepted, which tells a draft without any acceptance from an empty gold."""
    has = lambda d, n: large(d.select("source_id", F.lit(True).alias(n)).distinct())
    both = golds.drop("literal_status", "derived_status").join(has(accepted_claims, "_l"), "source_id", "left").join(has(accepted, "_d"), "source_id", "left")
    status = lambda c: F.when(F.col(c), "authored").otherwise("unauthored")
    return both.withColumns({"literal_status": status("_l"), "derived_status": status("_d"), "nothing_accepted": F.col("_l").isNull() & F.col("_d").isNull()}).drop("_l", "_d")


def gold_violations(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, annotation_id, violation) of everything that forbids to publish gold ``entries``: quotes that their
    ``sources`` (id, text) do not hold just once, and broken rules of entries, bundles and links."""
    return _violations(anchor_evidence(entries.drop("start", "end"), sources), sources)


def _violations(anchored: DataFrame, sources: DataFrame) -> DataFrame:
    """The same for entries that were anchored, with the reason why they could not be."""
    none = F.lit(None).cast("string").alias("annotation_id")
    out = anchored.where("reason is not null").select("source_id", "annotation_id", F.concat(F.lit("evidence "), "reason").alias("violation"))
    broken = anchored.select("source_id", "annotation_id").join(large(entry_violations(anchored)), "annotation_id")
    for more in (broken, bundle_violations(anchored, sources.select("id")).select("source_id", none, "violation"), link_violations(anchored)):
        out = out.unionByName(more.select("source_id", "annotation_id", "violation"))
    return out.distinct()


def publish_gold(entries: DataFrame, sources: DataFrame, path: str, name: str = "gold") -> None:
    """Gold entries with their spans, committed to ``path`` as ``name``; where a check fails, nothing is.

    The entries are anchored and staged once, checked as they were staged, and committed only if no check found anything;
    what was staged before a failure is never read (``runs.read_committed``)."""
    spark = entries.sparkSession
    anchored = anchor_evidence(entries.drop("start", "end"), sources).withColumnsRenamed({"evidence_start": "start", "evidence_end": "end"})
    attempt = runs.stage({"entries": anchored}, path)
    staged = spark.read.parquet(f"{path}/attempts/{attempt}/entries")
    bad = _violations(staged, sources).orderBy("source_id", "annotation_id", "violation").limit(5).collect()
    if bad:
        raise ValueError(f"gold is not valid: {[tuple(r) for r in bad]}")
    runs.commit(spark, path, name, attempt, ["entries"])


#: Where a kind's fields are looked at: what it says, what that is about, and its proposition (fixed values).
_TEXT = {"condition": "condition_text", "occurrence": "base_concept", "requirement": "reframed_mode", "description": "description_text"}
_DETAIL = {"condition": "scope", "occurrence": "scope", "resolved_reference": "referent"}
_PROPOSITION = {"condition": "attaches_to", "requirement": "reframed_proposition"}


def entry_sides(predicted: DataFrame, gold: DataFrame, exhaustive: DataFrame | None = None) -> DataFrame:
    """Both tables as one, a row for each entry: ``is_gold``, and ``whole`` on a row (without a side) for each source of
    ``exhaustive`` (source_id)."""
    side = lambda d, is_gold: d.withColumns({"is_gold": F.lit(is_gold), "whole": F.lit(False)})
    both = side(gold, True).unionByName(side(predicted.drop("variant_id"), False), allowMissingColumns=True)
    return both if exhaustive is None else both.unionByName(exhaustive.select("source_id", F.lit(True).alias("whole")), allowMissingColumns=True)


def _forms(both: DataFrame) -> DataFrame:
    """``entry_sides`` with the normalised fields of its kind. A kind has at most one field of each sort, so that a row takes
    little code, which the JVM compiles. An entry without a kind or a span overlaps none."""
    kind = F.col("kind")
    of = lambda fields: F.coalesce(*(F.when(kind == k, F.col(f)) for k, f in fields.items()))
    both = both.withColumns({"text": of(_TEXT), "detail": of(_DETAIL), "proposition": of(_PROPOSITION), "first": F.when(kind == "resolved_reference", F.expr("locate(mention, evidence)"))})
    p = F.col("proposition")
    said = F.array(normalize_surface(p["subject"]), normalize_surface(p["object"]), *(p[x] for x in SIGNATURE))
    spanned = kind.isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    # an array of one with the place of a reference's mention, or with null for none; null where the quote does not hold it just once
    alone = (squeeze(F.col("mention")) != "") & (F.col("first") > 0) & (F.expr("locate(mention, evidence, first + 1)") == 0)
    place = F.when(F.col("mention").isNull(), F.array(F.lit(None).cast("string"))).when(alone, F.array(F.concat_ws(":", F.col("start") + F.col("first"), F.length("mention"))))
    return both.select(
        "source_id", "variant_id", "is_gold", "whole", "kind", "annotation_id", "support", "resolution", "describes", F.when(spanned, F.col("start")).alias("start"), F.when(spanned, F.col("end")).alias("end"),
        normalize_surface(F.col("text")).alias("text"), normalize_surface(F.col("detail")).alias("detail"), F.when(p.isNotNull(), said).alias("proposition"), place.alias("place"),
    )


def _said(rows: DataFrame) -> DataFrame:
    """Rows of ``_forms`` with ``said``, which is equal and not null where two of a kind read alike, links of descriptions apart,
    and ``mark``, what pairs are compared on. References must be of the same mention, at the same place, and an unresolved
    one has no referent to agree on."""
    none, reference = F.lit(None).cast("string"), F.col("kind") == "resolved_reference"
    detail = F.when(reference & (F.col("resolution") == "unresolved"), none).otherwise(F.col("detail"))
    whole = F.concat(F.array("support", "resolution", "text", detail), F.coalesce("proposition", F.array(none)), F.when(reference, F.col("place")).otherwise(F.array(none)))
    said = F.when(F.col("start").isNotNull() & F.col("kind").isin(*FIELDS), whole)
    return rows.withColumns({"said": said, "mark": F.struct("text", "detail", "proposition", "place", "resolution")}).drop("support", "resolution", "text", "detail", "proposition", "place")


def _marks(p: Column, g: Column) -> Column:
    """What an overlapping pair of a kind agrees on, a bit for each of MARKS."""
    same = lambda f: p[f].eqNullSafe(g[f])
    tests = {
        "content": same("text"), "scope": same("detail"), "attachment": same("proposition"), "mention": p["place"] == g["place"],
        "gold_unresolved": g["resolution"] == "unresolved", "pred_unresolved": p["resolution"] == "unresolved", "referent": same("detail"),
    }
    return sum((F.coalesce(tests[m], F.lit(False)).cast("int") * (1 << k) for k, m in enumerate(MARKS)), F.lit(0))


def _marked(name: str) -> Column:
    return F.col("marks").bitwiseAND(F.lit(1 << MARKS.index(name))) > 0


def best_matching(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of greatest total weight in a small bipartite graph, by augmenting along the best path while one gains."""
    near = defaultdict(dict)
    for a, b, w in sorted(edges):
        near[a][b] = w
    partner: dict[int, int] = {}  # right -> left
    while True:
        gain = {("l", a): (0, None) for a in near if a not in partner.values()}
        changed = True
        while changed:
            changed = False
            for side, x in list(gain):
                so_far = gain[side, x][0]
                if side == "l":
                    steps = [(("r", b), so_far + w) for b, w in near[x].items() if partner.get(b) != x]
                else:
                    steps = [(("l", partner[x]), so_far - near[partner[x]][x])] if x in partner else []
                for node, value in steps:
                    if node not in gain or value > gain[node][0]:
                        gain[node] = (value, (side, x))
                        changed = True
        ends = [(-v, b) for (side, b), (v, _) in gain.items() if side == "r" and b not in partner and v > 0]
        if not ends:
            return sorted((a, b) for b, a in partner.items())
        node = ("r", min(ends)[1])
        while node is not None:
            left = gain[node][1]
            before = gain[left][1]
            partner[node[1]] = left[1]
            node = before


def _components(rows: list[tuple]) -> list[list[tuple]]:
    """Rows (pred and gold in places 3 and 4) by connected component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in rows:
        root[find((3, r[3]))] = find((4, r[4]))
    out = defaultdict(list)
    for r in rows:
        out[find((3, r[3]))].append(r)
    return list(out.values())


def _settle(edges: DataFrame) -> DataFrame:
    """Overlaps in order of place: where all that came before end, a cluster ends, which no overlap crosses. Only overlaps that
    share a cluster meet, so contested ones need no search over the whole table."""
    group = ["source_id", "variant_id", "kind"]
    place = W.partitionBy(*group).orderBy("from", "to", "pred", "gold")
    before = F.max("to").over(place.rowsBetween(W.unboundedPreceding, -1))
    named = edges.withColumn("cluster", F.when(F.coalesce(F.col("from") < before, F.lit(False)), 0).otherwise(1))
    named = named.withColumn("cluster", F.sum("cluster").over(place)).withColumn("_several", F.count("*").over(W.partitionBy(*group, "cluster")) > 1)

    def match(rows: list[tuple]) -> list[tuple]:
        left, right = ({x: k for k, x in enumerate(sorted({r[c] for r in rows}))} for c in (3, 4))
        bonus = min(len(left), len(right)) + 1
        pairs = set(best_matching([(left[r[3]], right[r[4]], 1 + bonus * bool(r[5])) for r in rows]))
        return [r for r in rows if (left[r[3]], right[r[4]]) in pairs]

    def solved(rows: list[tuple]) -> list[tuple]:
        return rows if len(rows) < 2 else [r for part in _components(rows) for r in match(part)]

    def solve(frames):
        """Clusters one after the other, as their rows stand together; one may go on in the next batch."""
        rows: list[tuple] = []
        for frame in frames:
            done: list[tuple] = []
            for r in frame.itertuples(index=False, name=None):
                if rows and (rows[0][:3], rows[0][6]) != (r[:3], r[6]):
                    done += solved(rows)
                    rows = []
                rows.append(r)
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(solved(rows), columns=columns)

    columns = [*group, "pred", "gold", "alike", "cluster", "marks"]
    named = written(named.select(*columns, "_several"))
    contested = named.where("_several").select(*columns)
    found = contested.repartition("source_id").sortWithinPartitions(*group, "cluster").mapInPandas(solve, contested.schema)
    return named.where("not _several").select(*columns).union(found).drop("cluster")


def _variants(rows: DataFrame) -> DataFrame:
    """Entries once for each reading of their passage, ``only`` where gold has no variants; a gold variant's own entries are in
    that alone. Predictions for sources without gold go. ``linked``: whether the source has descriptions."""
    gold, source = F.col("is_gold"), W.partitionBy("source_id")
    seen = {
        "covered": F.max(gold).over(source), "whole": F.max("whole").over(source), "linked": F.max(F.col("kind") == "description").over(source),
        "_all": F.array_sort(F.collect_set(F.when(gold, F.col("variant_id"))).over(source)),
    }
    rows = rows.withColumns(seen).where("covered AND is_gold IS NOT NULL AND source_id IS NOT NULL")
    of = F.when(gold & F.col("variant_id").isNotNull(), F.array("variant_id")).when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(F.lit("only")))
    return rows.withColumn("variant_id", F.explode(of)).drop("_all", "covered")


_GROUP = ("source_id", "variant_id", "kind")


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (of ``_variants``; those ``later`` are left alone) written, predictions with the ``gold`` they were paired with, if
    they read ``alike``, and ``marks``; and (source_id, variant_id, kind, pred, gold, alike, marks) of pairs that were searched.

    In order of place, where all that came before ends, a cluster ends, which no overlap crosses. In a cluster that has each
    reading once a side at most, all that read alike and overlap are in every best matching; if one side has a single entry
    beside them, that takes the first it overlaps. Only the rest (``open``) is joined and searched. All windows begin with the
    source, so that rows that come dealt by it need no shuffle."""
    gold, cluster = F.col("is_gold"), W.partitionBy(*_GROUP, "cluster")
    place, key = W.partitionBy(*_GROUP).orderBy("start", "end"), W.partitionBy(*_GROUP, "cluster", "said")
    before = F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumns({"nth": F.row_number().over(place), "cluster": F.when(F.col("start") < before, 0).otherwise(1)})
    out = out.withColumn("cluster", F.sum("cluster").over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    one, known = F.struct("annotation_id", "nth", "mark"), F.col("said").isNotNull()
    n = lambda side, w: F.count_if(side).over(w)
    out = out.withColumns({"_p": n(~gold, key), "_g": n(gold, key), "_met": F.max("start").over(key) < F.min("end").over(key), "_twin": F.max(F.when(gold & known, one)).over(key)})
    both = known & (F.col("_p") > 0) & (F.col("_g") > 0)
    out = out.withColumns({"forced": F.coalesce(both & (F.col("_p") + F.col("_g") == 2) & F.col("_met"), F.lit(False)), "several": both & (F.col("_p") + F.col("_g") > 2)})
    free = {"p": ~F.col("forced") & ~gold, "g": ~F.col("forced") & gold}
    spans = {f"_{x}{c}": F.max(F.when(side, F.col(c))).over(cluster) for x, side in free.items() for c in ("start", "end")}
    out = out.withColumns(spans | {"several": F.max("several").over(cluster), "_p": n(free["p"], cluster), "_g": n(free["g"], cluster)})
    meets = lambda x: evidence_overlap(F.col("start"), F.col("end"), F.col(f"_{x}start"), F.col(f"_{x}end")) > 0
    asked = F.min(F.when(free["p"] & meets("g"), F.struct("annotation_id", "nth"))).over(cluster)
    out = out.withColumns({"_asked": asked["nth"], "_first": F.min(F.when(free["g"] & meets("p"), one)).over(cluster), "_single": F.max(F.when(free["g"], one)).over(cluster)})
    chosen = F.when(F.col("_g") == 1, F.when(F.col("nth") == F.col("_asked"), F.col("_single"))).when((F.col("_p") == 1) & (F.col("_g") > 1), F.col("_first"))
    out = out.withColumns({
        "met": F.when(~gold & ~F.col("several") & ~F.col("later"), F.when(F.col("forced"), F.col("_twin")).otherwise(chosen)),
        "open": ~F.col("later") & (F.col("several") | (~F.col("forced") & (F.least("_p", "_g") > 1))),
    })
    kept, paired = F.col("open") | F.col("later"), F.col("met").isNotNull()
    done = written(out.select(
        *_GROUP, "is_gold", "whole", "linked", "later", "open", (F.col("mark")["resolution"] == "unresolved").alias("unresolved"), F.when(kept | paired, F.col("annotation_id")).alias("annotation_id"), F.col("met")["annotation_id"].alias("gold"),
        F.when(paired, F.col("forced")).alias("alike"), F.when(paired, _marks(F.col("mark"), F.col("met")["mark"])).alias("marks"), *(F.when(kept, F.col(c)).alias(c) for c in ("describes", "start", "end", "said", "mark", "nth", "cluster")),
    ))
    # entries of one id are told apart by their number
    p, g = (done.where(F.col("open") & side).withColumn("name", F.concat_ws("\0", "annotation_id", "nth")) for side in (~gold, gold))
    p, g = p.alias("p"), large(g).alias("g")
    on = [F.col(f"p.{c}") == F.col(f"g.{c}") for c in (*_GROUP, "cluster")] + [evidence_overlap(F.col("p.start"), F.col("p.end"), F.col("g.start"), F.col("g.end")) > 0]
    edges = p.join(g, on).select(
        *(f"p.{c}" for c in _GROUP), F.least("p.start", "g.start").alias("from"), F.greatest("p.end", "g.end").alias("to"), F.col("p.name").alias("pred"), F.col("g.name").alias("gold"),
        F.coalesce(F.col("p.said") == F.col("g.said"), F.lit(False)).alias("alike"), _marks(F.col("p.mark"), F.col("g.mark")).alias("marks"),
    )
    plain = lambda c: F.regexp_replace(c, "\0[0-9]+$", "").alias(c)
    return done, _settle(edges).select(*_GROUP, plain("pred"), plain("gold"), "alike", "marks")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("alike IS NOT NULL").select(*_GROUP, F.col("annotation_id").alias("pred"), "gold", "alike", "marks")


def _assigned(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of ``entry_sides`` in each variant, many with their pairs, and all other pairs.

    Descriptions come second, as their targets must be paired: two link alike where their targets are a pair, or where
    neither has a target."""
    nodes = _said(_variants(_forms(both)))
    rows, searched = _settled(nodes.withColumn("later", F.coalesce(F.col("kind") == "description", F.lit(False))))
    links = _pairs(rows.where("linked")).union(searched).select("source_id", "variant_id", F.col("pred").alias("target"), F.col("gold").alias("partner"))
    asks = rows.where("later").withColumn("target", F.when(~F.col("is_gold"), F.col("describes")))
    asks = asks.unionByName(links, allowMissingColumns=True).repartition("source_id")
    asks = asks.withColumn("partner", F.max("partner").over(W.partitionBy("source_id", "variant_id", "target"))).where("later")
    target = F.when(F.col("is_gold"), F.col("describes")).otherwise(F.col("partner"))
    link = F.when(F.col("describes").isNull(), F.array(F.lit(None).cast("string"))).when(target.isNotNull(), F.array(target))
    second, more = _settled(asks.withColumns({"said": F.concat("said", link), "later": F.lit(False)}).drop("partner", "target"))
    return rows, searched.union(_pairs(second)).union(more)


def assign_entries(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(source_id, variant_id, kind, pred, gold, alike, marks): one-to-one pairs of entries whose spans overlap, so that most
    read alike, then most are paired. Each gold variant is matched by itself with the shared entries."""
    rows, more = _assigned(entry_sides(predicted, gold))
    return _pairs(rows).union(more)


def _counts(both: DataFrame) -> DataFrame:
    """Per source, variant and kind: n_gold, n_pred, what its pairs agree on, tp, fp, fn, unsupported, and whether the variant is
    the source's best, and its first. Entries and pairs take one shuffle by source."""
    rows, more = _assigned(both)
    slim = rows.select(*_GROUP, "is_gold", "whole", "unresolved", "alike", "marks").unionByName(more.select(*_GROUP, "alike", "marks"), allowMissingColumns=True)
    gold = F.col("is_gold")
    condition, reference = F.col("kind") == "condition", (F.col("kind") == "resolved_reference") & _marked("mention")
    counts = slim.repartition("source_id").groupBy(*_GROUP).agg(
        F.count_if(gold).alias("n_gold"), F.count_if(~gold).alias("n_pred"), F.count_if(gold & F.col("unresolved")).alias("n_open"), F.max("whole").alias("_all"),
        F.count("alike").alias("aligned"), F.count_if("alike").alias("fully_correct"), *(F.count_if(condition & _marked(m)).alias(f"{m}_matches") for m in ("content", "scope", "attachment")),
        F.count_if(reference & ~_marked("gold_unresolved") & ~_marked("pred_unresolved") & _marked("referent")).alias("referent_matches"),
        F.count_if(reference & _marked("gold_unresolved") & _marked("pred_unresolved")).alias("abstention"),
        F.count_if(reference & _marked("gold_unresolved") & ~_marked("pred_unresolved")).alias("unsupported_resolution"),
    )
    tp = F.when(F.col("kind").isin(*PRESENT), F.col("aligned")).otherwise(F.col("fully_correct"))
    extra = F.when(F.coalesce("_all", F.lit(False)), F.col("n_pred") - F.col("fully_correct")).otherwise(0)
    counts = counts.withColumns({"tp": tp, "fp": F.col("n_pred") - tp, "fn": F.col("n_gold") - tp, "unsupported": extra}).drop("_all")
    variant, source = W.partitionBy("source_id", "variant_id"), W.partitionBy("source_id")
    counts = counts.withColumns({"_c": -F.sum("fully_correct").over(variant), "_f": F.sum("fp").over(variant)})
    best = F.min(F.struct("_c", "_f", "variant_id")).over(source)["variant_id"]
    return counts.withColumns({"best": best == F.col("variant_id"), "first": F.min("variant_id").over(source) == F.col("variant_id")}).drop("_c", "_f")


def fidelity(predicted: DataFrame, gold: DataFrame, exhaustive: DataFrame | None = None) -> DataFrame:
    """Per source, for its best variant (most pairs alike, then fewest other predictions, then least id) and kind: tp, fp,
    fn, precision and recall, null where nothing could be counted, and what the pairs agree on.

    Conditions and references count as found where a pair is aligned; other kinds where it reads alike (fully_correct).
    unsupported: predictions beyond those that read alike, for sources in ``exhaustive`` (source_id) only."""
    return fidelity_sides(entry_sides(predicted, gold, exhaustive))


def fidelity_sides(both: DataFrame) -> DataFrame:
    """``fidelity`` of ``entry_sides``."""
    kept = _counts(both).where("best").drop("best", "first", "n_gold", "n_pred", "n_open")
    share = lambda d: F.when(F.col("tp") + F.col(d) > 0, F.col("tp") / (F.col("tp") + F.col(d)))
    return kept.withColumns({"precision": share("fp"), "recall": share("fn")})


def layer_states(golds: DataFrame, literal_runs: DataFrame, derived_runs: DataFrame) -> DataFrame:
    """(source_id, layer, state) of ``golds`` (source_id, literal_status, derived_status): unauthored, not_run where an
    authored layer has no prediction (``literal_runs`` and ``derived_runs``: source_id), else scored."""
    ran = lambda d, n: d.select("source_id", F.lit(True).alias(n)).distinct()
    both = golds.join(ran(literal_runs, "_l"), "source_id", "left").join(ran(derived_runs, "_d"), "source_id", "left")
    state = lambda status, has: F.when(F.col(status) != "authored", "unauthored").when(F.col(has), "scored").otherwise("not_run")
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), state(f"{n}_status", h).alias("state")) for n, h in (("literal", "_l"), ("derived", "_d"))))
    return both.select("source_id", F.explode(layers).alias("x")).select("source_id", "x.layer", "x.state")


def fidelity_report(scores: DataFrame) -> DataFrame:
    """(dimension, sources, tp, fp, fn, precision, recall, unsupported) over all passages of ``fidelity``, the kinds by
    their dimension's name; rates are null where nothing could be counted."""
    names = {"occurrence": "qualification", "requirement": "requirement", "description": "description", "condition": "condition", "resolved_reference": "reference"}
    dimension = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("kind")].alias("dimension")
    sums = scores.groupBy(dimension).agg(F.countDistinct("source_id").alias("sources"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "unsupported")))
    share = lambda d: F.when(F.col("tp") + F.col(d) > 0, F.col("tp") / (F.col("tp") + F.col(d)))
    return sums.withColumns({"precision": share("fp"), "recall": share("fn")})


def oracle_check(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """(dimension, items, wrong): gold fed back as its own prediction. items counts the entries of each kind, and the
    gold claims of each tier, from the gold alone; wrong is 0 everywhere unless matching or scoring lost something.

    Both sides are made of one row, so that rows that come dealt by source need no shuffle."""
    twice, once = F.array(F.lit(True), F.lit(False)), F.array(F.lit(True))
    first = F.min("variant_id").over(W.partitionBy("source_id"))
    fed = F.coalesce(F.col("variant_id") == F.col("_first"), F.col("variant_id").isNull())
    both = gold.withColumn("_first", first).withColumns({"is_gold": F.explode(F.when(fed, twice).otherwise(once)), "whole": F.lit(True)}).drop("_first")
    n = lambda c: F.sum(c.cast("long"))
    got, items = _counts(both).where("first"), F.col("n_gold")
    whole = F.col("best") & (F.col("tp") == items) & (F.col("fully_correct") == items) & (F.col("fp") == 0) & (F.col("fn") == 0) & (F.col("unsupported") == 0)
    fields = (F.col("kind") != "condition") | ((F.col("content_matches") == items) & (F.col("scope_matches") == items) & (F.col("attachment_matches") == items))
    references = (F.col("kind") != "resolved_reference") | ((F.col("referent_matches") == items - F.col("n_open")) & (F.col("abstention") == F.col("n_open")) & (F.col("unsupported_resolution") == 0))
    layers = got.groupBy(F.col("kind").alias("dimension")).agg(F.sum("n_gold").alias("items"), n(~(whole & fields & references)).alias("wrong"))
    sides = claims.withColumn("is_gold", F.explode(twice)).select("is_gold", *SIDE)
    tiers = score_sides(sides).select(F.concat(F.lit("literal "), "tier").alias("dimension"), (F.col("tp") + F.col("fn")).alias("items"), (F.col("fp") + F.col("fn")).alias("wrong"))
    return layers.union(tiers)
