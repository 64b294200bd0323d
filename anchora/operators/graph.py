"""Claims as a graph of nodes and edges, its neighbourhoods, and chains of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.functions.text import squeeze
from anchora.operators.profile import content_hash
from anchora.operators.retrieve import containing
from anchora.plans.tables import must, written

#: Predicates that a chain may follow (fixed values).
WALKABLE = ("causes", "expresses", "requires", "makes", "creates")


def _known(rows: DataFrame, column: str, resolution: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``, the entity of their ``column``, null where none resolves it. Rows without a mention are spread
    by a hash of the whole row, so that they do not meet in one task."""
    r = resolution.select(F.col("mention").alias("_m"), F.xxhash64("mention").alias("_h"), F.col("entity_id").alias(out))
    at = rows.withColumn("_at", F.when(F.col(column).isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(column)))
    return at.join(r, (F.col(column) == F.col("_m")) & (F.col("_at") == F.col("_h")), "left").drop("_m", "_h", "_at")


def _node(mention: str, resolution: DataFrame, claims: DataFrame, out: str) -> DataFrame:
    named = _known(claims, mention, resolution, f"_e_{out}")
    return named.withColumn(out, F.when(F.col(mention).isNotNull(), F.coalesce(F.concat(F.lit("e:"), F.col(f"_e_{out}")), F.concat(F.lit("m:"), F.col(mention))))).drop(f"_e_{out}")


def endpoints(claims: DataFrame, resolution: DataFrame) -> DataFrame:
    """Claims with src and dst node ids and the reason why a claim is not drawn, null if it is."""
    blank = lambda c: F.coalesce(squeeze(F.col(c)) == "", F.lit(False))
    ends = _node("object", resolution, _node("subject", resolution, claims, "src"), "dst")
    reason = F.when(blank("subject"), "subject_not_drawable").when(F.col("object").isNull(), "missing_object").when(blank("object"), "object_not_drawable")
    return ends.withColumn("reason", reason)


def nodes(ends: DataFrame, resolution: DataFrame | None = None) -> DataFrame:
    """(node_id, label, n_expressions, expressions) of all drawable endpoints, also those of claims that are not drawn.

    With ``resolution`` (mention, entity_id) a catalogued node has all mentions of its entity, whether or not a claim uses
    them; the label is the shortest of them, then the first by order."""
    both = ends.select(F.col("src").alias("node_id"), F.col("subject").alias("form")).union(ends.select("dst", "object"))
    both = both.where(F.col("form").isNotNull() & (squeeze(F.col("form")) != "")).distinct()
    if resolution is not None:
        known = resolution.select(F.concat(F.lit("e:"), "entity_id").alias("node_id"), F.col("mention").alias("form"))
        both = both.union(known.join(both.select("node_id").distinct(), "node_id", "left_semi")).distinct()
    label = F.min(F.struct(F.length("form").alias("n"), F.col("form").alias("form")))["form"]
    return both.groupBy("node_id").agg(label.alias("label"), F.count("*").alias("n_expressions"), F.array_sort(F.collect_set("form")).alias("expressions"))


def edges(ends: DataFrame) -> DataFrame:
    return ends.where("reason is null")


def coverage(claims: DataFrame, ends: DataFrame, node_table: DataFrame) -> DataFrame:
    """One row: edges, non-projectable claims by reason, nodes by kind; fails where claims are lost."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    drawn = ends.agg(F.count("*").alias("claims"), n(F.col("reason").isNull()).alias("edges"), n(F.col("reason") == "missing_object").alias("missing_object"), n(F.col("reason").isin("subject_not_drawable", "object_not_drawable")).alias("not_drawable"))
    kinds = node_table.agg(F.count("*").alias("nodes"), n(F.col("node_id").startswith("e:")).alias("catalogued"), n(F.col("node_id").startswith("m:")).alias("uncatalogued"), n(F.col("n_expressions") > 1).alias("merged"))
    whole = drawn.crossJoin(kinds)
    return whole.where(F.assert_true(F.col("edges") + F.col("missing_object") + F.col("not_drawable") == F.col("claims")).isNull())


def passages(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, evidence_start, evidence_end, book, chapter, before, evidence, after): each span that a claim refers to,
    once. An unknown source, or a span outside its text, fails the job."""
    return _cut(_spans(claims, sources))


def _spans(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each source that claims refer to, with its text and its distinct spans in order; dealt by source once, for the
    spans as for the texts."""
    span = F.struct("evidence_start", "evidence_end").alias("span")
    spans = claims.select("source_id", span).repartition("source_id").groupBy("source_id").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return spans.join(sources.select(F.col("id").alias("source_id"), "book", "chapter", "text"), "source_id", "left")


def _cut(spans: DataFrame) -> DataFrame:
    """The passages of ``_spans``, in their order."""
    each = spans.select("source_id", F.explode("spans").alias("span"), "book", "chapter", "text").select("source_id", "span.*", "book", "chapter", "text")
    start, end = F.col("evidence_start"), F.col("evidence_end")
    parts = {"before": F.expr("substring(text, 1, evidence_start)"), "evidence": F.expr("substring(text, evidence_start + 1, evidence_end - evidence_start)"), "after": F.col("text").substr(end + 1, F.length("text"))}
    cut = each.withColumns(parts).drop("text")
    inside = F.col("evidence").isNotNull() & (start >= 0) & (start < end) & (F.length("evidence") == end - start)
    return must(cut, inside, "no such evidence")


#: Version of the written graph's tables (a fixed value of this format).
GRAPH_VERSION = 2
#: What the hash of a graph covers: every field of its tables.
_CLAIM = ["claim_id", "source_id", "subject", "predicate", "object", "verb_phrase", "polarity", "mode", "attribution", "evidence_start", "evidence_end"]
HASHED = {
    "nodes": ["node_id", "label", "n_expressions", "expressions"], "edges": [*_CLAIM, "src", "dst"], "non_projectable": [*_CLAIM, "reason"],
    "passages": ["source_id", "evidence_start", "evidence_end", "book", "chapter", "before", "evidence", "after"],
}


def artifact(claims: DataFrame, resolution: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The graph's tables: nodes, edges, non_projectable, passages, counts and metadata with a hash over the others.

    Claims with their ends are written once, and so are the spans of each source with its text; all tables are drawn from
    these. Passages are sorted by source before they are cut, so that a text moves once and not with each span."""
    claims = ends = written(endpoints(claims, resolution))
    table = nodes(ends, resolution)
    drawn, rest = edges(ends), ends.where("reason is not null")
    spans = written(_spans(claims, sources))
    seen = _cut(spans)
    counts = coverage(claims, ends, table)
    forms = table.withColumn("expressions", F.array_join("expressions", "\0"))
    hashes = [content_hash(t, columns) for t, columns in ((forms, HASHED["nodes"]), (drawn, HASHED["edges"]), (rest, HASHED["non_projectable"]), (seen, HASHED["passages"]))]
    whole = hashes[0].toDF("h0")
    for k, h in enumerate(hashes[1:], 1):
        whole = whole.crossJoin(h.toDF(f"h{k}"))
    sizes = claims.agg(F.count("*").alias("claim_count")).crossJoin(resolution.agg(F.countDistinct("entity_id").alias("resolution_entity_count"))).crossJoin(sources.agg(F.count("*").alias("source_count")))
    metadata = whole.select(F.lit(GRAPH_VERSION).alias("version"), F.sha2(F.concat_ws(":", *whole.columns), 256).alias("content_hash")).crossJoin(sizes)
    return {"nodes": table, "edges": drawn, "non_projectable": rest, "passages": _cut(spans.orderBy("source_id")), "counts": counts, "metadata": metadata}


def undrawn_claims(node_table: DataFrame, non_projectable: DataFrame) -> DataFrame:
    """(center, claim_id, reason): claims that are not drawn although one of the node's expressions is their subject or
    object. Two equality joins stand in for the OR."""
    forms = node_table.select(F.col("node_id").alias("center"), F.explode("expressions").alias("form"))
    hit = lambda c: non_projectable.join(forms, F.col(c) == F.col("form")).select("center", "claim_id", "reason")
    return hit("subject").union(hit("object")).distinct()


def neighborhood(edge_table: DataFrame, centers: DataFrame, cap: int = 30, direction: str = "both", predicates: tuple[str, ...] = ()) -> DataFrame:
    """Edges at each centre by (predicate, far node, claim), at most ``cap`` of them, with the number hidden by it.

    All edges of a centre are counted apart, so that only its first ``cap`` of each task are shuffled and ranked."""
    e = edge_table.where(F.col("predicate").isin(*predicates)) if predicates else edge_table
    c = centers.select(F.col("node_id").alias("center")).distinct()
    out = e.join(c, F.col("src") == F.col("center")).select("center", "claim_id", "predicate", F.col("dst").alias("far"), F.lit("out").alias("way"))
    into = e.join(c, F.col("dst") == F.col("center")).select("center", "claim_id", "predicate", F.col("src").alias("far"), F.lit("in").alias("way"))
    both = {"both": out.union(into.where("far <> center")), "out": out, "in": into}[direction]
    first = W.partitionBy("center").orderBy("predicate", "far", "claim_id")
    ranked = both.withColumn("place", F.row_number().over(first)).where(F.col("place") <= cap)
    sizes = both.groupBy("center").agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("hidden"))
    return ranked.join(sizes, "center")


def neighborhood_counts(node_table: DataFrame, edge_table: DataFrame, non_projectable: DataFrame, cap: int = 30, direction: str = "both", predicates: tuple[str, ...] = ()) -> DataFrame:
    """A row for each node, also one without edges: total_eligible edges whatever the filter, available_after_filter by
    direction and predicates, displayed and hidden_by_cap of these, non_projectable claims that name one of its
    expressions, and all_predicates of the eligible edges in order. A loop counts once."""
    e = edge_table.select("claim_id", "predicate", "src", "dst")
    ends = e.select(F.col("src").alias("node_id"), "claim_id", "predicate", F.lit("out").alias("way"), (F.col("src") == F.col("dst")).alias("loop"))
    ends = ends.union(e.where("src <> dst").select("dst", "claim_id", "predicate", F.lit("in"), F.lit(False)))
    turned = {"both": F.lit(True), "out": F.col("way") == "out", "in": (F.col("way") == "in") | F.col("loop")}[direction]
    passes = turned & (F.col("predicate").isin(*predicates) if predicates else F.lit(True))
    n = ends.groupBy("node_id").agg(F.count("*").alias("total_eligible"), F.count_if(passes).alias("available_after_filter"), F.array_sort(F.collect_set("predicate")).alias("all_predicates"))
    undrawn = undrawn_claims(node_table, non_projectable).groupBy(F.col("center").alias("node_id")).agg(F.count("*").alias("non_projectable"))
    out = node_table.select("node_id").join(n, "node_id", "left").join(undrawn, "node_id", "left").na.fill(0, ["total_eligible", "available_after_filter", "non_projectable"])
    shown = F.least(F.col("available_after_filter"), F.lit(cap).cast("long"))
    none = F.array().cast("array<string>")
    return out.withColumns({"displayed": shown, "hidden_by_cap": F.col("available_after_filter") - shown, "all_predicates": F.coalesce("all_predicates", none)})


def search_nodes(node_table: DataFrame, queries: DataFrame, limit: int = 25) -> DataFrame:
    """Nodes whose label or an expression holds the query: exact label first, then shorter, then by label and id."""
    q = queries.select("batch_id", "q_ord", F.lower(squeeze(F.col("query"))).alias("needle")).where("needle <> ''")
    # every label is an expression; a needle holds no line feed, so none is found across two of them
    hits = containing(node_table.withColumn("_text", F.lower(F.array_join("expressions", "\n"))), q, "_text")
    best = W.partitionBy("batch_id", "q_ord").orderBy(F.desc((F.lower("label") == F.col("needle")).cast("int")), F.length("label"), "label", "node_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("_text")


#: Shares of a group that are cut for themselves first, so that a hub's claims do not meet in one task.
SHARES = 16


def _smallest(rows: DataFrame, keys: list[str], by: str, horizon: int, bound: int) -> DataFrame:
    """Of each group the rows that are among its ``bound`` smallest by ``by``, or, with ``horizon`` 1, among the ``bound``
    smallest of those with ``far``; ``cut`` becomes true where a group lost rows."""
    for group in ([*keys, "_share"], keys):
        if "_share" in group:
            rows = rows.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SHARES)))
        w = W.partitionBy(*group)
        upto = w.orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
        keep = F.lit(False)
        for h in range(horizon + 1):
            keep = keep | ((F.col("far") >= h) & (F.sum((F.col("far") >= h).cast("int")).over(upto) <= bound))
        rows = rows.withColumn("_keep", keep).withColumn("cut", F.col("cut") | (F.min("_keep").over(w) == F.lit(False))).where("_keep")
    return rows.drop("_share", "_keep")


def chain_claims(claims: DataFrame, resolution: DataFrame, seeds: DataFrame, max_hops: int = 3, limit: int = 10) -> DataFrame:
    """Chains (seed, predicate, path of claim ids, hops) from each seed (subject, predicate), shortest first, then by path.

    A step joins the last object's entity with the next subject's; after the first claim only affirmed claims of the
    course extend. A chain never returns to an entity that it has left from, but may end at one.

    Since the order is by length, then by path, a hop needs the ``limit`` smallest paths so far as results, and the ``limit``
    smallest of those that a step can follow to go on: these alone make ``limit`` longer ones. So of each entity's claims, and
    of each seed's paths, only so many of either kind are kept, and a hop's rows are bounded by the seeds. Where too few of
    the kept paths can go on, because a chain may not return, the seed is walked again with twice as many."""
    key = lambda d, c, out: _known(d, c, resolution, "_e").withColumn(out, F.coalesce("_e", c)).drop("_e")
    links = written(key(key(claims.where(F.col("predicate").isin(*WALKABLE)), "subject", "head"), "object", "tail").select("claim_id", "predicate", "head", "tail", "polarity", "attribution"))
    extends = "polarity = 'affirmed' and attribution = 'course'"
    followed = links.where(extends).select("predicate", F.col("head").alias("tail"), F.lit(1).alias("far")).distinct()
    links = written(links.join(followed, ["predicate", "tail"], "left").withColumns({"far": F.coalesce("far", F.lit(0)), "cut": F.lit(False)}))
    open_ = written(key(seeds.select("subject", "predicate").distinct(), "subject", "head").withColumnRenamed("subject", "seed"))
    settled, bound = None, limit
    while True:
        first = _smallest(links, ["head", "predicate"], "claim_id", 1, bound)
        steps = _smallest(links.where(extends), ["head", "predicate"], "claim_id", 1, bound)
        steps = written(steps.select("predicate", F.col("head").alias("tail"), "claim_id", F.col("tail").alias("to"), F.col("far").alias("to_far"), F.col("cut").alias("step_cut")))
        frontier = first.join(open_, ["head", "predicate"]).select("seed", "predicate", F.array("claim_id").alias("path"), F.array("head").alias("seen"), "tail", "far", "cut")
        found, short = None, None
        for hop in range(1, max_hops + 1):
            frontier = written(_smallest(frontier, ["seed", "predicate"], "path", min(max_hops - hop, 1), bound))
            found = frontier if found is None else found.union(frontier)
            if hop == max_hops:
                break
            full = found.groupBy("seed", "predicate").count().where(F.col("count") >= limit)
            walked = frontier.join(full, ["seed", "predicate"], "left_anti").withColumn("on", (F.col("far") > 0) & ~F.array_contains("seen", F.col("tail")))
            few = walked.groupBy("seed", "predicate").agg(F.bool_or("cut").alias("cut"), F.count_if("on").alias("n")).where(F.col("cut") & (F.col("n") < limit)).select("seed", "predicate")
            short = few if short is None else short.union(few)
            grown = walked.where("on").join(steps, ["predicate", "tail"])
            frontier = grown.select("seed", "predicate", F.concat("path", F.array("claim_id")).alias("path"), F.concat("seen", F.array("tail")).alias("seen"), F.col("to").alias("tail"), F.col("to_far").alias("far"), (F.col("cut") | F.col("step_cut")).alias("cut"))
        paths = W.partitionBy("seed", "predicate").orderBy(F.size("path"), "path")
        ranked = found.withColumn("rank", F.row_number().over(paths)).where(F.col("rank") <= limit)
        out = ranked.select("seed", "predicate", "path", F.size("path").alias("hops"), "rank")
        short = written(short.distinct()) if short is not None else None
        again = short is not None and not short.isEmpty()
        out = written(out.join(short, ["seed", "predicate"], "left_anti")) if again else out
        settled = out if settled is None else settled.union(out)
        if not again:
            return settled
        open_, bound = written(open_.join(short, ["seed", "predicate"], "left_semi")), 2 * bound
