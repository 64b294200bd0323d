"""Scores of predicted claims and concepts against gold."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.functions.text import evidence_overlap, normalise_concepts, normalize_surface
from anchora.operators.resolve import rates
from anchora.plans.tables import written

LOOSE = ("source_id", "predicate", "subject_n", "object_n")
QUALIFIERS = ("polarity", "mode", "attribution")
STRICT = (*LOOSE, *QUALIFIERS)
FIELDS = ("subject", "predicate", "object", "polarity", "mode", "attribution")


def _normal(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"subject_n": normalize_surface(F.col("subject")), "object_n": normalize_surface(F.col("object"))})


def in_scope(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions for sources that gold covers."""
    return predicted.join(gold.select("source_id").distinct(), "source_id", "left_semi")


def multiset_score(predicted: DataFrame, gold: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: tp (the multisets' intersection), fp, fn, precision, recall; null keys equal null keys."""
    p = predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    both = p.select(*keys, "p", F.lit(0).cast("long").alias("g")).union(g.select(*keys, F.lit(0).cast("long"), "g")).groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    counts = both.agg(F.sum(F.least("p", "g")).alias("tp"), F.sum(F.col("p") - F.least("p", "g")).alias("fp"), F.sum(F.col("g") - F.least("p", "g")).alias("fn")).na.fill(0)
    return counts.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


#: What matching looks at of a claim, on either side.
SIDE = ("ord", "source_id", *FIELDS, "evidence_start", "evidence_end")


def sides(predicted: DataFrame, gold: DataFrame, *carried: str) -> DataFrame:
    """Both tables as one, a row for each claim: ``is_gold``, what matching looks at, and the ``carried`` columns of
    predictions."""
    more = [F.col(c) for c in carried]
    none = [F.lit(None).cast(predicted.schema[c].dataType).alias(c) for c in carried]
    return gold.select(F.lit(True).alias("is_gold"), *SIDE, *none).union(predicted.select(F.lit(False).alias("is_gold"), *SIDE, *more))


def paired(both: DataFrame, loose: bool = True) -> DataFrame:
    """``sides`` with the normalised forms; ``k``: which of its side's claims with equal strict keys it is, in order; ``strict``:
    whether the other side has a k-th as well; ``scope``: whether gold covers the source; ``meets``: whether both sides of
    its source and predicate have claims without a strict partner, this being one. With ``loose`` also ``loose``: of gold
    claims of a loose key without a strict partner, as many as there are such predictions. Null keys equal null keys, but a
    null source is none.

    All windows read one sort by the keys, which all begin with the source, so that rows that come dealt by it need no shuffle;
    each looks at what the one before it found, so that none is moved below the sort."""
    gold, open_ = F.col("is_gold"), ~F.col("strict")
    least = lambda n, w: F.least(*(F.coalesce(n(side).over(w), F.lit(0)) for side in (gold, ~gold)))
    known = F.col("source_id").isNotNull()
    out = _normal(both).withColumn("k", F.row_number().over(W.partitionBy(*STRICT, "is_gold").orderBy("ord")))
    shared = least(lambda side: F.max(F.when(side, F.col("k"))), W.partitionBy(*STRICT))
    out = out.withColumn("strict", (F.col("k") <= shared) & known)
    if loose:
        key = W.partitionBy(*LOOSE)
        nth = F.count_if(gold & open_).over(key.orderBy(*QUALIFIERS, "is_gold", "ord").rowsBetween(W.unboundedPreceding, W.currentRow))
        out = out.withColumn("loose", gold & open_ & known & (nth <= F.count_if(~gold & open_).over(key)))
    out = out.withColumn("meets", open_ & (least(lambda side: F.count_if(side & open_), W.partitionBy("source_id", "predicate")) > 0))
    return out.withColumn("scope", F.max(gold | F.col("strict")).over(W.partitionBy("source_id")) & known)


def _loosely(rows: DataFrame) -> DataFrame:
    """Rows of ``paired`` without a strict partner whose loose key has such rows on both sides, with ``k`` anew among them."""
    gold = F.col("is_gold")
    left = rows.where("NOT strict AND source_id IS NOT NULL")
    met = F.least(*(F.count_if(side).over(W.partitionBy(*LOOSE)) for side in (gold, ~gold))) > 0
    return left.withColumn("met", met).where("met").withColumn("k", F.row_number().over(W.partitionBy(*LOOSE, "is_gold").orderBy("ord")))


def _as_pairs(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(gold, pred) of the k-th rows of each key that are there on both sides."""
    side = lambda test, name: F.max(F.when(test, F.col("ord"))).alias(name)
    both = rows.groupBy(*keys, "k").agg(side(F.col("is_gold"), "gold"), side(~F.col("is_gold"), "pred"))
    return both.where("gold IS NOT NULL AND pred IS NOT NULL").select("gold", "pred")


def loose_pairs(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(gold, pred) of claims that share a loose key: those that agree strictly first, then the rest in order."""
    rows = paired(sides(predicted, gold), False)
    return _as_pairs(rows.where("strict"), STRICT).union(_as_pairs(_loosely(rows), LOOSE))


def _matched(both: DataFrame, loose: bool, *carried: str) -> DataFrame:
    """``paired`` rows written once; only claims that the relaxed matching looks at keep their forms."""
    rest = [F.when(F.col("meets"), F.col(c)).alias(c) for c in ("subject_n", "object_n")]
    return written(paired(both, loose).select("is_gold", "ord", "source_id", "predicate", "evidence_start", "evidence_end", "scope", "strict", "meets", *(["loose"] if loose else []), *rest, *carried))


def relaxed_pairs(predicted: DataFrame, gold: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(gold, pred): strict pairs first, then each gold claim in order with the first free prediction of its source and
    predicate whose span overlaps and whose phrases contain each other's.

    The serial rule is kept in rounds: every open gold claim proposes to its first open prediction, and each prediction
    holds the earliest gold claim that asked; all predictions rank gold claims alike, so the result is the serial one.
    Claims with the same predictions take them in order, so the k-th of them begins with the k-th. Rounds go on until no
    proposal loses; where ``max_rounds`` is given and does not suffice, it is an error."""
    rows = written(paired(sides(predicted, gold), False))
    return _as_pairs(rows.where("strict"), STRICT).union(_relaxed(rows, max_rounds))


def _relaxed(rows: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``relaxed_pairs`` of the ``_matched`` rows that have no strict partner."""
    slim = rows.where("meets").select("is_gold", "ord", "source_id", "predicate", "subject_n", "object_n", "evidence_start", "evidence_end")
    g, p = slim.where("is_gold").alias("g"), slim.where("NOT is_gold").alias("p")
    holds = lambda a, b: (a.isNull() & b.isNull()) | F.coalesce(a.contains(b) | b.contains(a), F.lit(False))
    alike = holds(F.col("g.subject_n"), F.col("p.subject_n")) & holds(F.col("g.object_n"), F.col("p.object_n"))
    met = written(g.join(p, (F.col("g.source_id") == F.col("p.source_id")) & (F.col("g.predicate") == F.col("p.predicate")) & (_overlap() > 0) & alike).select(F.col("g.ord").alias("gold"), F.col("p.ord").alias("pred")))
    same = met.groupBy("gold").agg(F.bit_xor(F.xxhash64("pred")).alias("a"), F.bit_xor(F.xxhash64("pred", F.lit(1))).alias("b"), F.count("*").alias("n"))
    first = same.select("gold", F.row_number().over(W.partitionBy("a", "b", "n").orderBy("gold")).alias("at"))
    choices = written(met.withColumn("at", F.row_number().over(W.partitionBy("gold").orderBy("pred"))))
    asks, held = first.join(choices, ["gold", "at"]).select("gold", "pred", "at"), None
    for n in itertools.count():
        if max_rounds is not None and n >= max_rounds:
            raise RuntimeError(f"relaxed matching is not settled after {max_rounds} rounds")
        # proposals of this round compete with those held from earlier ones; who loses asks its next choice
        asks = asks if held is None else asks.unionByName(held)
        now = written(asks.groupBy("pred").agg(F.min(F.struct("gold", "at")).alias("g")).select("g.gold", "pred", "g.at"))
        lost = written(asks.join(now, ["gold", "pred"], "left_anti"))
        held = now
        if lost.isEmpty():
            break
        asks = lost.select("gold", (F.col("at") + 1).alias("at")).join(choices, ["gold", "at"]).select("gold", "pred", "at")
    return held.select("gold", "pred")


def score_claims(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Three rows (tier loose, strict, relaxed) with tp, fp, fn, precision, recall, over sources that gold covers."""
    return score_sides(sides(predicted, gold))


def score_sides(both: DataFrame) -> DataFrame:
    """``score_claims`` of ``sides``. Pairs of a key are as many as its multisets share."""
    rows = _matched(both, True).where("is_gold OR scope")
    is_gold, strict = F.col("is_gold"), F.col("strict")
    paired_to = F.struct(F.count_if(is_gold & (strict | F.col("loose"))).alias("loose"), F.count_if(is_gold & strict).alias("strict"), F.count_if(~is_gold).alias("n_p"), F.count_if(is_gold).alias("n_g"))
    more = _relaxed(rows).agg(F.count("*").alias("more"))
    one = rows.agg(paired_to.alias("c")).select("c.*").crossJoin(more).withColumn("relaxed", F.col("strict") + F.col("more"))
    tiers = one.select("n_p", "n_g", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("tp")) for t in ("loose", "strict", "relaxed")))).alias("t"))
    counts = tiers.select("t.tp", (F.col("n_p") - F.col("t.tp")).alias("fp"), (F.col("n_g") - F.col("t.tp")).alias("fn"), "t.tier")
    return counts.select("tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")), "tier")


def mismatches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: how many loosely paired claims differ in polarity, mode and attribution."""
    return mismatched_sides(sides(predicted, gold))


def mismatched_sides(both: DataFrame) -> DataFrame:
    """``mismatches`` of ``sides``; claims that agree strictly differ in none."""
    other = F.max(F.when(~F.col("is_gold"), F.struct("ord", *QUALIFIERS))).over(W.partitionBy(*LOOSE, "k"))
    met = _loosely(paired(both, False)).withColumn("other", other).where("is_gold AND other IS NOT NULL")
    return met.agg(*(F.coalesce(F.sum((F.col(q) != F.col(f"other.{q}")).cast("long")), F.lit(0)).alias(q) for q in QUALIFIERS))


def _overlap() -> Column:
    return evidence_overlap(F.col("g.evidence_start"), F.col("g.evidence_end"), F.col("p.evidence_start"), F.col("p.evidence_end"))


def near_misses(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """For each gold claim without a relaxed partner: the prediction whose span overlaps most (first on ties) and the raw
    fields that differ; both null where none overlaps. Predictions of all sources count, paired ones too."""
    return missed_sides(sides(predicted, gold))


def missed_sides(both: DataFrame) -> DataFrame:
    """``near_misses`` of ``sides``."""
    rows = _matched(both, False, *(f for f in FIELDS if f != "predicate"))
    raw = rows.select("is_gold", "ord", "source_id", "strict", *FIELDS, "evidence_start", "evidence_end")
    missed = raw.where("is_gold AND NOT strict").join(_relaxed(rows).select(F.col("gold").alias("ord")), "ord", "left_anti").alias("g")
    both = missed.join(raw.where("NOT is_gold").alias("p"), (F.col("g.source_id") == F.col("p.source_id")) & (_overlap() > 0), "left")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"g.{f}").eqNullSafe(F.col(f"p.{f}")), F.lit(f)) for f in FIELDS)))
    found = F.when(F.col("p.ord").isNotNull(), F.struct(F.col("p.ord").alias("pred"), differs.alias("fields")))
    by = F.struct(_overlap().alias("n"), (-F.col("p.ord")).alias("o"))
    # the source is a key as well, by which the rows lie already
    best = both.groupBy(F.col("g.source_id").alias("source_id"), F.col("g.ord").alias("gold")).agg(F.max_by(found, by).alias("b"))
    return best.select("gold", "b.pred", "b.fields")


def differing_fields(misses: DataFrame) -> DataFrame:
    """(field, n): how many near misses differ in each field; a field that none differs in is left out."""
    return misses.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def no_overlap(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions without a relaxed partner that overlap no gold span of their source."""
    slim = predicted.select(F.struct(*predicted.columns).alias("row"), *SIDE)
    return alone_sides(sides(slim, gold, "row"), "row").select("row.*")


def alone_sides(both: DataFrame, *carried: str) -> DataFrame:
    """``no_overlap`` of ``sides``, with the ``carried`` columns."""
    rows = _matched(both, False, *carried)
    alone = rows.where("NOT is_gold AND NOT strict").join(_relaxed(rows).select(F.col("pred").alias("ord")), "ord", "left_anti").alias("p")
    spans = rows.where("is_gold").select("source_id", "evidence_start", "evidence_end").alias("g")
    return alone.join(spans, (F.col("g.source_id") == F.col("p.source_id")) & (_overlap() > 0), "left_anti").select(*carried)


def score_mapping(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: macro precision and recall over situations (situation, concepts), and F1 of the two."""
    low = lambda c: F.transform(normalise_concepts(c), F.lower)
    g = gold.select("situation", low(F.col("concepts")).alias("g"))
    p = predicted.select("situation", low(F.col("concepts")).alias("p"))
    both = g.join(p, "situation", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    tp = F.size(F.array_intersect("g", "p"))
    share = lambda n, d: F.when(d == 0, F.lit(0.0)).otherwise(n / d)
    macro = both.agg(F.avg(share(tp, F.size("p"))).alias("precision"), F.avg(share(tp, F.size("g"))).alias("recall"))
    total = F.col("precision") + F.col("recall")
    return macro.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total))
