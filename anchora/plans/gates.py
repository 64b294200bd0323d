"""Queries over the rules that derived gold must keep, and its publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchora.operators import derived
from anchora.plans import bind
from anchora.plans.catalog import _KINDS, _entries, _table, registered
from anchora.plans.stored import _folder
from anchora.plans.tables import large
from anchora.sources import runs


def _numbered(claims: DataFrame) -> DataFrame:
    """Claims as entries of one reading, with the claim's number."""
    return _entries(claims, "g", F.lit(None).cast("string"), 100).withColumn("n", F.substring("annotation_id", 3, 20).cast("long"))


@registered(
    bind.ctes("claims") + " SELECT 'g' || claim_id AS annotation_id, CASE ord % 50 WHEN 0 THEN 'blank evidence' WHEN 1 THEN 'forbidden base_concept' WHEN 2 THEN 'blank scope' WHEN 3 THEN 'resolved without referent' WHEN 4 THEN 'missing description_text' WHEN 8 THEN 'unresolved with referent' END AS violation "
    "FROM claims WHERE ord % 50 IN (0, 1, 2, 3, 4, 8)"
)
def entry_violations(spark, sf_dir):
    """Entries of which some have a field too many, one too few, a blank one, or a referent against their resolution."""
    at = lambda k: F.col("n") % 50 == k
    e = _numbered(bind.claims(spark, sf_dir))
    none = F.lit(None).cast("string")
    e = e.withColumns({
        "evidence": F.when(at(0), "  ").otherwise(F.col("evidence")), "base_concept": F.when(at(1), "x").otherwise(F.col("base_concept")), "scope": F.when(at(2), " ").otherwise(F.col("scope")),
        "referent": F.when(at(3), none).when(at(8), "x").otherwise(F.col("referent")), "description_text": F.when(at(4), none).otherwise(F.col("description_text")),
    })
    return derived.entry_violations(e)


@registered(
    bind.ctes("claims") + " SELECT DISTINCT source_id, 'repeated entry' AS violation FROM claims WHERE ord % 40 = 7 UNION ALL SELECT DISTINCT source_id, 'blank variant' FROM claims WHERE ord % 40 = 9 UNION ALL SELECT DISTINCT 'x' || source_id, 'unknown passage' FROM claims WHERE ord % 40 = 11"
)
def bundle_violations(spark, sf_dir):
    """Some entries are there twice, some in a variant without a name, some of passages that are not there."""
    e = _numbered(bind.claims(spark, sf_dir))
    k = F.col("n") % 40
    e = e.union(e.where(k == 7)).withColumns({"variant_id": F.when(k == 9, " ").otherwise(F.col("variant_id")), "source_id": F.when(k == 11, F.concat(F.lit("x"), "source_id")).otherwise(F.col("source_id"))})
    return derived.bundle_violations(e, bind.sources(spark, sf_dir).select("id"))


@registered(
    bind.ctes("claims") + f", e AS (SELECT source_id, ord, claim_id, {_KINDS} AS kind, CASE WHEN ord % 50 = 9 THEN ord - 5 WHEN ord % 50 = 14 THEN NULL ELSE ord - 1 END AS target FROM claims) "
    "SELECT d.source_id, 'g' || d.claim_id AS annotation_id, CASE WHEN t.ord IS NULL THEN 'no target' ELSE 'target is a description' END AS violation FROM e d LEFT JOIN e t ON t.source_id = d.source_id AND t.ord = d.target WHERE d.kind = 'description' AND (t.ord IS NULL OR t.kind = 'description')"
)
def link_violations(spark, sf_dir):
    """Descriptions of the entry before them; some tell of another description, some of nothing."""
    k = F.col("n") % 50
    target = F.when(k == 9, F.concat(F.lit("gc"), (F.col("n") - 5).cast("string"))).when(k == 14, F.lit(None).cast("string")).otherwise(F.col("describes"))
    e = _numbered(bind.claims(spark, sf_dir)).withColumn("describes", F.when(F.col("kind") == "description", target))
    return derived.link_violations(e)


@registered(
    "SELECT 'o' || CAST(o_orderkey AS STRING) AS source_id, CAST(strpos(t, 'customer') - 1 AS BIGINT) AS start, CAST(strpos(t, 'customer') - 1 + length('customer ' || CAST(o_custkey AS STRING)) AS BIGINT) AS \"end\", o_orderkey % 3 > 0 AS accepted_claims "
    "FROM (SELECT *, 'Order ' || CAST(o_orderkey AS STRING) || ' has priority ' || o_orderpriority || ', was placed by customer ' || CAST(o_custkey AS STRING) AS t FROM orders) x WHERE o_orderkey % 4 > 0"
)
def published_gold(spark, sf_dir):
    """Drafts, of which decisions accept three in four, published as gold and read back. A draft with a broken rule is
    refused, and nothing of it can be read."""
    c = _table(spark, sf_dir, "orders")
    sources = bind.sources(spark, sf_dir)
    none = F.lit(None).cast("string")
    sig = F.lit(None).cast("struct<subject:string,predicate:string,object:string,polarity:string,mode:string,attribution:string>")
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    quote = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    draft = c.select(
        key.alias("source_id"), none.alias("variant_id"), F.concat(F.lit("g"), key).alias("annotation_id"), F.lit("occurrence").alias("kind"), quote.alias("evidence"), F.lit("literal").alias("support"), F.lit("resolved").alias("resolution"),
        *(F.lit("customer").alias(f) if f == "base_concept" else none.alias(f) for f in derived.TEXTS), *(sig.alias(f) for f in ("attaches_to", "reframed_proposition")),
    )
    decisions = c.select(F.concat(F.lit("g"), key).alias("annotation_id"), F.when(F.col("o_orderkey") % 4 > 0, "accept").otherwise("reject").alias("decision"))
    accepted, path = derived.apply_decisions(draft, decisions), _folder(spark)
    try:
        derived.publish_gold(accepted.withColumn("base_concept", F.when(F.col("source_id") != "o1", F.col("base_concept"))), sources, path)
    except ValueError:
        pass
    else:
        raise AssertionError("a broken entry was published")
    derived.publish_gold(accepted, sources, path)
    entries = runs.read_committed(spark, path, "gold")["entries"]
    golds = derived.adjudicated(sources.select(F.col("id").alias("source_id")).withColumns({"literal_status": F.lit("draft"), "derived_status": F.lit("draft")}), entries, sources.where("src_ord % 3 > 0").select(F.col("id").alias("source_id")))
    known = golds.where("derived_status = 'authored'").select("source_id", (F.col("literal_status") == "authored").alias("accepted_claims"))
    return entries.join(large(known), "source_id").select("source_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "accepted_claims")
