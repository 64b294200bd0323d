"""The claim model over the driver's star schema, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.plans.tables import written

#: One source for each order.
SOURCES = """
SELECT 'o' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS src_ord, o_orderstatus AS book, CAST(o_orderkey % 31 AS INT) AS chapter,
  'Order ' || CAST(o_orderkey AS STRING) || ' has priority ' || o_orderpriority || ', was placed by customer ' || CAST(o_custkey AS STRING) || ' and has status ' || o_orderstatus || '.' AS text
FROM {orders}
"""

#: The distinct order lines, numbered within their order.
_NUMBERED = """SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS line
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM {lineitem}) l"""

_SOURCE = "'o' || CAST(l_orderkey AS STRING)"

#: What a line and its part say.
_FIELDS = f"""SELECT l_orderkey, l_orderkey * 1000 + line AS ord, {_SOURCE} AS source_id,
    CASE WHEN (l_partkey + line) % 5 = 0 THEN 'The ' ELSE '' END || p_brand || ' ' || p_name || CASE WHEN l_partkey % 11 = 0 THEN '.' ELSE '' END AS subject,
    CASE (l_partkey + l_suppkey) % 9 WHEN 0 THEN 'is' WHEN 1 THEN 'causes' WHEN 2 THEN 'expresses' WHEN 3 THEN 'requires' WHEN 4 THEN 'contrasts_with'
      WHEN 5 THEN 'makes' WHEN 6 THEN 'creates' WHEN 7 THEN 'undoes' ELSE 'other' END AS predicate,
    CASE l_suppkey % 4 WHEN 0 THEN 'makes ' WHEN 1 THEN 'knows ' WHEN 2 THEN 'cares for ' ELSE 'is near ' END || lower(p_type) AS verb_phrase,
    CASE WHEN l_returnflag = 'R' THEN 'negated' ELSE 'affirmed' END AS polarity,
    CASE l_suppkey % 5 WHEN 0 THEN 'normative' WHEN 1 THEN 'conditional' WHEN 2 THEN 'question' ELSE 'assertion' END AS mode,
    CASE l_partkey % 7 WHEN 0 THEN 'ego' WHEN 1 THEN 'others' WHEN 2 THEN 'hypothetical' ELSE 'course' END AS attribution,
    CAST((line * 3) % 20 AS INT) AS evidence_start, CAST((line * 3) % 20 + 5 + l_partkey % 15 AS INT) AS evidence_end"""

_CLAIM = """SELECT ord, 'c' || CAST(ord AS STRING) AS claim_id, source_id, subject, predicate, lead(subject) OVER (PARTITION BY %s ORDER BY ord) AS object,
  verb_phrase, polarity, mode, attribution, evidence_start, evidence_end"""

#: One claim for each distinct order line; the object is the next line's subject, null on the last line.
CLAIMS = f"""
{_CLAIM % "l_orderkey"}
FROM (
  {_FIELDS}
  FROM (
    {_NUMBERED}
  ) n JOIN {{part}} ON l_partkey = p_partkey
) s
"""

#: Queries: each distinct part name, in batches by the first three letters and the length of its first word.
QUERIES = """
SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY name) AS q_ord, name AS query
FROM (SELECT name, ((ascii(word) * 128 + ascii(substr(word, 2, 1))) * 128 + ascii(substr(word, 3, 1))) * 64 + length(word) AS batch_id
  FROM (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS word FROM {part}) n) t
"""

_TABLES = ("lineitem", "part", "orders")


#: What a claim takes of an order line, in the order that numbers lines.
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")

#: Order lines of a task, about, so that it sorts its claims in memory.
TASK_LINES = 400_000


def _run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text})


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SOURCES)


def _dealt(rows: DataFrame, lines: int, *by: Column) -> DataFrame:
    """``rows`` dealt by a key to a task for each ``TASK_LINES``; Spark chooses where that makes fewer than it has cores."""
    tasks = math.ceil(lines / TASK_LINES)
    return rows.repartition(tasks, *by) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(*by)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``CLAIMS`` in one shuffle: lines meet their part, and are then dealt and sorted by source once. Equal lines lie together
    in that order, so lines are numbered by their rank, copies go, and the next line's subject follows. What groups or joins
    claims by source afterwards needs no shuffle of its own."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_LINE)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_type")
    # lines without a part count for the numbers, and a part that is there twice makes two claims
    part = part.withColumn("nth", F.row_number().over(W.partitionBy("p_partkey").orderBy("p_brand")))
    met = _dealt(lines.join(part, F.expr("l_partkey = p_partkey"), "left"), lines.count(), F.expr(_SOURCE))
    order = W.partitionBy("source_id").orderBy(*_LINE[1:], "nth")
    line = F.dense_rank().over(W.partitionBy("source_id").orderBy(*_LINE[1:]))
    met = met.withColumn("source_id", F.expr(_SOURCE)).withColumn("at", F.dense_rank().over(order)).withColumn("line", line)
    met = met.withColumn("copy", F.col("at").eqNullSafe(F.lag("at").over(order))).where("NOT copy AND p_partkey IS NOT NULL")
    fields = spark.sql(f"{_FIELDS.replace(_SOURCE, 'source_id')}, {', '.join(_LINE[1:])}, nth FROM {{met}}", met=met)
    out = fields.withColumn("object", F.lead("subject").over(order)).withColumn("claim_id", F.concat(F.lit("c"), F.col("ord").cast("string")))
    return out.select("ord", "claim_id", "source_id", "subject", "predicate", "object", "verb_phrase", "polarity", "mode", "attribution", "evidence_start", "evidence_end")


def claims_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims, written once for a query that uses them several times."""
    return written(claims(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, QUERIES)


def ctes(*names: str) -> str:
    """WITH clause that gives DuckDB the named tables of this module."""
    texts = {"sources": SOURCES, "claims": CLAIMS, "queries": QUERIES}
    plain = {t: t for t in _TABLES}
    return "WITH " + ", ".join(f"{n} AS ({texts[n].format(**plain)})" for n in names)
