"""Tables that are written whole or not at all, and the vector store.

Every write stages its tables in a folder of its own and then adds one manifest line, which names that folder and the rows of
each table. Readers see manifests only: what a lost driver or a repeated job left behind is never read, and of several
writes of one name the first that was committed counts, so that what has been read once does not change."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "name string, attempt string, tables map<string,long>, committed_at timestamp"
VERSION = "model_id string, version int, width int, segments array<string>, embedded long, total long"


def stage(tables: dict[str, DataFrame], path: str) -> str:
    """Write ``tables`` to a new folder below ``path`` that no reader knows; its name."""
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/attempts/{attempt}/{name}")
    return attempt


def commit(spark: SparkSession, path: str, name: str, attempt: str, tables: list[str]) -> None:
    """Make a staged attempt the content of ``name``, unless there is one. The rows are counted in what was written."""
    rows = {t: spark.read.parquet(f"{path}/attempts/{attempt}/{t}").count() for t in tables}
    line = spark.createDataFrame([(name, attempt, rows, datetime.datetime.now())], MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifests")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All lines of a folder of JSON lines; none where the folder is not there yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(name, attempt, tables, committed_at): the first commit of each name."""
    first = W.partitionBy("name").orderBy("committed_at", "attempt")
    return _lines(spark, f"{path}/manifests", MANIFEST).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def read_committed(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    """The tables of ``name``; an error where it was never committed, or where a table has lost rows since."""
    found = committed(spark, path).where(F.col("name") == name).first()
    if found is None:
        raise ValueError(f"{name} was never committed to {path}")
    tables = {t: spark.read.parquet(f"{path}/attempts/{found['attempt']}/{t}") for t in found["tables"]}
    for t, rows in found["tables"].items():
        if (n := tables[t].count()) != rows:
            raise ValueError(f"{t} of {name} has {n} rows and not {rows}")
    return tables


def write_run(rows: DataFrame, header: DataFrame, path: str, run_id: str) -> None:
    """Outcome rows and one header row of a run, committed together."""
    spark = rows.sparkSession
    tables = {"rows": rows.withColumn("run_id", F.lit(run_id)), "header": header.withColumns({"run_id": F.lit(run_id), "created_at": F.current_timestamp()})}
    commit(spark, path, run_id, stage(tables, path), list(tables))


def read_run(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """``rows`` and ``header`` of a committed run."""
    return read_committed(spark, path, run_id)


# vectors ---------------------------------------------------------------------------------------------------


def store_versions(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """(model_id, version, width, segments, embedded, total) of each version of a model's vectors."""
    return _lines(spark, f"{path}/versions", VERSION).where(F.col("model_id") == model_id)


def _width(vectors: DataFrame) -> int | None:
    """Places of the vectors, null for none; several widths are an error."""
    w = vectors.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if w["a"] != w["b"]:
        raise ValueError(f"vectors have from {w['a']} to {w['b']} places")
    return w["a"]


def store_vectors(spark: SparkSession, path: str, claims: DataFrame, embed: Callable[[DataFrame], DataFrame], model_id: str) -> DataFrame:
    """(claim_id, vec) of ``claims`` (claim_id, text), embedding only what the store lacks.

    ``embed``: claims to (claim_id, vec). Vectors lie in segments with the hash of the text that they were made of; a version
    is a manifest of its segments, their width and what was embedded for it, written after its segment. A claim whose text
    changed is embedded again, and one that is gone, or its old text, is left out at reading, though its segment stays.
    Where new vectors have another width than the stored ones, all claims are embedded again into one new segment."""
    now = claims.select("claim_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    last = store_versions(spark, path, model_id).orderBy(F.desc("version")).first()
    segments, width = (list(last["segments"]), last["width"]) if last else ([], None)

    def write(missing: DataFrame) -> tuple[str, DataFrame]:
        where = f"{path}/segments/{uuid.uuid4().hex}"
        vectors = embed(missing.select("claim_id", "text")).select("claim_id", "vec")
        vectors.join(missing.select("claim_id", "text_hash"), "claim_id").write.parquet(where)
        return where, spark.read.parquet(where)

    stored = lambda: spark.read.parquet(*segments).join(now.select("claim_id", "text_hash"), ["claim_id", "text_hash"], "left_semi")
    missing = now.join(stored().select("claim_id"), "claim_id", "left_anti") if segments else now
    where, new = write(missing)
    if segments and (w := _width(new)) is not None and width is not None and w != width:
        segments, (where, new) = [], write(now)
    embedded = new.count()
    if embedded or not segments:
        segments.append(where)
    out, total = stored(), stored().count()
    line = [(model_id, last["version"] + 1 if last else 1, _width(out), segments, embedded, total)]
    spark.createDataFrame(line, VERSION).coalesce(1).write.mode("append").json(f"{path}/versions")
    return out.select("claim_id", "vec")
