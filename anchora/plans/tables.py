"""Tables written between stages, in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, as in tests, a folder of this machine is taken, but only
    with a local master: executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local()


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="anchora-")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so that a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/anchora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` for a join that never broadcasts it. Of a table with many empty or repeated columns Spark takes a few columns for
    much smaller than they are, and would gather millions of rows in the driver."""
    return df.hint("merge")


def must(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """Fail the job on the first row for which ``holds`` is not true."""
    return df.where(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.to_json(F.struct(*df.columns)))).isNull()))
