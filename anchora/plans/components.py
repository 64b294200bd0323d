"""Connected components by alternating large-star and small-star contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchora.plans.tables import written


#: From this many edges on, least neighbours are written before they are joined. Both sides of the join then come from
#: files, so that Spark can split the edges of a centre that many share.
LARGE = 1_000_000


def _large_star(edges: DataFrame, hold) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = hold(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hold) -> DataFrame:
    """Edges point from the larger end u to the smaller end v."""
    down = hold(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = hold(down.groupBy("u").agg(F.min("v").alias("m")))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label) for every node of ``edges`` (its first two columns), label = the component's least id.

    Null ends and loops are ignored; an edge table without edges gives no rows. Each round is written to the shared
    folder; the loop ends when a round changes no edge."""
    u, v = edges.columns[:2]
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
        hold = written if state["n"] >= LARGE else lambda d: d
        now = written(_small_star(_large_star(now, hold), hold))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return labels.union(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
