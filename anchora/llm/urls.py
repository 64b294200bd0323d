"""URL filters: rules by host and path, and trust and distrust propagated over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import written

#: The rules of the registered query (fixed values): verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; empty where the url is null or has no ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _suffixes(host: str) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) with the rules that fit each host, the longest first."""
    up = hosts.select("host", F.explode(_suffixes("host")).alias("rule_host"))
    fit = up.join(rules.withColumnRenamed("host", "rule_host"), "rule_host")
    text = F.concat("rule_host", "path")
    return fit.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length(text).alias("n"), text.alias("rule"), "path", "verdict")), asc=False).alias("rules"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): the links of the pages of each host, counted. A relative link leads to its own host; links of
    other kinds than pages (``mailto:`` and the like, places in the same page) count nothing."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    link = F.col("link")
    whole = F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link)
    other = link.startswith("#") | (link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"))
    dst = F.when(whole.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), host_of(whole)).otherwise(F.col("src"))
    return found.where(~other).select("src", dst.alias("dst")).where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-4, damping: float = 0.85, most_rounds: int = 500) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of trusted seeds along the edges, and of distrusted seeds against them.

    ``seeds``: (host, trust, distrust) weights; each kind has a mass of 1. What damping takes away and what hosts without
    edges hold goes back to the seeds, so no mass is lost. Rounds are one join and one sum over both kinds, written to the
    shared folder, until no kind's ranks change by more than ``tolerance`` in sum; it is an error if ``most_rounds`` do
    not suffice. A kind without seeds has no ranks."""
    both = edges.select("src", "dst", "weight", F.lit("trust").alias("kind")).union(edges.select("dst", "src", "weight", F.lit("distrust")))
    out = both.groupBy("src", "kind").agg(F.sum("weight").alias("all"))
    steps = written(both.join(out, ["src", "kind"]).select("src", "dst", "kind", (F.col("weight") / F.col("all")).alias("p")))
    long = seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "w")).where("w > 0")
    total = long.groupBy("kind").agg(F.sum("w").alias("all"))
    start = written(long.join(F.broadcast(total), "kind").select("host", "kind", (F.col("w") / F.col("all")).alias("rank")))
    now = start
    for _ in range(most_rounds):
        moved = now.join(steps, (now["host"] == steps["src"]) & (now["kind"] == steps["kind"])).select(steps["dst"].alias("host"), steps["kind"], (damping * F.col("rank") * F.col("p")).alias("rank"))
        arrived = written(moved.groupBy("host", "kind").agg(F.sum("rank").alias("rank")))
        left = F.broadcast(arrived.groupBy("kind").agg(F.sum("rank").alias("sum")))  # two rows
        back = start.join(left, "kind", "left").select("host", "kind", (F.col("rank") * (1 - F.coalesce("sum", F.lit(0.0)))).alias("rank"))
        tagged = lambda d, new: d.select("host", "kind", F.when(F.lit(new), F.col("rank")).otherwise(0.0).alias("rank"), F.when(F.lit(not new), F.col("rank")).otherwise(0.0).alias("old"))
        each = tagged(arrived, True).unionByName(tagged(back, True)).unionByName(tagged(now, False))
        after = written(each.groupBy("host", "kind").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
        change = after.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("by")).agg(F.max("by")).first()[0]
        now = after.select("host", "kind", "rank")
        if (change or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"ranks still change after {most_rounds} rounds")
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    return now.groupBy("host").agg(part("trust"), part("distrust"))


def judge_urls(pages: DataFrame, rules: DataFrame, max_distrust: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): host, path, rule, trust, distrust and verdict.

    A rule of ``rules`` (verdict, host, path) fits its host and all subdomains where the path starts with the rule's; the
    longest wins. Pages that no rule decides take the method's verdict for their host: block where the host's distrust
    is more than ``max_distrust`` of its trust and distrust together, else allow. Seeds are the hosts with pages that
    rules allow or block, by their number; a host that neither kind reaches is allowed, as is one of equal shares. A null url, or one without ``://``, has an empty host and path and is
    allowed; repeated rows stay; an empty table gives none; other columns are ignored."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = p.select("host").distinct()
    fitting = written(host_rules(hosts, rules))
    decided = p.join(fitting, "host", "left").withColumn("hit", F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), 0))
    decided = decided.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    seeds = decided.where("ruled is not null").groupBy("host").agg(
        F.sum((F.col("ruled") == "allow").cast("double")).alias("trust"), F.sum((F.col("ruled") == "block").cast("double")).alias("distrust")
    )
    ranks = propagate(host_edges(pages), seeds, tolerance)
    bad = F.col("distrust") > max_distrust * (F.col("trust") + F.col("distrust"))
    out = decided.join(ranks, "host", "left")
    verdict = F.coalesce("ruled", F.when(bad, "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "verdict string, host string, path string"))
