"""Quality rules, line first, in native column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchora.llm.base import SPACE, words_of

#: Phrases of boilerplate lines (fixed values).
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "subscribe to our newsletter",
    "click here",
    "lorem ipsum",
)


#: Every place in an array that Spark can hold; equal hash bits are only candidates, whose words are compared.
_POSITION = (1 << 31) - 1
_HASH = (1 << 62) - 1 - _POSITION


def window_keys(words: Column) -> Column:
    """A sorted long for each three-word window: 31 hash bits above, the position below. ``words``: a plain column."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(_HASH)).bitwiseOR(i.cast("long")),
    )
    return F.sort_array(windows)


_SYMBOL = r"[#*$%&|<>~^=_+{}\[\]\\]"
_BAR = "[|»›•·]"


def line_faults(line: Column, min_words: int = 4, max_symbol_share: float = 0.15, min_shout: int = 20) -> dict[str, Column]:
    """The rules that a line can fail.

    punctuation: too large a share of a line of some words is symbols; navigation: items between bars or arrows;
    shouting: a longer line in capitals only; boilerplate: a stock phrase."""
    spaces = F.length(line) - F.length(F.regexp_replace(line, r"[ \t]", ""))
    chars = F.greatest(F.length(line) - spaces, F.lit(1))
    symbols = F.length(line) - F.length(F.regexp_replace(line, _SYMBOL, ""))
    bars = F.length(line) - F.length(F.regexp_replace(line, _BAR, ""))
    low = F.lower(line)
    stock = F.lit(False)
    for phrase in BOILERPLATE:
        stock = stock | low.contains(phrase)
    return {
        "punctuation": line.rlike(_SYMBOL) & (spaces + 1 >= min_words) & (symbols / chars > max_symbol_share),
        "navigation": line.rlike(_BAR) & (bars >= 3) & (bars * 5 > spaces + 1),
        "shouting": (F.length(line) >= min_shout) & (F.upper(line) == line) & (low != line),
        "boilerplate": stock,
    }


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.5) -> DataFrame:
    """Clean every text line by line, then judge what is left.

    Per row of ``docs`` (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost (share of word characters in removed lines and repeats of earlier lines), cleaned text and kept.
    Words are runs of characters other than ASCII white space. A null or empty text has zero counts, is
    base_failed and not kept. A very long text is one row's work, in proportion to its words. Repeated rows stay repeated; an empty table gives none; other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", words_of(F.col("text")).alias("w"), F.split("text", "\n").alias("lines"))
    bare = lambda c: F.regexp_replace(c, r"[\x20\x09-\x0D]+", "")
    d = d.select("*", window_keys(F.col("w")).alias("s"), F.filter("lines", lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("full"))
    twins = F.transform("s", lambda v, j: F.when(F.get("s", j + 1) - v <= _POSITION, j).otherwise(-1))
    d = d.select("*", F.array_remove(twins, -1).alias("twins"), F.array_distinct("full").alias("once"))
    at = lambda j: F.get("s", j).bitwiseAND(F.lit(_POSITION)).cast("int")
    d = d.select("*", F.array_distinct(F.flatten(F.transform("twins", lambda j: F.array(at(j), at(j + 1))))).alias("near"))
    window = lambda p: F.struct(F.get("w", p).alias("a"), F.get("w", p + 1).alias("b"), F.get("w", p + 2).alias("c"), p.alias("p"))
    d = d.select(
        "*",
        F.sort_array(F.transform("near", window)).alias("sorted"),
        F.filter("once", lambda x: ~_any(line_faults(x))).alias("good"),
    )
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    hits = F.filter("sorted", lambda x, j: same(x, F.get("sorted", j - 1)) | same(x, F.get("sorted", j + 1)))
    d = d.select("*", F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))).alias("rep"))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(bare(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size("once")).cast("long").alias("n_dup_lines"),
        F.col("rep").cast("long").alias("n_repeat_words"),
        F.array_join("good", "\n").alias("cleaned"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    d = d.withColumn("lost", F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1 - F.length(bare(F.col("cleaned"))) / F.col("word_chars")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))


def _any(faults: dict[str, Column]) -> Column:
    out = F.lit(False)
    for fault in faults.values():
        out = out | fault
    return out


def op6_quality_rules(spark, sf_dir):
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")
