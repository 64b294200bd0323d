"""Readers of claim corpora, gold sets and runs, and writers of runs and graphs.

Readers check what they read inside the job: a bad line fails it (``raise_error``) and nothing is collected first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.functions.ids import annotation_id, claim_id, entity_id
from anchora.functions.text import clean_paragraph, is_blockquote, squeeze
from anchora.operators.anchor import ATTRIBUTIONS, MODES, POLARITIES, PREDICATES, anchor_evidence
from anchora.operators.profile import passages_hash
from anchora.plans.tables import must, written
from anchora.sources.runs import commit, read_committed, stage, write_run

CLAIM_LINE = (
    "type string, claim_id string, source_id string, subject string, predicate string, object string, verb_phrase string, polarity string, mode string, "
    "attribution string, evidence string, evidence_start int, evidence_end int"
)
CASE = (
    "id string, question string, intent string, corpus_reality string, expected_behavior array<string>, prohibited_behavior array<string>, must_include_source_ids array<string>, "
    "must_include_any_source_ids array<string>, may_include_source_ids array<string>, must_include_claim_ids array<string>, must_include_any_claim_ids array<string>, may_include_claim_ids array<string>"
)
SIGNATURE = "struct<subject:string,predicate:string,object:string,polarity:string,mode:string,attribution:string>"
ENTRY = (
    f"struct<kind:string,evidence:string,support:string,resolution:string,condition_text:string,scope:string,attaches_to:{SIGNATURE},mention:string,referent:string,base_concept:string,"
    f"reframed_proposition:{SIGNATURE},reframed_mode:string,description_text:string,describes:string>"
)
DERIVED_GOLD = (
    f"schema_version int, source_id string, literal_status string, derived_status string, shared array<{ENTRY}>, variants array<struct<variant_id:string,entries:array<{ENTRY}>>>, "
    "exhaustive boolean, adjudication_history array<array<string>>"
)
#: Version of derived gold files (a fixed value of their format).
DERIVED_VERSION = 2
ANSWER = (
    "case_id string, answer string, concepts array<string>, cited_claims array<struct<claim_id:string,source_id:string>>, "
    "inferred_chains array<struct<claim_ids:array<string>>>, citation_diagnostics struct<unknown_ids:array<string>,unused_claim_ids:array<string>>"
)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def line_order(rows: DataFrame) -> DataFrame:
    """``rows`` of text files with ord: each row's place from 0 in all files by name, and in its file.

    Spark deals a file in blocks and orders these by size. A block's rows stand together in one partition, so a row's place
    is its number within the block and the rows of all blocks before it; there is one row a block in that sum. The rows
    are written once, numbered, so that both uses see the same numbers."""
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    numbered = written(rows.select("*", *block, F.monotonically_increasing_id().alias("_n")))
    blocks = numbered.groupBy("_file", "_block").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_file", "_block")) - F.col("_rows")
    starts = blocks.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    return numbered.join(starts, ["_file", "_block"]).withColumn("ord", F.col("_n") + F.col("_shift")).drop("_file", "_block", "_n", "_shift")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of JSON-lines files; ids are computed anew and ord follows the files by name and their lines."""
    good = F.col("predicate").isin(*PREDICATES) & F.col("polarity").isin(*POLARITIES) & F.col("mode").isin(*MODES) & F.col("attribution").isin(*ATTRIBUTIONS)
    lines = _lines(spark, path, CLAIM_LINE)
    c = line_order(lines.where("type = 'claim'"))
    c = must(c, good & F.col("source_id").isNotNull() & F.col("subject").isNotNull() & F.col("evidence").isNotNull(), "bad claim line")
    return c.withColumn("claim_id", claim_id(*(F.col(x) for x in ("source_id", "evidence", "subject", "predicate", "object", "polarity", "mode", "attribution")))).drop("type")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """(mention, entity_id) of the entity lines; ids come from the members, repeats in a list collapse."""
    e = _lines(spark, path, "type string, mentions array<string>").where("type = 'entity'")
    return e.select(entity_id(F.col("mentions")).alias("entity_id"), F.explode(F.array_distinct("mentions")).alias("mention"))


def read_run_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The header row of a run, wherever in the file it stands."""
    return _lines(spark, path, schema).where("type = 'header'").limit(1)


def read_passages(spark: SparkSession, path: str, chapter_key: str = "ref") -> DataFrame:
    """Paragraphs of front-matter markdown files: id, chapter, section, paragraph, text.

    A block quote joins the block before it; numbers count merged blocks, also those that are empty once cleaned."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"(?m)^---\s*$", 3).alias("p"))
    ref = F.regexp_extract(F.get("p", 1), rf"(?m)^{chapter_key}:\s*T(\d+)\.(\d+)\s*$", 0)
    files = files.withColumns({"chapter": F.regexp_extract(F.get("p", 1), rf"(?m)^{chapter_key}:\s*T(\d+)\.(\d+)\s*$", 1), "section": F.regexp_extract(F.get("p", 1), rf"(?m)^{chapter_key}:\s*T(\d+)\.(\d+)\s*$", 2)})
    files = must(files, ref != "", "bad reference").select("file", F.col("chapter").cast("int").alias("chapter"), F.col("section").cast("int").alias("section"), F.get("p", 2).alias("body"))
    return number_paragraphs(files)


def number_paragraphs(files: DataFrame) -> DataFrame:
    """Numbered paragraphs of (file, chapter, section, body); a file is one group, as its paragraphs count on."""
    blocks = files.select("file", "chapter", "section", F.posexplode(F.split("body", r"\n\s*\n")).alias("pos", "block")).where(squeeze(F.col("block")) != "")
    order = W.partitionBy("file").orderBy("pos")
    starts = (~is_blockquote(F.col("block")) | (F.row_number().over(order) == 1)).cast("int")
    numbered = blocks.withColumn("starts", starts).withColumn("paragraph", F.sum("starts").over(order).cast("int"))
    merged = numbered.groupBy("file", "chapter", "section", "paragraph").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b"))
    text = clean_paragraph(F.array_join(F.transform("b", lambda x: x["block"]), "\n"))
    out = merged.select(F.format_string("t%d-%d-%d", "chapter", "section", "paragraph").alias("id"), "file", "chapter", "section", "paragraph", text.alias("text"))
    return out.where("text <> ''")


def list_sources(*tables: DataFrame) -> DataFrame:
    """Source tables one after the other; src_rank keeps their order."""
    out = None
    for rank, table in enumerate(tables):
        part = table.withColumn("src_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_gold_claims(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Gold claims anchored in their sources; a quote that is not found, or not alone, fails the job."""
    anchored = anchor_evidence(read_claims(spark, path).drop("evidence_start", "evidence_end"), sources)
    return must(anchored, F.col("reason").isNull(), "gold claim is not anchored").drop("reason")


def read_gold_pairs(spark: SparkSession, path: str, mentions: DataFrame) -> DataFrame:
    """Gold pairs whose two mentions differ and are known."""
    g = must(_lines(spark, path, "left string, right string, same boolean"), (F.col("left") != F.col("right")) & F.col("same").isNotNull(), "bad pair")
    m = mentions.select("mention").distinct()
    known = lambda d, c: d.join(m.select(F.col("mention").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    return must(known(known(g, "left"), "right"), F.col("_left") & F.col("_right"), "unknown mention").select("left", "right", "same")


def read_gold_situations(spark: SparkSession, path: str) -> DataFrame:
    s = _lines(spark, path, "situation string, concepts array<string>")
    s = s.select(squeeze(F.col("situation")).alias("situation"), F.filter(F.transform("concepts", squeeze), lambda c: c != "").alias("concepts"))
    return must(s, (F.col("situation") != "") & (F.size("concepts") > 0), "bad situation")


def read_cases(spark: SparkSession, path: str, behaviours: list[str], realities: list[str]) -> DataFrame:
    """Cases with known behaviours and corpus reality, and ids that are there once."""
    c = _lines(spark, path, CASE).where("id is not null")
    said = F.concat(F.coalesce("expected_behavior", F.array().cast("array<string>")), F.coalesce("prohibited_behavior", F.array().cast("array<string>")))
    c = must(c, (F.size(F.array_except(said, F.array(*map(F.lit, behaviours)))) == 0) & F.col("corpus_reality").isin(*realities), "bad case")
    return must(c.withColumn("_n", F.count("*").over(W.partitionBy("id"))), F.col("_n") == 1, "case id repeats").drop("_n")


def read_fixtures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    f = _lines(spark, path, schema).where("fixture_id is not null")
    return must(f.withColumn("_n", F.count("*").over(W.partitionBy("fixture_id"))), F.col("_n") == 1, "fixture id repeats").drop("_n")


def read_tagged_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources with concept tags, of JSON lines; ids are there once and texts are not blank."""
    s = _lines(spark, path, "id string, book string, chapter int, verse int, section int, paragraph int, edition string, text string, concepts array<string>").where("id is not null")
    s = must(s, squeeze(F.col("text")) != "", "source without text")
    return must(s.withColumn("_n", F.count("*").over(W.partitionBy("id"))), F.col("_n") == 1, "source id repeats").drop("_n").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def read_derived_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``golds`` (source_id, literal_status, derived_status, exhaustive, adjudication_history) and their ``entries`` with
    ids computed anew; shared ones have a null variant_id. Files with entries must be of DERIVED_VERSION."""
    g = spark.read.schema(DERIVED_GOLD).option("mode", "FAILFAST").json(path, multiLine=True)
    none = F.array().cast(f"array<{ENTRY}>")
    g = g.withColumns({"shared": F.coalesce("shared", none), "variants": F.coalesce("variants", F.array().cast(f"array<struct<variant_id:string,entries:array<{ENTRY}>>>"))})
    empty = (F.size("shared") == 0) & (F.size("variants") == 0)
    g = must(g, F.col("source_id").isNotNull() & (empty | (F.col("schema_version") == DERIVED_VERSION)), "derived gold of another version")
    shared = g.select("source_id", F.lit(None).cast("string").alias("variant_id"), F.explode("shared").alias("e"))
    own = g.select("source_id", F.explode("variants").alias("v")).select("source_id", "v.variant_id", F.explode("v.entries").alias("e"))
    entries = shared.union(own).select("source_id", "variant_id", "e.*")
    whole = F.struct("source_id", *(F.col(f) for f in entries.columns if f not in ("source_id", "variant_id")))
    return {"golds": g.select("source_id", "literal_status", "derived_status", F.coalesce("exhaustive", F.lit(False)).alias("exhaustive"), "adjudication_history"), "entries": entries.withColumn("annotation_id", annotation_id(whole))}


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer records of JSON lines, with the claims that each cites; a record without answer or claims' ids fails."""
    a = _lines(spark, path, ANSWER).where("case_id is not null")
    named = F.forall(F.coalesce("cited_claims", F.array().cast("array<struct<claim_id:string,source_id:string>>")), lambda c: c["claim_id"].isNotNull() & c["source_id"].isNotNull())
    return must(a, F.col("answer").isNotNull() & named, "bad answer record").withColumnRenamed("cited_claims", "cited")


#: Tables of a written graph and the columns that each must have.
GRAPH_COLUMNS = {
    "nodes": ("node_id", "label", "expressions"), "edges": ("claim_id", "src", "dst", "predicate", "source_id"), "non_projectable": ("claim_id", "reason", "source_id"),
    "passages": ("source_id", "evidence_start", "evidence_end", "evidence"), "counts": ("claims", "edges", "nodes"), "metadata": ("version", "content_hash"),
}


def read_graph(spark: SparkSession, path: str, version: int, name: str = "graph") -> dict[str, DataFrame]:
    """Tables of a committed graph of the given schema version; one without the columns it must have is an error."""
    tables = read_committed(spark, path, name)
    for t, columns in GRAPH_COLUMNS.items():
        lacking = set(columns) - set(tables[t].columns if t in tables else ())
        if lacking:
            raise ValueError(f"{t} of the graph lacks {sorted(lacking)}")
    return tables | {"metadata": must(tables["metadata"], F.col("version") == version, "graph version")}


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _scores(scores: DataFrame) -> DataFrame:
    """Score rows as one array, for a header."""
    return scores.agg(F.collect_list(F.struct(*scores.columns)).alias("scores"))


def write_extraction_run(outcomes: DataFrame, scores: DataFrame, sources: DataFrame, path: str, run_id: str) -> None:
    """Claims, rejected candidates and failed sources of an extraction, and a header with their numbers, the scores by
    tier and the hash of the passages."""
    n = lambda status: F.count_if(F.col("status") == status).alias(f"n_{status}")
    header = outcomes.agg(n("claim"), n("rejected"), n("failed")).crossJoin(_scores(scores)).crossJoin(passages_hash(sources).withColumnRenamed("content_hash", "passages_hash"))
    write_run(outcomes, header, path, run_id)


def write_resolution_run(resolution: DataFrame, rejected: DataFrame, failed_pairs: int, scores: DataFrame, path: str, run_id: str) -> None:
    """An entity a row with its mentions, and a header with the numbers of mentions, entities, verdicts rejected and pairs
    without a verdict, and the scores."""
    entities = resolution.groupBy("entity_id").agg(F.array_sort(F.collect_set("mention")).alias("mentions"))
    header = resolution.agg(F.countDistinct("mention").alias("n_mentions"), F.countDistinct("entity_id").alias("n_entities")).crossJoin(rejected.agg(F.count("*").alias("n_rejected"))).withColumn("n_failed", F.lit(failed_pairs)).crossJoin(_scores(scores))
    write_run(entities, header, path, run_id)


def write_mapping_run(situations: DataFrame, scores: DataFrame, path: str, run_id: str) -> None:
    """A situation a row (situation, concepts), and a header with their number and the scores."""
    write_run(situations, situations.agg(F.count("*").alias("n_situations")).crossJoin(_scores(scores)), path, run_id)


def write_case_run(criteria: DataFrame, report: DataFrame, path: str, run_id: str) -> None:
    """A case a row with its criteria, and a header with the report by intent."""
    cases = criteria.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("name", "kind", "status", "score"))).alias("criteria"))
    write_run(cases, cases.agg(F.count("*").alias("n_cases")).crossJoin(_scores(report)), path, run_id)


def write_graph(tables: dict[str, DataFrame], path: str, name: str = "graph") -> None:
    """A graph's tables (``graph.artifact``), range-sorted by their keys, as passages are already, and committed together."""
    keys = {"nodes": ["node_id"], "edges": ["claim_id"], "non_projectable": ["claim_id"]}
    ordered = {t: tables[t].orderBy(*keys[t]) if t in keys else tables[t] for t in GRAPH_COLUMNS}
    commit(tables["nodes"].sparkSession, path, name, stage(ordered, path), list(ordered))
