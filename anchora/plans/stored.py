"""Queries that write tables to the shared folder, as files, runs, vectors or streams, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchora.operators import anchor, audit, graph, history, profile, retrieve, score
from anchora.plans import bind
from anchora.plans.catalog import _REPLIES, _RESOLUTION, _replies, _resolution, _table, registered
from anchora.plans.tables import large, shared_dir, written
from anchora.sources import readers, runs
from anchora.streaming import streams


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/anchora-{uuid.uuid4().hex}"


def _json(rows: DataFrame, **options) -> str:
    """``rows`` as JSON lines in a new shared folder."""
    path = _folder(rows.sparkSession)
    rows.write.options(**options).json(path)
    return path


# Files ---------------------------------------------------------------------------------------------------

_QUOTED = bind.ctes("claims", "sources") + ", q AS (SELECT c.*, substr(text, evidence_start + 1, evidence_end - evidence_start) AS evidence FROM claims c JOIN sources s ON c.source_id = s.id)"
_ID = """substr(sha256(source_id || chr(0) || evidence || chr(0) || subject || chr(0) || predicate || chr(0) || coalesce(object, chr(0) || 'NULL' || chr(0)) || chr(0) || polarity || chr(0) || mode || chr(0) || attribution), 1, 16)"""


def _claim_lines(spark, sf_dir) -> DataFrame:
    """Every claim with its quote as a line of type claim, and a header line before them."""
    c = retrieve.with_evidence(bind.claims(spark, sf_dir), bind.sources(spark, sf_dir)).where("evidence is not null")
    c = c.select(F.lit("claim").alias("type"), *(x for x in c.columns if x in readers.CLAIM_LINE and x not in ("claim_id", "book", "chapter")), F.col("ord").alias("_ord"))
    header = spark.range(1).select(F.lit("header").alias("type"), F.lit(0).cast("long").alias("_ord"))
    return c.unionByName(header, allowMissingColumns=True).orderBy("_ord").drop("_ord")


@registered(_QUOTED + f" SELECT {_ID} AS claim_id, row_number() OVER (ORDER BY ord) - 1 AS ord, subject, evidence_start FROM q")
def claim_lines(spark, sf_dir):
    """Claims written in many files and read back in the order of their lines."""
    lines = _json(_claim_lines(spark, sf_dir), compression="gzip")  # a line repeats every field's name
    return readers.read_claims(spark, lines).select("claim_id", "ord", "subject", "evidence_start")


@registered(bind.ctes("claims") + f", {_RESOLUTION} SELECT mention, entity_id FROM resolution")
def entity_lines(spark, sf_dir):
    r = _resolution(bind.claims(spark, sf_dir)).groupBy("entity_id").agg(F.collect_list("mention").alias("mentions"))
    twice = F.concat("mentions", F.slice("mentions", 1, 1))  # a mention that is listed twice collapses
    return readers.read_entities(spark, _json(r.select(F.lit("entity").alias("type"), twice.alias("mentions")))).select("mention", "entity_id")


@registered(
    bind.ctes("sources") + " SELECT id, book, array_to_string(list_sort(concepts), ',') AS concepts, src_rank FROM (SELECT id, book, [lower(book)] || CASE WHEN chapter % 2 = 0 THEN ['even'] ELSE [] END AS concepts, 0 AS src_rank FROM sources "
    "UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), NULL, [], 1 FROM part) x"
)
def tagged_sources(spark, sf_dir):
    """Two files of sources, one of them with concept tags, one table after the other."""
    s = bind.sources(spark, sf_dir)
    tags = F.when(F.col("chapter") % 2 == 0, F.array(F.lower("book"), F.lit("even"))).otherwise(F.array(F.lower("book")))
    first = readers.read_tagged_sources(spark, _json(s.select("id", "book", "chapter", "text", tags.alias("concepts"))))
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text"))
    return readers.list_sources(first, readers.read_tagged_sources(spark, _json(parts))).select("id", "book", F.array_join(F.array_sort("concepts"), ",").alias("concepts"), "src_rank")


@registered(
    "SELECT 'o' || CAST(o_orderkey AS STRING) AS source_id, 'order of ' || CAST(o_custkey AS STRING) AS subject, strpos('Order ' || CAST(o_orderkey AS STRING) || ' has priority ' || o_orderpriority || ', ', ', ') + 1 AS evidence_start, "
    "strpos('Order ' || CAST(o_orderkey AS STRING) || ' has priority ' || o_orderpriority || ', ', ', ') + 1 + length('was placed by customer ' || CAST(o_custkey AS STRING)) AS evidence_end FROM orders"
)
def gold_claims(spark, sf_dir):
    """A gold claim for each order, whose quote is found in its text once."""
    o = _table(spark, sf_dir, "orders")
    quote = F.concat(F.lit("was placed by customer "), F.col("o_custkey").cast("string"))
    fixed = {"type": "claim", "predicate": "is", "verb_phrase": "is", "polarity": "affirmed", "mode": "assertion", "attribution": "course"}
    g = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("subject"), quote.alias("evidence"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    return readers.read_gold_claims(spark, _json(g), bind.sources(spark, sf_dir)).select("source_id", "subject", F.col("evidence_start").cast("long").alias("evidence_start"), F.col("evidence_end").cast("long").alias("evidence_end"))


@registered("SELECT p_name AS left, p_name || ' of ' || p_type AS right, count(*) % 2 = 0 AS same FROM part GROUP BY 1, 2")
def gold_pairs(spark, sf_dir):
    p = _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("left"), F.concat("p_name", F.lit(" of "), "p_type").alias("right")).agg((F.count("*") % 2 == 0).alias("same"))
    mentions = p.select(F.col("left").alias("mention")).union(p.select("right"))
    return readers.read_gold_pairs(spark, _json(p), mentions)


@registered("SELECT 'customer ' || CAST(c_custkey AS STRING) AS situation, lower(c_mktsegment) || ',buying' AS concepts FROM customer")
def gold_situations(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("  customer \n"), F.col("c_custkey").cast("string")).alias("situation"), F.array(F.lower("c_mktsegment"), F.lit(" "), F.lit(" buying")).alias("concepts"))
    return readers.read_gold_situations(spark, _json(rows)).select("situation", F.array_join("concepts", ",").alias("concepts"))


@registered("SELECT 'k' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'sufficient' ELSE 'absent' END AS corpus_reality, CAST(c_custkey % 3 + 1 AS INT) AS n_behaviours FROM customer")
def case_lines(spark, sf_dir):
    known = ["answers", "abstains", "asks"]
    c = _table(spark, sf_dir, "customer")
    rows = c.select(
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("question"), F.when(F.col("c_nationkey") % 2 == 0, "sufficient").otherwise("absent").alias("corpus_reality"),
        F.slice(F.array(*map(F.lit, known)), F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int")).alias("expected_behavior"),
    )
    return readers.read_cases(spark, _json(rows), known, ["sufficient", "absent"]).select("id", "corpus_reality", F.size("expected_behavior").alias("n_behaviours"))


@registered(
    bind.ctes("claims") + " SELECT c.claim_id AS fixture_id, CASE WHEN c.ord % 3 = 0 THEN 'none' WHEN c.ord % 3 = 1 THEN 'blank' ELSE 'named' END AS approval FROM claims c WHERE c.ord % 3 < 2"
)
def unapproved_fixtures(spark, sf_dir):
    """Fixtures read from their lines, of which nobody approved."""
    c = bind.claims(spark, sf_dir)
    k = F.col("ord") % 3
    rows = c.select(F.col("claim_id").alias("fixture_id"), F.when(k == 1, " ").when(k == 2, "someone").alias("approved_by"))
    found = audit.unapproved_fixtures(readers.read_fixtures(spark, _json(rows), "fixture_id string, approved_by string"))
    return found.select("fixture_id", F.when(F.col("approved_by").isNull(), "none").otherwise("blank").alias("approval"))


@registered(bind.ctes("claims") + " SELECT source_id AS case_id, count(*) AS n_cited, max(claim_id) AS last FROM claims GROUP BY source_id")
def answer_records(spark, sf_dir):
    c = bind.claims(spark, sf_dir).groupBy(F.col("source_id").alias("case_id")).agg(F.collect_list(F.struct("claim_id", "source_id")).alias("cited_claims"))
    a = readers.read_answers(spark, _json(c.withColumn("answer", F.concat(F.lit("See "), "case_id"))))
    return a.select("case_id", F.explode("cited").alias("c")).groupBy("case_id").agg(F.count("*").alias("n_cited"), F.max("c.claim_id").alias("last"))


@registered("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, max(row_number) AS last FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_number FROM conversations) x GROUP BY conv_id")
def message_tables(spark, sf_dir):
    m = history.sequence_numbers(readers.read_messages(spark, f"{sf_dir}/conversations.parquet"))
    return m.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("sequence").cast("long").alias("last"))


# Replies -------------------------------------------------------------------------------------------------


@registered(
    "SELECT event_id AS key, CASE WHEN event_id % 7 IN (1, 2) OR props IS NULL THEN NULL WHEN event_id % 7 = 3 THEN 'K,other' ELSE 'k' || CAST(props ->> '$.k' AS STRING) || ',' || event_type END AS concepts FROM events"
)
def concept_replies(spark, sf_dir):
    """A reply for each event, with what its JSON properties say; some are cut, some hold a number, some repeat a concept."""
    e = _table(spark, sf_dir, "events").where("props is not null").select("event_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))
    named = F.to_json(F.struct(F.array(F.concat(F.lit(" k"), "k"), F.col("event_type")).alias("concepts")))
    n = F.col("event_id") % 7
    reply = F.when(n == 1, F.substring(named, 1, 12)).when(n == 2, F.lit('{"concepts": ["a", 1]}')).when(n == 3, F.lit('{"concepts": ["K", " k ", "", "other"]}')).otherwise(named)
    return anchor.parse_concept_replies(e.select(F.col("event_id").alias("key"), reply.alias("reply"))).select("key", F.array_join("concepts", ",").alias("concepts"))


@registered(
    "SELECT p_partkey AS key, p_name AS left, p_type AS right, p_size % 2 = 0 AS same FROM part WHERE p_partkey % 5 <> 2 AND p_partkey % 5 <> 3 UNION ALL SELECT p_partkey, p_type, p_name, true FROM part WHERE p_partkey % 5 <> 2"
)
def verdict_replies(spark, sf_dir):
    """Two verdicts of each part's reply; of some the first has no boolean, and some replies are cut."""
    p, n = _table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    same = F.when(n == 3, F.lit('"yes"')).otherwise((F.col("p_size") % 2 == 0).cast("string"))
    reply = F.format_string('{"verdicts": [{"left": "%s", "right": "%s", "same": %s}, {"left": "%s", "right": "%s", "same": true}]}', "p_name", "p_type", same, "p_type", "p_name")
    return anchor.parse_verdict_replies(p.select(F.col("p_partkey").alias("key"), F.when(n == 2, F.substring(reply, 1, 30)).otherwise(reply).alias("reply")))


@registered(
    _QUOTED + ", m AS (SELECT q.claim_id, 'o' || CAST(CAST(substr(source_id, 2) AS BIGINT) + CASE WHEN ord % 4 = 0 THEN 1000000000 ELSE 0 END AS STRING) AS source_id, evidence, text FROM q JOIN sources s ON q.source_id = s.id) "
    "SELECT claim_id, source_id, CASE WHEN trim(evidence) = '' OR length(source_id) > 10 THEN 'not_found' WHEN strpos(substr(text, strpos(text, evidence) + 1), evidence) > 0 THEN 'ambiguous' END AS reason FROM m"
)
def reanchored_claims(spark, sf_dir):
    """Quotes anchored again after a fourth of them moved to sources that are not there."""
    q = retrieve.with_evidence(bind.claims(spark, sf_dir), bind.sources(spark, sf_dir)).where("evidence is not null").select("claim_id", F.concat("source_id", F.when(F.col("ord") % 4 == 0, "x").otherwise("")).alias("source_id"), "evidence", "evidence_start", "evidence_end")
    number = F.regexp_extract("source_id", "[0-9]+", 0).cast("long")
    mapping = q.where("source_id like '%x'").select("source_id", F.concat(F.lit("o"), (number + 1_000_000_000).cast("string")).alias("new_id")).distinct()
    return anchor.reanchor(q, mapping, bind.sources(spark, sf_dir)).select("claim_id", "source_id", "reason")


@registered(_QUOTED + " SELECT claim_id FROM q WHERE ord % 4 = 0 AND mode = 'conditional' AND predicate <> 'requires' AND contains(lower(subject), 'widget')")
def rerouted_descriptions(spark, sf_dir):
    """Conditional claims about one concept whose quote hinges on a condition."""
    q = retrieve.with_evidence(bind.claims(spark, sf_dir), bind.sources(spark, sf_dir)).where("evidence is not null")
    ending = F.when(F.col("ord") % 4 == 0, " unless").when(F.col("ord") % 4 == 1, " whenever").otherwise("")
    q = q.withColumns({"evidence": F.concat("evidence", ending), "subject": F.when(F.contains(F.lower("subject"), F.lit("widget")), "Widget").otherwise(F.col("subject"))})
    return profile.rerouted_descriptions(q, "widget").select("claim_id")


@registered("SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY first, event_type) AS ordinal FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) x")
def first_appearances(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return audit.first_appearance(e, "user_id", "event_type", "event_id").select("user_id", "event_type", F.col("ordinal").cast("long").alias("ordinal"))


@registered("SELECT event_id, CASE WHEN value > 20 THEN 'pass' WHEN value > 4 THEN 'fail' ELSE 'not_applicable' END AS human FROM events")
def draft_labels(spark, sf_dir):
    status = F.when(F.col("value") > 20, "pass").when(F.col("value") > 4, "fail").otherwise("not_evaluated")
    return audit.draft_labels(_table(spark, sf_dir, "events").select("event_id", status.alias("status"))).select("event_id", "human")


# Runs and graphs -----------------------------------------------------------------------------------------


@registered(_REPLIES.removesuffix(" SELECT status, reason, count(*) AS n FROM o GROUP BY status, reason") + " SELECT status, count(*) AS n, (SELECT count(*) FROM o WHERE status = 'claim') AS n_claim, (SELECT count(*) FROM bad) AS n_failed, CAST(1 AS BIGINT) AS n_scores FROM o GROUP BY status")
def extraction_run(spark, sf_dir):
    """An extraction written as a run, beside an attempt that was never committed, and read back with its header."""
    sources = bind.sources(spark, sf_dir)
    outcomes = written(anchor.extract_claims(_replies(spark, sf_dir), sources).select("source_id", "status", "reason", "claim_id"))
    path = _folder(spark)
    runs.stage({"rows": outcomes.limit(3)}, path)
    scores = sources.agg(F.lit("loose").alias("tier"), F.count("*").alias("tp"))
    readers.write_extraction_run(outcomes, scores, sources, path, "first")
    run = runs.read_run(spark, path, "first")
    header = run["header"].select("n_claim", "n_failed", F.size("scores").cast("long").alias("n_scores"))
    return run["rows"].groupBy("status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(header))


@registered(bind.ctes("claims") + f", {_RESOLUTION} SELECT entity_id, array_to_string(members, ',') AS mentions, (SELECT count(*) FROM mentions) AS n_mentions, (SELECT count(*) FROM groups) AS n_entities FROM (SELECT substr(sha256(array_to_string(members, chr(0))), 1, 16) AS entity_id, members FROM groups) g")
def resolution_run(spark, sf_dir):
    r = _resolution(bind.claims(spark, sf_dir)).select("mention", "entity_id")
    path = _folder(spark)
    readers.write_resolution_run(r, r.limit(0), 0, r.agg(F.count("*").alias("tp")), path, "first")
    run = runs.read_run(spark, path, "first")
    return run["rows"].select("entity_id", F.array_join("mentions", ",").alias("mentions")).crossJoin(F.broadcast(run["header"].select("n_mentions", "n_entities")))


@registered("SELECT o_custkey AS situation, array_to_string(list_sort(list(DISTINCT lower(o_orderpriority))), ',') AS concepts, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_situations FROM orders GROUP BY o_custkey")
def mapping_run(spark, sf_dir):
    s = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("situation")).agg(F.array_sort(F.collect_set(F.lower("o_orderpriority"))).alias("concepts"))
    path = _folder(spark)
    readers.write_mapping_run(s, score.score_mapping(s, s), path, "first")
    run = runs.read_run(spark, path, "first")
    return run["rows"].select("situation", F.array_join("concepts", ",").alias("concepts")).crossJoin(F.broadcast(run["header"].select("n_situations")))


@registered("SELECT user_id AS case_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (value > 20) AS BIGINT) AS passed, (SELECT count(DISTINCT user_id) FROM events) AS n_cases FROM events GROUP BY user_id")
def case_run(spark, sf_dir):
    criteria = _table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("name"), F.lit("gating").alias("kind"), F.when(F.col("value") > 20, "pass").otherwise("fail").alias("status"), F.col("value").alias("score"))
    path = _folder(spark)
    readers.write_case_run(criteria, audit.case_report(criteria, criteria.select("case_id", F.lit("all").alias("intent")).distinct()), path, "first")
    run = runs.read_run(spark, path, "first")
    each = run["rows"].select("case_id", F.explode("criteria").alias("c")).groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("c.status") == "pass").alias("passed"))
    return each.crossJoin(F.broadcast(run["header"].select("n_cases")))


_DRAWN = """g AS (SELECT c.*, 'e:' || s.entity_id AS src, 'e:' || o.entity_id AS dst FROM claims c JOIN resolution s ON subject = s.mention LEFT JOIN resolution o ON object = o.mention)"""


@registered(
    bind.ctes("claims", "sources") + f", {_RESOLUTION}, {_DRAWN}, ok AS (SELECT g.* FROM g JOIN sources ON source_id = id WHERE evidence_end <= length(text)) "
    "SELECT 'edges' AS table_name, count(*) AS n FROM ok WHERE dst IS NOT NULL UNION ALL SELECT 'non_projectable', count(*) FROM ok WHERE dst IS NULL UNION ALL SELECT 'nodes', count(*) FROM (SELECT src FROM ok UNION SELECT dst FROM ok WHERE dst IS NOT NULL) n "
    "UNION ALL SELECT 'passages', count(*) FROM (SELECT DISTINCT source_id, evidence_start, evidence_end FROM ok) p UNION ALL SELECT 'counts', 1 UNION ALL SELECT 'metadata', 1"
)
def graph_tables(spark, sf_dir):
    """The whole graph artifact committed and read back; the few claims whose span ends behind their text are left out."""
    sources = bind.sources(spark, sf_dir)
    # the lengths come to the claims where these lie by source, before they are written
    sizes = large(sources.select(F.col("id").alias("source_id"), F.length("text").alias("_n")))
    claims = written(bind.claims(spark, sf_dir).join(sizes, "source_id", "left"))
    ok = claims.where("evidence_end <= _n").drop("_n")
    path = _folder(spark)
    readers.write_graph(graph.artifact(ok, _resolution(claims), sources), path)
    tables = readers.read_graph(spark, path, graph.GRAPH_VERSION)
    out = None
    for name, rows in tables.items():
        n = rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@registered(
    "SELECT version, CAST(width AS INT) AS width, embedded, total FROM (SELECT 1 AS version, any_value(len(embedding)) AS width, count(*) AS embedded, count(*) AS total FROM embeddings WHERE vec_id % 3 <> 0 "
    "UNION ALL SELECT 2, any_value(len(embedding)), count(*) FILTER (vec_id % 3 = 0 OR vec_id % 10 = 1), count(*) FROM embeddings WHERE vec_id % 7 <> 0 "
    "UNION ALL SELECT 3, 2, count(*), count(*) FROM embeddings) v"
)
def vector_store(spark, sf_dir):
    """Three versions of a vector store: two thirds of the vectors; then all but every seventh, every tenth text being new; then
    all by a model of two places. What each embedded, and what it holds."""
    e = _table(spark, sf_dir, "embeddings").withColumn("claim_id", F.concat(F.lit("c"), F.col("vec_id").cast("string")))
    path = _folder(spark)
    claims = lambda text: e.select("claim_id", "vec_id", text.alias("text"))
    plain, edited = F.concat(F.lit("text "), "claim_id"), F.when(F.col("vec_id") % 10 == 1, "new").otherwise(F.concat(F.lit("text "), "claim_id"))
    whole = lambda c: c.join(e.select("claim_id", F.col("embedding").cast("array<float>").alias("vec")), "claim_id")
    runs.store_vectors(spark, path, claims(plain).where("vec_id % 3 <> 0"), whole, "m")
    runs.store_vectors(spark, path, claims(edited).where("vec_id % 7 <> 0"), whole, "m")
    short = lambda c: c.join(e.select("claim_id", F.slice("embedding", 1, 2).cast("array<float>").alias("vec")), "claim_id")
    runs.store_vectors(spark, path, claims(edited), short, "m")
    return runs.store_versions(spark, path, "m").select("version", "width", "embedded", "total")


# Streams -------------------------------------------------------------------------------------------------


@registered(_REPLIES)
def stream_extraction(spark, sf_dir):
    """Replies that arrive in two loads, extracted by a stream that stops in between; the outcomes that it wrote."""
    replies, path = _replies(spark, sf_dir), _folder(spark)
    for load in (0, 1):
        replies.where(F.pmod(F.xxhash64("key"), F.lit(2)) == load).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(replies.schema).parquet(f"{path}/in")
        out = streams.drained(stream, path, lambda s: streams.stream_extract(s, bind.sources(spark, sf_dir)).select("source_id", "status", "reason"))
    return anchor.extraction_summary(out)


@registered("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, role, text FROM conversations")
def stream_messages(spark, sf_dir):
    """Messages numbered by a stream: the first two turns of all conversations arrive, then the others."""
    m = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("arrival"), "role", "text")
    path = _folder(spark)
    for early in (True, False):
        m.where(F.col("arrival") < 2 if early else F.col("arrival") >= 2).write.mode("append").parquet(f"{path}/in")
        out = streams.drained(spark.readStream.schema(m.schema).parquet(f"{path}/in"), path, streams.stream_append_messages)
    return out
