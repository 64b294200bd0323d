"""Readers, writers and streams over files written by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from anchora.sources import readers, runs
from anchora.streaming import streams


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows))
    return str(path)


CLAIM = {"type": "claim", "source_id": "s", "subject": "a", "predicate": "is", "object": None, "verb_phrase": "is", "polarity": "affirmed", "mode": "assertion", "attribution": "course", "evidence": "love"}


def test_claims_and_header(spark, tmp_path):
    path = lines(tmp_path / "c.jsonl", [CLAIM, "", CLAIM | {"evidence": "other"}, {"type": "header", "source_id": "run"}])
    c = readers.read_claims(spark, path)
    assert c.count() == 2 and len({r["claim_id"] for r in c.collect()}) == 2
    assert readers.read_run_header(spark, path, "type string, source_id string").first()["source_id"] == "run"
    with pytest.raises(Exception, match="bad claim line"):
        readers.read_claims(spark, lines(tmp_path / "d.jsonl", [CLAIM | {"predicate": "was"}])).collect()


def test_gold(spark, tmp_path):
    sources = spark.createDataFrame([("s", "all love here")], "id string, text string")
    gold = readers.read_gold_claims(spark, lines(tmp_path / "g.jsonl", [CLAIM]), sources).first()
    assert (gold["evidence_start"], gold["evidence_end"]) == (4, 8)
    with pytest.raises(Exception, match="not anchored"):
        readers.read_gold_claims(spark, lines(tmp_path / "h.jsonl", [CLAIM | {"evidence": "hate"}]), sources).collect()
    mentions = spark.createDataFrame([("a",), ("b",)], "mention string")
    pair = {"left": "a", "right": "b", "same": True}
    assert readers.read_gold_pairs(spark, lines(tmp_path / "p.jsonl", [pair]), mentions).count() == 1
    with pytest.raises(Exception, match="unknown mention"):
        readers.read_gold_pairs(spark, lines(tmp_path / "q.jsonl", [pair | {"right": "z"}]), mentions).collect()


def test_passages(spark, tmp_path):
    (tmp_path / "c.md").write_text("---\nref: T3.2\ntitle: x\n---\nFirst *para*.\n\n> quoted\n> more\n\n***\n\nLast<br/>one.\n")
    got = [(r["id"], r["text"]) for r in readers.read_passages(spark, str(tmp_path / "c.md")).orderBy("paragraph").collect()]
    assert got == [("t3-2-1", "First para. quoted more"), ("t3-2-3", "Last one.")]


def test_only_committed_runs_are_read(spark, tmp_path):
    rows, header = spark.createDataFrame([(1, "claim")], "n int, status string"), spark.createDataFrame([(1,)], "claims int")
    path = f"{tmp_path}/run"
    runs.stage({"rows": rows.union(rows), "header": header}, path)  # a driver that was lost before its commit
    with pytest.raises(ValueError, match="never committed"):
        runs.read_run(spark, path, "r1")
    runs.write_run(rows, header, path, "r1")
    half = runs.stage({"rows": rows.union(rows), "header": header}, path)
    assert runs.read_run(spark, path, "r1")["rows"].count() == 1
    runs.commit(spark, path, "r1", half, ["rows", "header"])  # the same run once more: the first commit stays
    got = runs.read_run(spark, path, "r1")
    assert got["rows"].first()["run_id"] == "r1" and got["rows"].count() == 1 and got["header"].count() == 1
    runs.write_run(rows.limit(0), header, path, "r2")
    assert runs.read_run(spark, path, "r2")["rows"].count() == 0 and runs.committed(spark, path).count() == 2
    attempt = runs.committed(spark, path).where("name = 'r1'").first()["attempt"]
    rows.withColumn("run_id", F.lit("x")).write.mode("append").parquet(f"{path}/attempts/{attempt}/rows")
    with pytest.raises(ValueError, match="has 2 rows and not 1"):
        runs.read_run(spark, path, "r1")


def test_line_order_over_files(spark, tmp_path):
    """Spark orders files by size; ord follows their names, also where a file is dealt in several blocks."""
    want = []
    for name, n in (("a", 3), ("b", 2000), ("c", 40), ("d", 1)):
        own = [CLAIM | {"subject": f"{name}{k}"} for k in range(n)]
        lines(tmp_path / f"{name}.jsonl", [{"type": "header"}, *own])
        want += [c["subject"] for c in own]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = readers.read_claims(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["subject"] for r in sorted(got, key=lambda r: r["ord"])] == want and sorted(r["ord"] for r in got) == list(range(len(want)))


GRAPH_CLAIM = "ord long, claim_id string, source_id string, subject string, predicate string, object string, verb_phrase string, polarity string, mode string, attribution string, evidence_start int, evidence_end int"


def test_graph_artifact(spark, tmp_path):
    from anchora.operators import graph

    row = lambda k, s, o, a=0, b=3: (k, f"c{k}", "s", s, "is", o, "is", "affirmed", "assertion", "course", a, b)
    claims = spark.createDataFrame([row(1, "God", "love"), row(2, "god", None), row(3, "fear", " ", 4, 8), row(4, "fear", "God", 4, 8)], GRAPH_CLAIM)
    resolution = spark.createDataFrame([("God", "g"), ("god", "g"), ("Gd", "g")], "mention string, entity_id string")
    sources = spark.createDataFrame([("s", "T", 1, "all love here")], "id string, book string, chapter int, text string")
    tables = graph.artifact(claims, resolution, sources)
    assert {r["node_id"]: (r["label"], r["expressions"]) for r in tables["nodes"].collect()} == {"e:g": ("Gd", ["Gd", "God", "god"]), "m:love": ("love", ["love"]), "m:fear": ("fear", ["fear"])}
    assert [(r["evidence"], r["before"], r["after"]) for r in tables["passages"].orderBy("evidence_start").collect()] == [("all", "", " love here"), ("love", "all ", " here")]
    counts = tables["counts"].first()
    assert (counts["edges"], counts["missing_object"], counts["not_drawable"], counts["merged"]) == (2, 1, 1, 1)
    assert {tuple(r) for r in graph.undrawn_claims(tables["nodes"], tables["non_projectable"]).collect()} == {("e:g", "c2", "missing_object"), ("m:fear", "c3", "object_not_drawable")}
    readers.write_graph(tables, f"{tmp_path}/graph")
    assert readers.read_graph(spark, f"{tmp_path}/graph", graph.GRAPH_VERSION)["edges"].count() == 2
    with pytest.raises(Exception, match="graph version"):
        readers.read_graph(spark, f"{tmp_path}/graph", 99)["metadata"].collect()
    shuffled = graph.artifact(claims.repartition(3), resolution, sources)
    assert shuffled["metadata"].first() == tables["metadata"].first()
    with pytest.raises(Exception, match="no such evidence"):
        graph.passages(claims.union(spark.createDataFrame([row(5, "a", "b", 10, 99)], GRAPH_CLAIM)), sources).collect()


def test_run_writers(spark, tmp_path):
    sources = spark.createDataFrame([("s", "all love here")], "id string, text string")
    outcomes = spark.createDataFrame([("s", "claim"), ("s", "rejected"), ("t", "failed")], "source_id string, status string")
    scores = spark.createDataFrame([("loose", 3), ("strict", 2)], "tier string, tp long")
    readers.write_extraction_run(outcomes, scores, sources, f"{tmp_path}/x", "r1")
    header = runs.read_run(spark, f"{tmp_path}/x", "r1")["header"].first()
    assert (header["run_id"], header["n_claim"], header["n_rejected"], header["n_failed"], len(header["scores"]), len(header["passages_hash"])) == ("r1", 1, 1, 1, 2, 64)
    resolution = spark.createDataFrame([("a", "e"), ("b", "e"), ("c", "f")], "mention string, entity_id string")
    readers.write_resolution_run(resolution, outcomes.where("status = 'rejected'"), 4, scores, f"{tmp_path}/y", "r1")
    header = runs.read_run(spark, f"{tmp_path}/y", "r1")["header"].first()
    assert (header["n_mentions"], header["n_entities"], header["n_rejected"], header["n_failed"]) == (3, 2, 1, 4)
    assert {tuple(r["mentions"]) for r in runs.read_run(spark, f"{tmp_path}/y", "r1")["rows"].collect()} == {("a", "b"), ("c",)}
    criteria = spark.createDataFrame([("q", "non_empty", "gating", "pass", None)], "case_id string, name string, kind string, status string, score double")
    readers.write_case_run(criteria, scores, f"{tmp_path}/z", "r2")
    assert runs.read_run(spark, f"{tmp_path}/z", "r2")["header"].first()["n_cases"] == 1


def test_tagged_sources_answers_and_derived_gold(spark, tmp_path):
    tagged = lines(tmp_path / "s.jsonl", [{"id": "a", "book": "B", "chapter": 1, "text": "x", "concepts": ["love"]}, {"id": "b", "text": "y"}])
    assert {r["id"]: r["concepts"] for r in readers.read_tagged_sources(spark, tagged).collect()} == {"a": ["love"], "b": []}
    with pytest.raises(Exception, match="repeats"):
        readers.read_tagged_sources(spark, lines(tmp_path / "s2.jsonl", [{"id": "a", "text": "x"}] * 2)).collect()
    answer = {"case_id": "q", "answer": "See [c].", "cited_claims": [{"claim_id": "c", "source_id": "s"}]}
    assert readers.read_answers(spark, lines(tmp_path / "a.jsonl", [answer])).first()["cited"][0]["claim_id"] == "c"
    with pytest.raises(Exception, match="bad answer"):
        readers.read_answers(spark, lines(tmp_path / "b.jsonl", [answer | {"cited_claims": [{"claim_id": "c"}]}])).collect()
    entry = {"kind": "occurrence", "evidence": "e", "support": "literal", "resolution": "resolved", "base_concept": "x"}
    gold = {"schema_version": 2, "source_id": "s", "literal_status": "authored", "derived_status": "authored", "shared": [entry], "variants": [{"variant_id": "v", "entries": [entry | {"base_concept": "y"}]}], "exhaustive": True}
    (tmp_path / "g.json").write_text(json.dumps(gold, indent=1))
    got = readers.read_derived_gold(spark, str(tmp_path / "g.json"))
    assert {(r["variant_id"], r["base_concept"], len(r["annotation_id"])) for r in got["entries"].collect()} == {(None, "x", 16), ("v", "y", 16)} and got["golds"].first()["exhaustive"]
    (tmp_path / "old.json").write_text(json.dumps(gold | {"schema_version": 1}))
    with pytest.raises(Exception, match="another version"):
        readers.read_derived_gold(spark, str(tmp_path / "old.json"))["entries"].collect()
    (tmp_path / "blank.json").write_text(json.dumps({"schema_version": 1, "source_id": "t", "literal_status": "unauthored", "derived_status": "unauthored"}))
    assert readers.read_derived_gold(spark, str(tmp_path / "blank.json"))["entries"].count() == 0


def test_vector_store_embeds_what_is_missing(spark, tmp_path):
    seen, width = [], [2]

    def embed(claims):
        seen.append(claims.count())
        return claims.select("claim_id", F.array_repeat(F.length("text").cast("float"), width[0]).alias("vec"))

    def store(**texts):
        claims = spark.createDataFrame(list(texts.items()), "claim_id string, text string")
        return {r["claim_id"]: r["vec"] for r in runs.store_vectors(spark, f"{tmp_path}/v", claims, embed, "m").collect()}

    assert store(a="x", b="yy") == {"a": [1, 1], "b": [2, 2]}
    assert store(a="x", b="yyy", c="z") == {"a": [1, 1], "b": [3, 3], "c": [1, 1]}
    assert store(a="x") == {"a": [1, 1]}  # nothing new, b and c are stale
    width[0] = 3
    assert store(a="x", d="zzzz") == {"a": [1] * 3, "d": [4] * 3}  # another width: all are embedded again
    versions = {r["version"]: (r["width"], r["embedded"], r["total"], len(r["segments"])) for r in runs.store_versions(spark, f"{tmp_path}/v", "m").collect()}
    assert versions == {1: (2, 2, 2, 1), 2: (2, 2, 3, 2), 3: (2, 0, 1, 2), 4: (3, 2, 2, 1)}
    assert seen == [2, 2, 0, 1, 2]


def test_stream_extract(spark, tmp_path):
    reply = json.dumps({"claims": [{k: v for k, v in CLAIM.items() if k not in ("type", "source_id")}]})
    spark.createDataFrame([("s", reply), ("t", "{")], "key string, reply string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, reply string").parquet(f"{tmp_path}/in")
    out = streams.stream_extract(stream, spark.createDataFrame([("s", "all love here")], "id string, text string"))
    q = out.select("source_id", "status").writeStream.format("memory").queryName("outcomes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("outcomes").collect()} == {("s", "claim"), ("t", "failed")}


def test_stream_sequences_go_on_after_a_stop(spark, tmp_path):
    """Messages of three files: the stream stops after the first batch and starts again from its checkpoint."""
    schema = "conv_id long, arrival long, role string, text string"
    put = lambda rows, p: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p={p}")
    put([(1, 2, "user", "b"), (1, 1, "user", "a"), (2, 1, "user", "x")], 1)

    def run(batches):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = streams.stream_append_messages(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        assert q.exception() is None and len([p for p in q.recentProgress if p["numInputRows"]]) == batches

    run(1)
    put([(1, 4, "user", "d"), (1, 3, "user", "c")], 2)
    put([(2, 2, "user", "y"), (3, 1, "user", "z")], 3)
    run(2)
    run(0)
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r["conv_id"], []).append((r["sequence"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, "a"), (2, "b"), (3, "c"), (4, "d")], 2: [(1, "x"), (2, "y")], 3: [(1, "z")]}


def test_claim_lines_are_written_compressed(spark, monkeypatch):
    from anchora.plans import catalog, stored

    read, seen = stored.readers.read_claims, []
    monkeypatch.setattr(stored.readers, "read_claims", lambda s, path: seen.append(path) or read(s, path))
    assert catalog.QUERIES["claim_lines"](spark, "/root/testdata/sf0.001").count() > 0
    files = spark.read.format("binaryFile").load(seen[0]).select("path").collect()
    assert files and all(f["path"].endswith(".gz") for f in files)


def test_extractions_are_worked_out_once(spark, monkeypatch):
    """What a run writes and counts is read from a table and not made anew for each."""
    from anchora.plans import catalog, stored

    seen, write = [], readers.write_extraction_run
    monkeypatch.setattr(readers, "write_extraction_run", lambda outcomes, *more: (seen.append(outcomes), write(outcomes, *more)))
    table = stored.written
    monkeypatch.setattr(stored, "written", lambda df: seen.append(table(df)) or seen[-1])
    run = {r["status"]: (r["n"], r["n_claim"], r["n_failed"]) for r in catalog.QUERIES["extraction_run"](spark, "/root/testdata/sf0.001").collect()}
    assert run["claim"][0] == run["claim"][1] and run["failed"][0] == run["claim"][2]
    assert len(seen) == 2 and not any("Window" in s._jdf.queryExecution().optimizedPlan().toString() for s in seen)
