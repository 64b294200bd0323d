"""The prefix trie of conversations, by union-find over sorted neighbours.

Distinct sequences of turns are sorted; the turns that a sequence shares with the one before it are an edge of that length.
Taken from the longest to the shortest, edges join the sequences around them, and each join is a branching node of the trie
at that depth. Sorted sequences are range-partitioned and cut into chunks, each of which makes its forest for itself. Only
nodes on a chunk's first and last sequence can reach beyond it, as deep as the neighbour shares them. These stay open: their
partial sums are contracted to a row each, and added up across the boundaries. All sums of a node are sums over its
sequences, given what each shares with the one before it, so that nothing has to climb the merged trie again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import words_of, written

#: Bytes that tell one turn from another, and leading bytes by which sequences are dealt to ranges.
TURN_BYTES, RANGE_BYTES = 16, 1024
#: Sequences and turns of a chunk; a longer sequence is a chunk of its own. Conversation ids hashed from one row.
CHUNK_ROWS, CHUNK_TURNS, RUN_IDS = 1 << 16, 1 << 20, 1 << 16

ORDER = "chunk long, pos int, conv_id long, n long, size int, before int, after int, words binary, ends string, edge binary"
BRIDGES = "chunk long, pos int, before2 int, after2 int"
NODES = "chunk long, key string, depth int, conv_id long, parent_conv_id long, parent_key string, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with a turn's digest and words in order of ``turn``, null first, equal ones by digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN_BYTES)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.size(words_of(text)).alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations that start alike: conversation c begins with the first h turns of conversation c - c % ``group`` and goes
    on with its own turns after its first h; h = crc32 of c in decimal, modulo ``most``."""
    turns = written(turns)
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = turns.withColumns({"h": h, "head": F.col("conv_id") - F.col("conv_id") % group}).join(heads, "head", "left")
    empty = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(F.slice(F.coalesce("first", empty), F.lit(1), F.col("h")), own).alias("turns"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ends, conv_id) in order: runs of ids of one sequence, joined by commas."""
    now, ids = None, []

    def run() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["ends", "first_id", "ids"])

    for batch in batches:
        for ends, conv_id in zip(batch.column("ends").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (ends != now or len(ids) >= RUN_IDS):
                yield run()
                ids = []
            now = ends
            ids.append(conv_id)
    if ids:
        yield run()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order: one SHA-256 for each sequence, over its runs as they pass by."""
    now, sha, done = None, None, []
    for batch in batches:
        for ends, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if ends != now:
                done += [(now, sha.hexdigest())] if sha else []
                now, sha = ends, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["ends", "ends_sha256"])
            done = []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["ends", "ends_sha256"])


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from their start."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // TURN_BYTES
    return int(np.argmax(np.frombuffer(a, np.uint64, least // 8) != np.frombuffer(b, np.uint64, least // 8))) * 8 // TURN_BYTES


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sequences with their chunk, and the turns shared with the sequences before and after. Those at the ends of a
    chunk keep their turns; null stands where the neighbour is in another partition."""
    chunk, pos, turns, last, rows = TaskContext.get().partitionId() << 32, 0, 0, None, []

    def out(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in ORDER.split(", ")])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("seq", "conv_id", "n", "words", "ends"))
        for seq, conv_id, n, words, ends in zip(*columns, strict=True):
            before = None if last is None else common_turns(last, seq)
            size = len(seq) // TURN_BYTES
            new = last is not None and (pos + 1 >= CHUNK_ROWS or turns + size > CHUNK_TURNS)
            if rows:
                rows[-1][6] = before
                rows[-1][9] = rows[-1][9] or (last if new else None)
            if new:
                chunk, pos, turns = chunk + 1, -1, 0
            pos, turns = (pos + 1 if last is not None else 0), turns + size
            if len(rows) > 4096:
                yield out(rows[:-1])
                rows = rows[-1:]
            rows.append([chunk, pos, conv_id, n, size, before, None, np.cumsum([0, *words], dtype=np.int64).tobytes(), ends, seq if pos == 0 else None])
            last = seq
    if rows:
        rows[-1][9] = last
        yield out(rows)


def _bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last sequences of all partitions in order: what each shares across the boundary; -1 at the outer ends."""
    rows = [r for b in batches for r in b.to_pylist()]
    for k, r in enumerate(rows):
        starts, stops = r["before"] is None, r["after"] is None
        r["before2"] = (common_turns(rows[k - 1]["edge"], r["edge"]) if k else -1) if starts else None
        r["after2"] = (common_turns(r["edge"], rows[k + 1]["edge"]) if k + 1 < len(rows) else -1) if stops else None
    if rows:
        kinds = [("chunk", pa.int64()), ("pos", pa.int32()), ("before2", pa.int32()), ("after2", pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds], [c for c, _ in kinds])


def forest(size: np.ndarray, before: np.ndarray, conv_id: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes that branch or end in one chunk of sorted sequences: first and last sequence, depth, the depth of the node above
    (-1: none), that node's number, children that begin here, least conv_id. ``before`` are turns shared with the sequence
    before. Edges are joined from the longest on; a component's top is the node at which its last join took place."""
    m = len(size)
    parent, low, high = list(range(m)), list(range(m)), list(range(m))
    depth, number, least, kids = size.tolist(), list(range(m)), conv_id.tolist(), [0] * m
    shared = before.tolist()
    nodes, count = {k: [] for k in ("number", "low", "high", "depth", "up", "above", "kids", "least")}, m

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def close(x: int, up: int, above: int) -> None:
        for key, value in zip(nodes, (number[x], low[x], high[x], depth[x], up, above, kids[x], least[x]), strict=True):
            nodes[key].append(value)

    for edge in np.argsort(-before[1:], kind="stable").tolist():
        d, a, b = shared[edge + 1], find(edge), find(edge + 1)
        extends = depth[a] == d  # the left component's top lies at this depth; the right one's is always deeper
        top = number[a] if extends else count
        count += not extends
        begun = kids[a] if extends else 0
        for x in ([] if extends else [a]) + [b]:
            close(x, d, top)
            begun += shared[low[x]] <= d  # else the child began in an earlier chunk
        parent[b] = a
        high[a], depth[a], number[a], kids[a], least[a] = high[b], d, top, begun, min(least[a], least[b])
    close(find(0), -1, -1)
    return {k: np.array(v, np.int64) for k, v in nodes.items()}


def _keys(edge: bytes, deepest: int) -> list[str]:
    """A name for each prefix of a sequence, from the empty one to ``deepest`` turns."""
    sha, out = hashlib.sha256(), []
    for k in range(deepest + 1):
        out.append(sha.hexdigest())
        sha.update(edge[k * TURN_BYTES : (k + 1) * TURN_BYTES])
    return out


def _nodes(table: pa.Table) -> pa.Table:
    """One chunk: a row for each of its nodes, those between branches too. Open nodes have a key."""
    table = table.sort_by("pos")
    size, before, after, conv_id, n = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "before", "after", "conv_id", "n"))
    m, flat = len(size), np.concatenate([np.frombuffer(x, np.int64) for x in table.column("words").to_pylist()])
    start = np.cumsum(size + 1) - size - 1
    words = lambda i, k: flat[start[i] + np.maximum(k, 0)]  # noqa: E731  words of the first k turns of sequence i
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    whole, leaf = words(np.arange(m), size), after < size
    members, weighted, ends, new = sums(n), sums(n * whole), sums(leaf.astype(np.int64)), sums(whole - words(np.arange(m), before))
    f = forest(size, before, conv_id)
    of = np.repeat(np.arange(len(f["low"])), f["depth"] - f["up"])  # a row for each depth from a node up to below the next
    depth = f["depth"][of] - (np.arange(len(of)) - (np.cumsum(f["depth"] - f["up"]) - (f["depth"] - f["up"]))[of])
    low, high, at_node = f["low"][of], f["high"][of] + 1, depth == f["depth"][of]
    n_convs = members[high] - members[low]
    upper = words(low, depth - 1)
    spoken = weighted[high] - weighted[low] - n_convs * upper
    once = new[high] - new[low + 1] + whole[low] - words(low, np.maximum(before[low], depth - 1))
    kids = np.where(at_node, f["kids"][of], before[low] <= depth)
    is_open = lambda lo, hi, k: ((lo == 0) & (k <= before[0])) | ((hi == m) & (k <= after[-1]))
    by_number = np.zeros(int(f["number"].max()) + 1, np.int64)
    by_number[f["number"]] = np.arange(len(f["number"]))
    above = by_number[np.maximum(f["above"], 0)][of]
    chain, root = depth - 1 > f["up"][of], depth == 0  # the node above has the same sequences, or is the node above
    p_low, p_high = np.where(chain, low, f["low"][above]), np.where(chain, high, f["high"][above] + 1)
    opened, p_opened = is_open(low, high, depth), ~root & is_open(p_low, p_high, depth - 1)
    first, last = _keys(table.column("edge")[0].as_py(), int(before[0])), _keys(table.column("edge")[m - 1].as_py(), int(after[-1]))
    name = lambda on, lo, k: [(first if a == 0 and d < len(first) else last)[d] if o else None for o, a, d in zip(on.tolist(), lo.tolist(), k.tolist(), strict=True)]
    ended = (at_node & (size[low] == depth)).tolist()
    ends_of = table.column("ends").to_pylist()
    p_conv = np.where(chain, f["least"][of], f["least"][above])
    columns = {
        "chunk": pa.array([table.column("chunk")[0].as_py()] * len(of), pa.int64()), "key": pa.array(name(opened, low, depth), pa.string()), "depth": pa.array(depth, pa.int32()),
        "conv_id": pa.array(f["least"][of]), "parent_conv_id": pa.array(p_conv, pa.int64(), mask=root | p_opened), "parent_key": pa.array(name(p_opened, p_low, depth - 1), pa.string()),
        "n_convs": pa.array(n_convs), "n_children": pa.array(kids.astype(np.int64)), "n_leaves": pa.array(ends[high] - ends[low]), "saved_tokens": pa.array(spoken - once),
        "ends": pa.array([ends_of[i] if e else None for e, i in zip(ended, low.tolist(), strict=True)], pa.string()),
    }
    return pa.table(columns)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, turns), from ``conversation_turns`` or ``shared_heads``: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (digests of role and text); conv_id is the least conversation that starts
    with it, and with depth names the node. saved_tokens: words of a node's last turn for all its conversations but one,
    summed over its subtree. ends_sha256: of the conversations that end there, in numeric order, joined by commas.

    A conversation without turns ends at the root. Null conversation ids are left out, null roles and texts are empty,
    turns of equal number stand in order of their digest; no conversations give no node, not even the root. Turns are told
    apart by 128 bits of SHA-256. One conversation's digests and word counts are one record, so its turns bound a task's
    memory; equal conversations are one sequence, whose ids are hashed as a stream."""
    seq = F.unhex(F.array_join("turns.digest", ""))
    rows = written(turns.select("conv_id", seq.alias("seq"), F.col("turns.words").alias("words")).withColumn("ends", F.sha2("seq", 256)))
    runs = rows.select("ends", "conv_id").repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(_runs, "ends string, first_id long, ids string")
    hashes = runs.repartition("ends").sortWithinPartitions("ends", "first_id").mapInArrow(_hashes, "ends string, ends_sha256 string")
    distinct = rows.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("words").alias("words"), F.first("ends").alias("ends"))
    ordered = distinct.repartitionByRange(F.substring("seq", 1, RANGE_BYTES)).sortWithinPartitions("seq")
    ordered = written(ordered.mapInArrow(_neighbours, ORDER))
    outer = ordered.where("before IS NULL OR after IS NULL").select("chunk", "pos", "before", "after", "edge")  # two rows a partition at most
    bridges = outer.repartition(1).sortWithinPartitions("chunk", "pos").mapInArrow(_bridges, BRIDGES)
    ordered = ordered.join(F.broadcast(bridges), ["chunk", "pos"], "left").withColumns({"before": F.coalesce("before2", "before"), "after": F.coalesce("after2", "after")}).drop("before2", "after2")
    nodes = written(ordered.groupBy("chunk").applyInArrow(_nodes, NODES))
    opened, closed = nodes.where("key IS NOT NULL"), nodes.where("key IS NULL")
    merged = written(opened.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in _SUMS), F.max("ends").alias("ends")))
    above = merged.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    # below an open node: by chunk and key, so that a node with many children does not meet them in one task
    above_here = opened.select("chunk", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key")).join(above, ["depth", "parent_key"])
    out = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends"]
    renamed = lambda d: d.withColumn("parent_conv_id", F.col("parent")).select(out)
    found = closed.where("parent_key IS NULL").select(out).union(renamed(closed.where("parent_key IS NOT NULL").drop("parent_conv_id").join(above_here, ["chunk", "depth", "parent_key"])))
    found = found.union(renamed(merged.join(above, ["depth", "parent_key"], "left")))
    ending = found.where("ends IS NOT NULL").join(hashes, "ends").select(*out[:-1], "ends_sha256")
    none = hashlib.sha256(b"").hexdigest()
    return found.where("ends IS NULL").select(*out[:-1], F.lit(none).alias("ends_sha256")).union(ending)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie(shared_heads(conversation_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return found.withColumn("depth", F.col("depth").cast("long"))
