"""Exact duplicates by Grace hashing.

Records are dealt by the leading bits of their content's hash into buckets, kept as spill files in the shared folder.
A bucket that is too large is dealt again by its next bits, and only then; one that fits is read into an open-addressing
table that compares complete contents. Before each spill, equal contents that a task meets together become one record
which counts them, so that a content that a third of all rows share shrinks from level to level instead of filling a
bucket that no further bit could split. What was merged on the way is a link, followed back once the buckets are done."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import LOWER, written

#: Bits of the hash that deal one level: 1,024 buckets of each.
BITS = 10
#: Content bytes that a bucket's table may hold, that a task merges at once, and what a record counts besides its content.
BUCKET_BYTES, COMBINE_BYTES, RECORD_BYTES = 64 << 20, 16 << 20, 64
#: Up to so many records a bucket with a single hash is streamed through a table of that one content.
COPIES = 1024

RECORDS = "id long, doc_id long, n long, top_doc long, top_id long, hash long, sha string, size long, text binary, to long"
CLASSES = "id long, doc_id long, keep_id long, keep_row long, group_size long, sha string"
_LOWER = LOWER.tobytes()


class ContentTable:
    """Open addressing with linear probing. A slot holds the number of a content; equal hashes are told apart byte by byte."""

    def __init__(self, slots: int = 1024):
        self.slots: list[int] = [-1] * slots
        self.hashes: list[int] = []
        self.texts: list[bytes] = []

    def _slot(self, h: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (found := self.slots[at]) >= 0 and (self.hashes[found] != h or self.texts[found] != text):
            at = at + 1 & mask
        return at

    def put(self, h: int, text: bytes) -> int:
        """The number of this content; numbers count up from 0 as contents first come."""
        at = self._slot(h, text)
        if self.slots[at] >= 0:
            return self.slots[at]
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        if 3 * len(self.texts) > 2 * len(self.slots):
            self.slots, mask = [-1] * (2 * len(self.slots)), 2 * len(self.slots) - 1
            for number, old in enumerate(self.hashes):  # all differ: the next free slot is theirs
                free = old & mask
                while self.slots[free] >= 0:
                    free = free + 1 & mask
                self.slots[free] = number
        return len(self.texts) - 1


def _order(doc_id: int | None, row: int) -> tuple:
    """Null ids come before all others; of equal ids the later row is the larger."""
    return (doc_id is not None, doc_id or 0, row)


def _merged(records: list[list]) -> pa.RecordBatch:
    """One record for each content among ``records``, and a link for each record that went into another."""
    table, first, links = ContentTable(), [], []
    for r in records:
        at = table.put(r[5], r[8])
        if at == len(first):
            first.append(r)
            continue
        into = first[at]
        into[2] += r[2]
        into[3:5] = max(into[3:5], r[3:5], key=lambda top: _order(*top))
        links.append([r[0], r[1], *[None] * 7, into[0]])
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*first, *links, strict=True), kinds, strict=True)], names)


def _bytes(column: pa.Array) -> list[bytes | None]:
    """Values as bytes; a string column is read without a copy."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


def _spill(first: bool):
    """Merge what a task meets within COMBINE_BYTES. The first level takes (id, doc_id, text), later ones records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [_bytes(batch.column(k)) if batch.schema.names[k] == "text" else batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if first:
                    text = (row[2] or b"").translate(_LOWER)
                    sha = hashlib.sha256(text)
                    r = [row[0], row[1], 1, row[1], row[0], int.from_bytes(sha.digest()[:8], "big", signed=True), sha.hexdigest(), len(text) + RECORD_BYTES, text, None]
                else:
                    r = [*row, None]
                held.append(r)
                size += r[7]
                if size >= COMBINE_BYTES and len(held) > 1:
                    yield _merged(held)
                    held, size = [], 0
        if held:
            yield _merged(held)

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in order of (level, bucket): a table for each bucket, and a row for each record with its class."""
    names = [f.split()[0] for f in CLASSES.split(", ")]
    bucket, table, members, tops = None, ContentTable(), [], []

    def classes() -> pa.RecordBatch:
        rows = [(i, d, *tops[c]) for i, d, c in members]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]] + [pa.array([r[5] for r in rows], pa.string())], names)

    for batch in batches:
        level, at, ids, docs, n, top_doc, top_id, h, sha = (batch.column(c).to_pylist() for c in ("level", "bucket", "id", "doc_id", "n", "top_doc", "top_id", "hash", "sha"))
        for k, text in enumerate(_bytes(batch.column("text"))):
            if (level[k], at[k]) != bucket:
                if members:
                    yield classes()
                bucket, table, members, tops = (level[k], at[k]), ContentTable(), [], []
            c = table.put(h[k], text)
            if c == len(tops):
                tops.append([top_doc[k], top_id[k], n[k], sha[k]])
            else:
                tops[c][:2] = max(tops[c][:2], [top_doc[k], top_id[k]], key=lambda top: _order(*top))
                tops[c][2] += n[k]
            members.append((ids[k], docs[k], c))
    if members:
        yield classes()


def _too_large(records: DataFrame) -> DataFrame:
    """Buckets of ``records`` that another level can make smaller, with the number of shares to read each in."""
    by_hash = records.groupBy("bucket", "hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    sizes = by_hash.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("hashes"))
    return sizes.where((F.col("bytes") > BUCKET_BYTES) & ((F.col("hashes") > 1) | (F.col("n") > COPIES))).select("bucket", F.ceil(F.col("bytes") / BUCKET_BYTES).alias("shares"))


def _classes(rows: DataFrame) -> DataFrame:
    """CLASSES for each row of (id, doc_id, text); ids must differ."""
    done, links, level = [], [], 0
    now = written(rows.select("id", "doc_id", "text").mapInArrow(_spill(True), RECORDS))
    while True:
        links.append(now.where("to IS NOT NULL").select("id", "doc_id", "to"))
        records = now.where("to IS NULL").drop("to").withColumn("bucket", F.shiftrightunsigned("hash", max(64 - BITS * (level + 1), 0))).withColumn("level", F.lit(level))
        large = written(_too_large(records))
        if large.isEmpty():
            done.append(records)
            break
        done.append(records.join(large, "bucket", "left_anti").select(records.columns))
        again = records.join(large, "bucket").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares"))).repartition("hash", "share")
        now = written(again.select([f.split()[0] for f in RECORDS.split(", ")[:-1]]).mapInArrow(_spill(False), RECORDS))
        level += 1
    fit = done[0]
    for more in done[1:]:
        fit = fit.unionByName(more)
    found = fit.repartition("level", "bucket").sortWithinPartitions("level", "bucket").mapInArrow(_tables, CLASSES)
    found = written(found)
    for merged in reversed(links):
        of = found.select(F.col("id").alias("to"), "keep_id", "keep_row", "group_size", "sha")
        found = found.union(merged.join(of, "to").select("id", "doc_id", "keep_id", "keep_row", "group_size", "sha"))
    return found


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; a null text is an empty one. The row with the largest doc_id of a
    group stays, a null id being the least; of rows that repeat that id one stays. An empty table gives no rows. Other
    columns of ``docs`` are not read."""
    found = _classes(docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    return found.select("doc_id", "keep_id", "group_size", (F.col("id") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and their texts as they are. Nulls, ties, repeated rows and
    an empty table as in ``exact_duplicates``."""
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = _classes(numbered.select(F.col("_row").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return numbered.join(found.where("id = keep_row").select(F.col("id").alias("_row")), "_row", "left_semi").drop("_row").select(docs.columns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
