"""Exact substring deduplication by a sampled suffix array.

Suffixes are sampled: of each window of ``length`` bytes, the one at its least k-gram by hash, which depends on the window
alone. Equal windows therefore hold equal sampled suffixes at equal places, and only suffixes whose leading bytes occur
twice are looked at. These are range-partitioned by their leading bytes with splitters that Spark samples; in each bucket
they are sorted by multikey quicksort, forwards from the sampled place and backwards from it, and the common prefixes of
neighbours tell which windows occur twice. Leading bytes that many suffixes share are spread over several buckets, which
are compared with each other afterwards."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import BYTE_VALUES, MULT, MULT_INV, mix, powers, text_parts, written

#: Bytes of repeated strings.
LENGTH = 400
#: Leading bytes that sampled suffixes are matched on.
LEAD = 80
#: Suffixes with equal leading bytes that one bucket takes, about, and groups up to which all pairs are compared.
BUCKET_ROWS, PAIRS = 4000, 8

SUFFIXES = "kind int, lead long, row long, at int, low int, high int"
WINDOWS = "head binary, lead long, salt int, salts int, row long, at int, low int, high int, bytes binary"
FOUND = "row long, first long, last long, key long, key2 long, twice boolean"


def _gram_hashes(buf: np.ndarray, k: int, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers(MULT, len(buf)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(MULT_INV, len(buf) - k + 1))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over ``width`` values by doubling."""
    now, have = values, 1
    while have * 2 <= width:
        now = np.minimum(now[:-have], now[have:])
        have *= 2
    rest = width - have
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def periodic(text: np.ndarray, at: np.ndarray, same: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches of period q and of ``least`` + q bytes or more, about neighbouring samples whose
    k-grams are the same (``same``: of a sample and the next one)."""
    out, known = [], {}
    end = -1
    for k in np.flatnonzero(same).tolist():
        if at[k] < end:
            continue
        q = int(at[k + 1] - at[k])
        if q not in known:
            known[q] = np.flatnonzero(text[:-q] != text[q:])
        breaks = known[q]
        after = int(np.searchsorted(breaks, at[k]))
        x = int(breaks[after - 1]) + 1 if after else 0
        y = (int(breaks[after]) if after < len(breaks) else len(text) - q) + q
        if y - x >= least + q:
            out.append((x, y, q))
            end = y - q
    return out


def sampled_suffixes(text: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """(kind, lead hash, place, first window, last window) of each sampled suffix of one text (kind 1), and of windows of
    ``length`` bytes (kind 0) that a periodic stretch of the text repeats by itself.

    Every window start lies in the range of exactly one suffix, but for those inside a periodic stretch after its first
    period; among equal k-grams the leftmost counts."""
    if len(text) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty, empty
    grams = _gram_hashes(text, lead)
    bits = np.uint64(max(len(grams) - 1, 1).bit_length())
    tagged = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    best = (_least(tagged, length - lead + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(first[1:], len(best)) - 1
    at = best[first]
    leads = grams[at]
    settled: list[tuple[int, int, int]] = []
    close = (leads[1:] == leads[:-1]) & (np.diff(at) < lead)
    if close.any():
        for x, y, q in periodic(text, at, close, length):
            settled.append((0, x, y - length))
            # what lies between two of the settled windows of ``length`` needs no suffix of its own
            inside = (first <= y - length) & (last >= x + q)
            head, tail = inside & (first < x + q), inside & (last > y - length)
            both = head & tail  # one suffix for windows on either side
            at, leads = np.concatenate([at, at[both]]), np.concatenate([leads, leads[both]])
            first, last = np.concatenate([first, np.full(both.sum(), y - length + 1)]), np.concatenate([last, last[both]])
            grown = np.zeros(both.sum(), bool)
            drop, head, tail = (np.concatenate([m, grown]) for m in (inside & ~head & ~tail, head, tail & ~both))
            last = np.where(head, x + q - 1, last)
            first = np.where(tail, y - length + 1, first)
            at, leads, first, last = at[~drop], leads[~drop], first[~drop], last[~drop]
    own = np.array(settled, np.int64).reshape(-1, 3).T
    kind = np.concatenate([np.full(len(at), 1), own[0]])
    none = np.zeros(len(settled), np.int64)
    return kind, np.concatenate([leads, none.astype(np.uint64)]), np.concatenate([at, none]), np.concatenate([first, own[1]]), np.concatenate([last, own[2]])


def _suffix_rows(length: int, lead: int):
    def run(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, offsets, buf in text_parts(batch.column("text")):
                out = [[], [], [], [], [], []]
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    kind, grams, at, low, high = sampled_suffixes(buf[a:b], length, lead)
                    for o, x in zip(out, (kind, grams.view(np.int64), np.full(len(at), rows[first + k]), at, low, high), strict=True):
                        o.append(x)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t.to_pandas_dtype())) for x, t in zip(out, types, strict=True)], ["kind", "lead", "row", "at", "low", "high"])

    return run


def _window_rows(length: int):
    """Each wanted suffix with the bytes of its windows, and its first bytes to order it by."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["head", "lead", "salt", "salts", "row", "at", "low", "high", "bytes"])

    def run(batches):
        for batch in batches:
            out, held = [], 0
            wanted = batch.column("wanted")
            fields = dict(zip([f.name for f in wanted.type.value_type], wanted.flatten().flatten(), strict=True))
            each = zip(*(fields[n].to_numpy().tolist() for n in ("lead", "salt", "salts", "at", "low", "high")), strict=True)
            for row, text, n in zip(batch.column("row").to_pylist(), batch.column("text"), pa.compute.list_value_length(wanted).to_pylist(), strict=True):
                data = text.as_py().encode()
                for lead, salt, salts, at, low, high in itertools.islice(each, n):
                    out.append((data[at : at + 16], lead, salt, salts, row, at, low, high, data[low : high + length]))
                    held += high - low + length
                    if held > 4 << 20:
                        yield rows(out)
                        out, held = [], 0
            if out:
                yield rows(out)

    return run


# sorting --------------------------------------------------------------------------------------------


#: The least values of two bytes, three and so on.
_BYTES = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)


class Strings:
    """Byte strings in one buffer, read eight bytes at a time from any place."""

    def __init__(self, buf: np.ndarray):
        self.size = len(buf)
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        self.words = np.ndarray(len(buf) + 8, np.dtype("<u8"), padded, strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the strings at ``a`` and ``b``, at most ``most``."""
        out = most.copy()
        going, depth = np.flatnonzero(most > 0), 0
        while len(going):
            x = self.words[np.minimum(a[going] + depth, self.size)] ^ self.words[np.minimum(b[going] + depth, self.size)]
            differ = x != 0
            at = going[differ]
            x = x[differ]
            out[at] = np.minimum(depth + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8, most[at])
            depth += 8
            going = going[~differ]
            going = going[most[going] > depth]
        return out

    def multikey_sorted(self, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): the strings sorted by group and bytes, and each one's common prefix with the one before it, -1
        where a group begins.

        All tied segments are split at once: each jumps to where its strings first differ from its first one, and is
        partitioned by the eight bytes there, an end before any byte."""
        order = np.argsort(group, kind="stable")
        common = np.full(len(order), -1, np.int64)
        place = np.arange(len(order))
        new = np.ones(len(order), bool)
        new[1:] = group[order[1:]] != group[order[:-1]]
        depth = np.zeros(len(order), np.int64)
        while True:
            # drop segments of one
            alone = new & np.append(new[1:], True)
            place, new, depth = place[~alone], new[~alone], depth[~alone]
            if not len(place):
                return order, common
            head = np.flatnonzero(new)
            segment = np.cumsum(new) - 1
            ids = order[place]
            first = ids[head][segment]
            most = np.minimum(length[ids], length[first]) - depth
            far = depth + self.common(start[ids] + depth, start[first] + depth, most)
            deep = np.minimum.reduceat(far, head)
            equal = deep >= np.maximum.reduceat(length[ids], head)
            inner = equal[segment] & ~new
            common[place[inner]] = length[ids[inner]]
            keep = ~equal[segment]
            place, ids, segment, new = place[keep], ids[keep], segment[keep], new[keep]
            if not len(place):
                return order, common
            depth = deep[segment]
            left = length[ids] - depth
            word = self.words[np.minimum(start[ids] + depth, self.size)].byteswap()
            ended = left < 8
            word[ended] &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * left[ended]).astype(np.uint64))
            left = np.minimum(left, 8)
            by = np.lexsort((left, word, segment))
            order[place] = ids[by]
            word, left = word[by], left[by]
            split = np.zeros(len(place), bool)
            split[1:] = ((word[1:] != word[:-1]) | (left[1:] != left[:-1])) & ~new[1:]
            at = np.flatnonzero(split)
            x = word[at] ^ word[at - 1]
            same = np.where(x == 0, 8, 7 - np.searchsorted(_BYTES, x, "right"))
            common[place[at]] = depth[at] + np.minimum(same, np.minimum(left[at], left[at - 1]))
            new = new | split


def _pairs_of(strings: Strings, back: Strings, anchor: np.ndarray, left: np.ndarray, order: np.ndarray, common: np.ndarray, small: np.ndarray):
    """(a, b, bytes before, bytes after the anchor) that each two suffixes of a small group share. What sorted places share
    is the least common prefix of the neighbours between them."""
    after = common[1:]
    for step in range(1, PAIRS):
        if step > 1:
            after = np.minimum(after[:-1], common[step:])
        hit = np.flatnonzero((after >= 0) & small[order[: len(after)]])
        if not len(hit):
            return
        a, b = order[hit], order[hit + step]
        yield a, b, back.common(back.size - anchor[a], back.size - anchor[b], np.minimum(left[a], left[b])), after[hit]


def compare(lead: np.ndarray, row: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, spread: np.ndarray, data: list[bytes], length: int):
    """Windows of ``length`` bytes that occur twice among suffixes with equal leading bytes.

    Returns runs (row, first, last), and for groups that are spread over buckets each distinct window once (row, place, key,
    key2, whether it occurs twice here), to compare further."""
    size = np.array([len(x) for x in data], np.int64)
    begin = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(data), np.uint8)
    strings, back = Strings(buf), Strings(np.ascontiguousarray(buf[::-1]))
    left = at - low
    anchor, right = begin + left, size - left
    group = np.unique(lead, return_inverse=True)[1]
    order, common = strings.multikey_sorted(anchor, right, group)
    small = (np.bincount(group)[group] <= PAIRS) & ~spread
    runs = []
    for a, b, before, after in _pairs_of(strings, back, anchor, left, order, common, small):
        for s in (a, b):
            least, most = np.maximum(length - after, at[s] - high[s]), np.minimum(before, left[s])
            hit = least <= most
            s, least, most = s[hit], least[hit], most[hit]
            runs.append((row[s], at[s] - most, at[s] - least))
    sent = []
    large = np.flatnonzero(~small)
    if len(large):
        ends, shared = back.multikey_sorted(back.size - anchor[large], left[large], group[large])
        rank_right = np.empty(len(order), np.int64)
        rank_right[order] = np.arange(len(order))
        rank_left = np.empty(len(large), np.int64)
        rank_left[ends] = np.arange(len(ends))
        hashes = [_gram_hashes(buf, length, v) for v in (BYTE_VALUES, BYTE_VALUES[::-1] ^ np.uint64(0x5DEECE66D))] if spread.any() and len(buf) >= length else None
        for before in range(int((at - high)[large].min()), int(left[large].max()) + 1):
            owns = np.flatnonzero((at[large] - high[large] <= before) & (before <= left[large]) & (right[large] >= length - before))
            if not len(owns):
                continue
            s = large[owns]
            # equal bytes after the anchor, and equal ones before it, number the classes in either order
            key = np.cumsum(common < length - before)[rank_right[s]] * (len(large) + 1) + np.cumsum(shared < before)[rank_left[owns]]
            by = np.argsort(key, kind="stable")
            key = key[by]
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            twice = np.zeros(len(key), bool)
            twice[by] = same[:-1] | same[1:]
            place = at[s] - before
            runs.append((row[s[twice]], place[twice], place[twice]))
            once = np.zeros(len(key), bool)
            once[by] = ~same[:-1]
            once &= spread[s]
            if once.any():
                where = begin[s[once]] + place[once] - low[s[once]]
                sent.append((row[s[once]], place[once], hashes[0][where].view(np.int64), hashes[1][where].view(np.int64), twice[once]))
    found = [np.concatenate(x) for x in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 3
    return _merged(*found), [np.concatenate(x) for x in zip(*sent, strict=True)] if sent else None


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or adjacent runs of one row become one."""
    if not len(row):
        return row, first, last
    by = np.lexsort((first, row))
    row, first, last = row[by], first[by], last[by]
    text = np.ones(len(row), bool)
    text[1:] = row[1:] != row[:-1]
    base = (np.cumsum(text) - 1) * (int(last.max()) + 2)  # so that no run reaches into the next text
    until = np.maximum.accumulate(last + base)
    new = np.ones(len(row), bool)
    new[1:] = text[1:] | ((first + base)[1:] > until[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], first[at], (until - base)[np.append(at[1:], len(row)) - 1]


def _buckets(length: int, max_bytes: int = 8 << 20):
    """Sorted suffixes of a range partition: groups of equal (lead, salt), compared in runs of about ``max_bytes``."""

    def emit(held: list[pa.Table]):
        table = pa.concat_tables(held).combine_chunks()
        number = lambda c: table.column(c).to_numpy().astype(np.int64)
        (row, first, last), sent = compare(*(number(c) for c in ("lead", "row", "at", "low", "high")), number("salts") > 1, table.column("bytes").to_pylist(), length)
        none, yes = pa.nulls(len(row), pa.int64()), pa.array(np.ones(len(row), bool))
        names = ["row", "first", "last", "key", "key2", "twice"]
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(first), pa.array(last), none, none, yes], names)
        if sent:
            row, place, key, key2, twice = sent
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(place), pa.array(place), pa.array(key), pa.array(key2), pa.array(twice)], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            lead, salt = batch.column("lead").to_numpy(), batch.column("salt").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (salt[1:] != salt[:-1])])) if len(lead) else np.zeros(0, int)
            for a, b in zip(begins, np.append(begins[1:], len(lead)), strict=True):
                if size > max_bytes and (lead[a], salt[a]) != now:
                    yield from emit(held)
                    held, size = [], 0
                now = (lead[a], salt[a])
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                held.append(part)
                size += part.column("bytes").nbytes
        if held:
            yield from emit(held)

    return run


def _cut(length: int):
    """Text without the union of its repeated windows: bytes, removed bytes, spans, and the hash of what stays."""
    import hashlib

    def union(spans: list[dict]) -> list[list[int]]:
        runs: list[list[int]] = []
        for a, b in sorted((s["first"], s["last"] + length) for s in spans or ()):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return runs

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text, spans, copied in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), batch.column("copied").to_pylist(), strict=True):
                data = text.as_py().encode()
                runs = [[0, len(data)]] if copied and len(data) >= length else union(spans)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                for o, x in zip(out, (doc, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()), strict=True):
                    o.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans and kept_sha256 after removing every byte that a
    string of ``length`` bytes covers which also starts elsewhere, in this text or another. Strings are judged on the input, and never cross texts.

    Equal texts (by SHA-256) are one class and go whole if they have ``length`` bytes; one of them stands for all in the
    comparison. A null is an empty text, with no bytes and no spans; null ids stay. Repeated rows are equal texts; an
    empty table gives none; other columns are ignored. A very long text is sampled and cut by one task, whose memory
    follows that text; a stretch of few bytes over and over is settled by itself."""
    if lead > length:
        raise ValueError("lead is longer than length")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    copied = d.groupBy("row", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies")).where("copies > 1").groupBy("row").agg(F.collect_set("sha").alias("copied"))
    sampled = written(d.select("row", "text").mapInArrow(_suffix_rows(length, lead), SUFFIXES))
    suffixes = sampled.where("kind = 1").drop("kind")
    place = F.xxhash64("row", "at")
    counts = suffixes.groupBy("lead").agg(F.count("*").alias("n"), F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    counts = written(counts.select("lead", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("salts")))
    wanted = suffixes.join(counts, "lead").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    wanted = written(wanted.groupBy("row").agg(F.collect_set(F.struct("lead", "salt", "salts", "at", "low", "high")).alias("wanted")))
    texts = d.select("row", "text").dropDuplicates(["row"]).join(wanted, "row")
    windows = texts.mapInArrow(_window_rows(length), WINDOWS)
    keys = ("head", "lead", "salt")
    found = written(windows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_buckets(length), FOUND))
    keyed = found.where("key is not null")
    across = keyed.groupBy("key", "key2").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice")
    late = keyed.join(across.select("key", "key2"), ["key", "key2"]).select("row", "first", "last")
    settled = sampled.where("kind = 0").select("row", F.col("low").cast("long"), F.col("high").cast("long"))
    spans = found.where("key is null").select("row", "first", "last").union(late).union(settled)
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    out = d.join(written(spans.join(copied, "row", "full_outer")), "row", "left")
    equal = F.when(F.col("copied").isNotNull(), F.array_contains("copied", F.sha2("text", 256))).otherwise(False)
    return out.select("doc_id", "text", "spans", equal.alias("copied")).mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
