"""Best-fit packing of tokenised documents: range-sorted successor sweeps in bulk-synchronous rounds."""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import LOWER, SPACES, text_parts, word_ranges, written

VOCABULARY, LIMIT, END_ID = "word_bpe_49k.json", 2048, 0
#: Parts of words that a worker's table holds before it is emptied.
CACHE_PARTS = 500_000
#: Text bytes encoded together; one longer text stands alone.
PART_BYTES = 1 << 20
#: Of a byte: white space 0, letter 1, digit 2, sign 3, what keeps a word whole 4.
KINDS = np.full(256, 4, np.uint8)
KINDS[33:127] = 3
KINDS[[39, 60]] = 4  # an apostrophe may begin a contraction, < a special token
KINDS[97:123] = 1
KINDS[48:58] = 2
KINDS[SPACES] = 0
#: Rows that one task sorts and sweeps.
SWEEP_ROWS = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def vocabulary_path() -> str:
    """Where this machine keeps the vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Ids:
    """Ids of parts of words, by slot, in one flat array. The table is emptied when it has CACHE_PARTS parts, so memory is
    bounded. Slot 0 is END_ID."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same for stems joined by blanks: lower-case composed letters pass the normaliser and the pattern unchanged.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a pre-token.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.n_ids = np.full(1 << 16, END_ID, np.uint32), 1
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.count[0], self.n = 1, 1

    def _add(self, ids: np.ndarray, count: np.ndarray) -> int:
        """Append words' ids; returns the first new slot."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(count) > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.count, np.zeros_like(self.count)])
        first = self.n
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.begin[first : first + len(count)] = self.n_ids + np.cumsum(count) - count
        self.count[first : first + len(count)] = count
        self.n_ids, self.n = self.n_ids + len(ids), first + len(count)
        return first

    def flat(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``slots`` one after another, and where each slot's ids end."""
        count = self.count[slots]
        end = np.cumsum(count)
        return self.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(self.begin[slots] - end + count, count)], end

    def _encoded(self, words: list[str]) -> int:
        ids: list[int] = []
        count = []
        for at in range(0, len(words), 10_000):
            for e in self.tokenizer.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False):
                ids += e.ids
                count.append(len(e))
        return self._add(np.array(ids, np.uint32), np.array(count, np.int64))

    def _letters(self, stems: list[str]) -> int:
        """The same for lower-case Latin-1 words, many at once: each is one pre-token, whose end its last id tells."""
        first = self.n
        lines = [" ".join(stems[at : at + 300]) for at in range(0, len(stems), 300)]
        for at in range(0, len(lines), 30):
            for e in self.letters.encode_batch_fast(lines[at : at + 30], add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                self._add(ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if self.n != first + len(stems):
            raise ValueError("a run of letters is not one pre-token of the vocabulary")
        return first

    def of(self, parts: list[str], letters: np.ndarray) -> np.ndarray:
        """Slots of ``parts``, which are distinct; unknown ones are learnt. ``letters``: which are runs of letters."""
        found = np.fromiter(map(self.slots.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0)
        if len(new) and len(self.slots) + len(new) > CACHE_PARTS and self.slots:
            self._empty()
            return self.of(parts, letters)
        for these, learn in ((new[letters[new]], self._letters), (new[~letters[new]], self._encoded)):
            words = [parts[k] for k in these.tolist()]
            first = learn(words)
            found[these] = np.arange(first, first + len(words))
            self.slots.update(zip(words, range(first, first + len(words)), strict=True))
        return found


_LOADED: dict[str, _Ids] = {}


def word_parts(offsets: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without white space, where each part starts in them and the last ends, its text, whether it is a run of
    letters) of the texts in ``buf``.

    Upper-case Latin-1 letters become lower-case, as the vocabulary has it. Words of Latin-1 letters, digits and ASCII
    signs other than ' fall into runs of letters, single digits and runs of signs, as the vocabulary's pattern cuts them;
    other words stay whole."""
    buf = LOWER[buf]
    pair = np.zeros(len(buf) + 1, bool)  # the first byte of a letter from U+00C0 to U+00FF
    pair[:-2] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    second = np.concatenate([[False], pair[:-2]]) if len(buf) else pair[:0]
    buf[second & (buf < 0x9F)] += 0x20
    kind = KINDS[buf]
    kind[pair[:-1] | second] = 1
    odd = np.flatnonzero(kind == 4)
    start, end = word_ranges(buf, offsets)[:2] if len(odd) else (odd, odd)
    whole = np.unique(np.searchsorted(start, odd, "right") - 1)
    length = end[whole] - start[whole]
    kind[np.arange(length.sum()) + np.repeat(start[whole] - np.cumsum(length) + length, length)] = 4
    inside = kind > 0
    cut = np.ones(len(buf), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    cut &= inside
    at = np.flatnonzero(cut)
    return buf[inside], np.append(np.flatnonzero(cut[inside]), np.count_nonzero(inside)), np.searchsorted(offsets, at, "right") - 1, kind[at] == 1


def _ids_of(table: _Ids, offsets: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in ``buf`` one after another, END_ID after each, and where each text's ids end."""
    solid, bounds, row, letters = word_parts(offsets, buf)
    kind, width = (pa.StringArray, np.int32) if len(buf) < 1 << 31 else (pa.LargeStringArray, np.int64)
    parts = kind.from_buffers(len(row), pa.py_buffer(bounds.astype(width)), pa.py_buffer(solid)).dictionary_encode()
    index = parts.indices.to_numpy()
    of_part = np.zeros(len(parts.dictionary), bool)
    of_part[index] = letters
    slots = table.of(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), of_part)
    n = len(offsets) - 1
    last = np.searchsorted(row, np.arange(n), "right") + np.arange(n)
    whole = np.zeros(len(row) + n, np.int64)
    inner = np.ones(len(whole), bool)
    inner[last] = False
    whole[inner] = slots[index]
    ids, until = table.flat(whole)
    return ids, until[last]


def _pieces_of(path: str | None, limit: int):
    """mapInArrow function: documents to pieces of at most ``limit`` ids.

    Normaliser and pre-tokeniser of the vocabulary look at no character across white space, so each run of other
    characters is encoded once and its ids are reused, also by later tasks of the same worker."""

    def run(batches):
        file = path or vocabulary_path()
        if file not in _LOADED:
            _LOADED[file] = _Ids(file)
        table = _LOADED[file]
        for batch in batches:
            docs = batch.column("doc_id")
            for first, offsets, buf in text_parts(batch.column("text"), PART_BYTES):
                ids, end = _ids_of(table, offsets, buf)
                begin = np.concatenate([[0], end[:-1]])
                pieces = -(-(end - begin) // limit)
                row = np.repeat(np.arange(len(end)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(end[row] - begin[row] - start, limit)
                data, at = memoryview(ids.astype("<u4").tobytes()), begin[row] + start
                crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                columns = (docs.take(pa.array(first + row)), piece, start, length, crc)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(columns, _TYPES, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenise(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of every document: its ids, then END_ID, cut only where longer than ``limit``. ``path``: the vocabulary file
    on the executors; by default each finds its own."""
    return docs.select("doc_id", "text").mapInArrow(_pieces_of(path, limit), PIECES)


# packing --------------------------------------------------------------------------------------------

#: kind 0: a waiting document; 1: a gap; 2: a document (id, size) that takes a gap (gap, gap_size).
SWEPT = "part int, kind int, id long, size long, gap long, gap_size long, rank long"
_SWEPT = ("part", "kind", "id", "size", "gap", "gap_size", "rank")


def matched(size: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents and of the gaps they take, in arrays sorted by size with documents before equal gaps.

    Each gap, from the least on, takes the longest document before it that is still waiting: the successor sweep is the
    matching of brackets, where a document opens and a gap closes."""
    level = np.cumsum(np.where(is_gap, -1, 1)) + is_gap
    order = np.argsort(level, kind="stable")
    gap, level = is_gap[order], level[order]
    at = np.flatnonzero(~gap[:-1] & gap[1:] & (level[:-1] == level[1:]))
    return order[at], order[at + 1]


def _batch(**columns) -> pa.RecordBatch:
    n = len(columns["id"])
    filled = {"part": np.zeros(n, np.int32), "gap": None, "gap_size": None, "rank": None} | columns
    types = {"part": pa.int32(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(filled[c], types.get(c, pa.int64())) if filled[c] is not None else pa.nulls(n, pa.int64()) for c in _SWEPT], list(_SWEPT))


def _sweep(batches):
    """One sorted range: its matches, and what stays open, ranked by size."""
    from pyspark import TaskContext

    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    kind, ids, size = (table.column(c).to_numpy() for c in ("kind", "id", "size"))
    doc, gap = matched(size, kind == 1)
    yield _batch(kind=np.full(len(doc), 2), id=ids[doc], size=size[doc], gap=ids[gap], gap_size=size[gap])
    open_ = np.ones(len(ids), bool)
    open_[doc] = open_[gap] = False
    part = TaskContext.get().partitionId()
    for k in (0, 1):
        left = np.flatnonzero(open_ & (kind == k))
        yield _batch(part=np.full(len(left), part), kind=np.full(len(left), k), id=ids[left], size=size[left], rank=np.arange(len(left)))


def carried(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What the ranges leave open, matched across their bounds: (document's part, its highest rank, gap's part, its
    lowest rank, number) from (part, documents, gaps) by ascending part. There are at most two for each part."""
    waiting: list[list[int]] = []
    out = []
    for part, docs, gaps in sorted(counts):
        taken = 0
        while taken < gaps and waiting:
            origin, top = waiting[-1]
            n = min(top, gaps - taken)
            out.append((origin, top - 1, part, taken, n))
            taken += n
            if n == top:
                waiting.pop()
            else:
                waiting[-1][1] = top - n
        if docs:
            waiting.append([part, docs])
    return out


def _keyed(segments: list[tuple[int, int, int, int, int]], opens: tuple[int, int] | None, limit: int):
    """mapInArrow function: a key for each document and gap that ``carried`` pairs, the same for both; and from (part, rank)
    ``opens`` on, each waiting document takes a new sequence, which has its own id."""
    number = np.cumsum([0, *(s[4] for s in segments)])
    sides = {0: [(s[0], s[1] - s[4] + 1, s[4], k) for k, s in enumerate(segments)], 1: [(s[2], s[3], s[4], k) for k, s in enumerate(segments)]}
    sides = {kind: np.array(sorted(rows), np.int64).reshape(-1, 4).T for kind, rows in sides.items()}

    def run(batches):
        for batch in batches:
            part, kind, ids, size, gap, gap_size, rank = (batch.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in _SWEPT)
            key = np.full(len(part), -1, np.int64)
            for side, (of, low, n, segment) in sides.items():
                if len(of) and len(part):
                    base = int(max(low.max(), rank.max())) + 1
                    at = np.maximum(np.searchsorted(of * base + low, part * base + rank, "right") - 1, 0)
                    into = rank - low[at]
                    hit = (kind == side) & (of[at] == part) & (into >= 0) & (into < n[at])
                    key[hit] = (number[segment[at]] + (n[at] - 1 - into if side == 0 else into))[hit]
            if opens:
                new = (kind == 0) & ((part > opens[0]) | ((part == opens[0]) & (rank >= opens[1])))
                kind, gap, gap_size = np.where(new, 2, kind), np.where(new, ids, gap), np.where(new, limit, gap_size)
            columns = [pa.array(kind, pa.int32()), pa.array(ids), pa.array(size), *(pa.array(x, mask=x < 0) for x in (gap, gap_size, key))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "id", "size", "gap", "gap_size", "key"])

    return run


KEYED = "kind int, id long, size long, gap long, gap_size long, key long"


def longest(counts: list[tuple[int, int]], n: int) -> tuple[int, int]:
    """(part, rank) from which the ``n`` longest documents begin, from (part, documents) of the sorted ranges."""
    for part, docs in sorted(counts, reverse=True):
        if docs >= n:
            return part, docs - n
        n -= docs
    return -1, 0


def fits(waiting: DataFrame, gaps: DataFrame, limit: int = LIMIT, rounds: int | None = None) -> DataFrame:
    """(id, sequence_id, offset) of each waiting document (id, size); ``gaps``: (id of a sequence, size left).
    With ``rounds``, only of those placed in so many rounds, and no sequence is opened.

    Each round sorts waiting documents and gaps into ranges by size (equal sizes by id, so a common length is spread),
    sweeps every range for itself, carries what the ranges leave open across their bounds, and shrinks the gaps taken.
    Conflicts go by rank: a gap holds one document a round, the longest first. Where nothing fits, as many sequences
    open as the waiting ids need at least, with the longest documents. Only counts by range come to the driver."""
    state = waiting.select(F.lit(0).alias("kind"), "id", "size").union(gaps.where("size > 0").select(F.lit(1), "id", "size"))
    state = written(state)
    n = state.groupBy("kind").agg(F.count("*").alias("n"), F.min("size").alias("least")).collect()
    n_rows, least = {r["kind"]: r["n"] for r in n}, {r["kind"]: r["least"] for r in n}
    placed = []
    while n_rows.get(0) and (rounds is None or len(placed) < rounds):
        usable = state.where((F.col("kind") == 0) | (F.col("size") >= least[0]))
        parts = 1 + sum(n_rows.values()) // SWEEP_ROWS
        ranges = usable.coalesce(1) if parts == 1 else usable.repartitionByRange(parts, "size", "kind", "id")
        swept = written(ranges.sortWithinPartitions("size", "kind", "id").mapInArrow(_sweep, SWEPT))
        found = swept.groupBy("part", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("size").alias("least")).collect()
        of = {(r["part"], r["kind"]): r for r in found}
        count = lambda part, kind: of[part, kind]["n"] if (part, kind) in of else 0
        open_parts = sorted({p for p, k in of if k < 2})
        segments = carried([(p, count(p, 0), count(p, 1)) for p in open_parts])
        opens = None
        if not segments and not any(k == 2 for _, k in of):
            if rounds is not None:
                break
            opens = longest([(p, count(p, 0)) for p in open_parts], -(-sum(r["all"] for (_, k), r in of.items() if k == 0) // limit))
        left = swept.where("kind < 2").mapInArrow(_keyed(segments, opens, limit), KEYED)
        pairs = swept.where("kind = 2").select("id", "size", "gap", "gap_size")
        if segments or opens:
            left = written(left)
            docs, free = (left.where(f"kind = {k} and key is not null") for k in (0, 1))
            crossing = docs.select("key", "id", "size").join(free.select("key", F.col("id").alias("gap"), F.col("size").alias("gap_size")), "key")
            pairs = pairs.union(crossing.select("id", "size", "gap", "gap_size")).union(left.where("kind = 2").select("id", "size", "gap", "gap_size"))
            pairs = written(pairs)
        placed.append(pairs.select("id", F.col("gap").alias("sequence_id"), (limit - F.col("gap_size")).alias("offset")))
        rest = left.where("kind < 2 and key is null").select("kind", "id", "size")
        state = rest.union(pairs.where("gap_size > size").select(F.lit(1), "gap", F.col("gap_size") - F.col("size")))
        crossed = sum(s[4] for s in segments)
        opened = sum(count(p, 0) for p in open_parts if p > opens[0]) + (count(opens[0], 0) - opens[1] if opens[0] >= 0 else 0) if opens else 0
        n_rows = {0: sum(count(p, 0) for p in open_parts) - crossed - opened, 1: sum(count(p, 1) for p in open_parts) + sum(r["n"] for (_, k), r in of.items() if k == 2) + opened}
        least = {0: min((r["least"] for (_, k), r in of.items() if k == 0), default=0)}
    out = placed[0] if placed else state.select("id", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where("false")
    for more in placed[1:]:
        out = out.union(more)
    return out


#: A piece of at most this part of the limit is a grain, and ids of the line along which grains are laid that a task takes.
GRAIN, LINE = 16, 1 << 20


def _running(batches):
    """(part, id, size, at): sizes added up along a partition."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column("size").to_numpy().astype(np.int64)
        at = total + np.cumsum(size) - size
        total += int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part), pa.int64()), batch.column("id"), pa.array(size), pa.array(at)], ["part", "id", "size", "at"])


def _laid_out(rows: DataFrame) -> DataFrame:
    """``rows`` (id, size) one after the other on a line: (id, size, at). Only a row for each partition is added up at once."""
    from pyspark.sql import Window

    along = written(rows.select("id", "size").mapInArrow(_running, "part long, id long, size long, at long"))
    sums = along.groupBy("part").agg(F.sum("size").alias("whole"))
    before = sums.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("before"))
    return along.join(before, "part").select("id", "size", (F.col("at") + F.col("before")).alias("at"))


def _met(grains: pa.Table, gaps: pa.Table) -> pa.Table:
    """The gap in which each grain lies whole; none where it crosses an end."""
    order = np.argsort(gaps.column("at").to_numpy(), kind="stable")
    gap, begin, room = (gaps.column(c).to_numpy()[order] for c in ("id", "at", "size"))
    at, size = grains.column("at").to_numpy(), grains.column("size").to_numpy()
    k = np.searchsorted(begin, at, "right") - 1
    whole = (k >= 0) & (at + size <= (begin + room)[np.maximum(k, 0)]) if len(gap) else np.zeros(len(at), bool)
    take = lambda x: pa.array(x[np.maximum(k, 0)] if len(gap) else np.zeros(len(at), np.int64), pa.int64(), mask=~whole)
    return pa.table([grains.column("id"), grains.column("size"), grains.column("at"), take(gap), take(room)], ["id", "size", "at", "gap", "gap_size"])


def poured(grains: DataFrame, gaps: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Places (id, sequence_id, offset) of the grains that lie whole in a gap when all are laid along the gaps in one line,
    and the grains (id, size) that cross an end, at most one for each gap. The gaps must hold all grains together."""
    from pyspark.sql import Window

    line = lambda c: F.floor(F.col(c) / LINE)
    ends = _laid_out(gaps).withColumn("line", F.explode(F.sequence(line("at"), F.floor((F.col("at") + F.col("size") - 1) / LINE))))
    both = _laid_out(grains).withColumn("line", line("at")).groupBy("line").cogroup(ends.groupBy("line"))
    met = written(both.applyInArrow(_met, "id long, size long, at long, gap long, gap_size long"))
    # what lies whole in a gap lies there without holes, behind the one that crosses its start
    offset = F.lit(limit) - F.col("gap_size") + F.col("at") - F.min("at").over(Window.partitionBy("gap"))
    return met.where("gap IS NOT NULL").select("id", F.col("gap").alias("sequence_id"), offset.alias("offset")), met.where("gap IS NULL").select("id", "size")


def _rooms(gaps: DataFrame, places: DataFrame, sizes: DataFrame) -> DataFrame:
    """``gaps`` (id, size) after ``places``, those that still have room."""
    taken = places.join(sizes, "id").groupBy(F.col("sequence_id").alias("id")).agg(F.sum("size").alias("taken"))
    return gaps.join(taken, "id", "left").select("id", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size")).where("size > 0")


def fill(grains: DataFrame, gaps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, sequence_id, offset) of small pieces: many go into a gap at once, so that rounds follow the logarithm of their
    number. They are poured along the gaps that are wide for them and as many new sequences as they need; the few that
    cross an end are swept into what room is left anywhere, and the rest is poured again. New sequences have negative
    numbers."""
    placed, opened = [], 0
    grains, gaps = written(grains), written(gaps.where("size > 0"))
    while (need := grains.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all"), F.max("size").alias("most")).first())["all"]:
        wide = gaps.where(F.col("size") >= 2 * need["most"])
        n = -(-max(0, need["all"] - (wide.agg(F.sum("size")).first()[0] or 0)) // limit)
        new = grains.sparkSession.range(n).select((-1 - opened - F.col("id")).alias("id"), F.lit(limit).cast("long").alias("size"))
        opened += n
        places, crossing = poured(grains, written(wide.union(new)), limit)
        placed.append(written(places))
        gaps = written(_rooms(gaps.union(new), placed[-1], grains))
        grains = written(crossing)
        if grains.isEmpty():
            break
        placed.append(written(fits(grains, gaps, limit, rounds=2)))
        gaps, grains = written(_rooms(gaps, placed[-1], grains)), written(grains.join(placed[-1].select("id"), "id", "left_anti"))
    out = placed[0] if placed else grains.select("id", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for more in placed[1:]:
        out = out.union(more)
    return out


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` with sequence_id and offset: few sequences of at most ``limit`` ids, filled without gaps from 0.

    No two pieces over half the limit share a sequence, so each of these opens one; the others take the gaps, grains last
    and many at once. A sequence's number is that of the piece that opened it, or negative where grains did."""
    numbered = written(pieces.withColumn("_id", F.monotonically_increasing_id()))
    slim = numbered.select(F.col("_id").alias("id"), F.col("length").alias("size"))
    large, grain = 2 * F.col("size") > limit, GRAIN * F.col("size") <= limit
    first = slim.where(large).select("id", (limit - F.col("size")).alias("size"))
    places = written(fits(slim.where(~large & ~grain), first, limit))
    begun = first.union(places.where("id = sequence_id").select("id", F.lit(limit).cast("long")))
    places = places.union(fill(slim.where(grain), _rooms(begun, places, slim), limit))
    out = numbered.join(places.withColumnRenamed("id", "_id"), "_id", "left")
    names = [f"`{c}`" for c in pieces.columns]
    return out.select(*names, F.coalesce("sequence_id", "_id").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) cut and packed.

    A null or empty text is one piece with END_ID alone; a text longer than ``limit`` ids has several pieces, and is held
    whole by one task; repeated rows and null ids are packed each; equal lengths go in any order; an empty table gives
    none; other columns are ignored."""
    return pack(tokenise(docs, path, limit), limit)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
