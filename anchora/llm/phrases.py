"""Phrase collocations from an FM-index per shard.

A task cuts its texts into shards, each of one language. Words that are rare in the whole corpus, pairs of words that are,
and the ends of pieces break a shard's text, as no candidate holds one. What is left is indexed by its Burrows-Wheeler
transform over word ids and by that of its reversal. Intervals of both are extended together, word by word to the right
and to the left, which lists every n-gram up to the wanted length with its count. Counts are summed across shards.

Ids of words come from the exact words, and phrases are told apart by their ids, so no count rests on a hash."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchora.llm.base import LOWER, mix, written

#: Words of a shard and of a task's open shards, text bytes split at once, and pairs of words, or words, in a cell; about.
SHARD_WORDS, TASK_WORDS, PART_BYTES, CELL_PAIRS, CELL_WORDS = 1 << 20, 2 << 20, 1 << 20, 1 << 20, 1 << 18
#: The longest phrase, and shares of a language that are ranked for themselves first.
MAX_WORDS, SHARES = 4, 64

SHARDS = "shard long, lang string, n long, size long, words binary, dictionary binary, counts binary"
WORD_CELLS = "cell int, shard long, lang string, places binary, dictionary binary, counts binary"
WORDS = "shard long, lang string, word string, n long, id long, places binary, ids binary"
CELLS = "cell int, shard long, keys binary, counts binary"
_SPLIT = bytearray(LOWER.tobytes())
for _c in b".,;:!?\n\x0b\x0c\r":
    _SPLIT[_c] = ord(".")


def _cuts(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about PART_BYTES, cut before blanks."""
    at = 0
    while len(data) - at > PART_BYTES and (end := data.find(b" ", at + PART_BYTES)) >= 0:
        yield data[at:end]
        at = end
    yield data[at:]


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """``rows`` as a batch of the columns of ``schema``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


class _Shard:
    """The words of one language's texts in a task, numbered as they come; 0 ends a piece."""

    def __init__(self):
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"."]
        self.waiting, self.bytes, self.parts, self.size = [], 0, [], 0

    def add(self, text: bytes) -> None:
        self.waiting.append(text)
        self.bytes += len(text)
        if self.bytes >= PART_BYTES:
            self.split()

    def split(self) -> None:
        data, self.waiting, self.bytes = b".".join([*self.waiting, b""]), [], 0
        for part in _cuts(data):
            words = part.translate(_SPLIT).replace(b".", b" . ").split()
            self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def row(self, shard: int, lang: str) -> tuple:
        """The shard's word numbers, and its distinct words (none holds a blank) with their counts."""
        self.split()
        words = np.concatenate(self.parts)
        counts = np.bincount(words, minlength=len(self.ids))[1:].astype(np.int64)
        return shard, lang, int(counts.sum()), len(counts), words.tobytes(), b" ".join(list(self.ids)[1:]), counts.tobytes()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the texts of (lang, text). The largest is handed on when it, or all open ones together, are full."""
    number, open_ = TaskContext.get().partitionId() << 32, defaultdict(_Shard)
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            shard = open_[lang]
            total -= shard.size
            shard.add(text)
            total += shard.size
            if shard.size >= SHARD_WORDS or total >= TASK_WORDS:
                full = max(open_, key=lambda x: open_[x].size)
                total -= open_[full].size
                yield _table(SHARDS, [open_.pop(full).row(number, full)])
                number += 1
    for lang, shard in sorted(open_.items()):
        yield _table(SHARDS, [shard.row(number, lang)])
        number += 1


def _word_cells(cells: int):
    """Each shard's distinct words in packed rows by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = r["dictionary"].split(b" ") if r["dictionary"] else [], np.frombuffer(r["counts"], np.int64)
                cell = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % cells
                by, rows = np.argsort(cell, kind="stable"), []
                bounds = np.searchsorted(cell[by], np.arange(cells + 1))
                for c in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = by[bounds[c] : bounds[c + 1]]
                    rows.append((c, r["shard"], r["lang"], (mine + 1).astype(np.int32).tobytes(), b" ".join([words[k] for k in mine.tolist()]), counts[mine].tobytes()))
                yield _table(WORD_CELLS, rows)

    return run


def _frequent_words(min_count: int, cells: int):
    """One cell: words that are frequent in their language, with an id each; and the ids of each shard's own words."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(r["shard"], r["lang"], np.frombuffer(r["places"], np.int32), r["dictionary"].split(b" "), np.frombuffer(r["counts"], np.int64)) for r in table.to_pylist()]
        total: dict[tuple[str, bytes], int] = defaultdict(int)
        for _, lang, _, words, counts in rows:
            for word, n in zip(words, counts.tolist(), strict=True):
                total[lang, word] += n
        cell = table.column("cell")[0].as_py()
        good = [w for w, n in total.items() if n >= min_count]
        ids = {w: 1 + cell + k * cells for k, w in enumerate(good)}  # cells take turns, so that ids stay small
        if good and ids[good[-1]] >= 1 << 32:
            raise ValueError("more than 2**32 frequent words")
        out = [(None, lang, word.decode(), total[lang, word], ids[lang, word], None, None) for lang, word in good]
        for shard, lang, places, words, _ in rows:
            mine = np.array([ids.get((lang, w), 0) for w in words], np.int64)
            if mine.any():
                out.append((shard, None, None, None, None, places[mine > 0].tobytes(), mine[mine > 0].tobytes()))
        return pa.Table.from_batches([_table(WORDS, out)])

    return run


class _Bwt:
    """The transform of ``text`` with suffixes ordered by their first ``depth`` words, and where each row's word leads."""

    def __init__(self, text: np.ndarray, depth: int):
        rank, have = text.astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)
            after = np.zeros_like(rank)
            after[:-step] = rank[step:]
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
            have += step
        order = np.argsort(rank, kind="stable")
        self.before = text[order - 1]  # the text starts and ends with 0, so the first word's neighbour is one too
        self.leads = np.empty(len(text), np.int64)
        self.leads[np.argsort(self.before, kind="stable")] = np.arange(len(text))


class BidirectionalIndex:
    """FM-index over the word ids of ``text`` (0 breaks it) and over its reversal."""

    def __init__(self, text: np.ndarray, max_words: int):
        self.ids, coded = np.unique(np.concatenate([[0], text, [0]]), return_inverse=True)
        self.max_words = max_words
        self.ahead, self.back = _Bwt(coded, max_words - 1), _Bwt(coded[::-1], max_words - 1)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=len(self.ids)))])

    @staticmethod
    def _extend(index: _Bwt, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each interval's phrase with each word before it in ``index``: (interval, word, low, low in the other index, count)."""
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) - first[owner] + low[owner]
        key = owner * np.int64(index.before.max(initial=0) + 1) + index.before[at]
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[by], prepend=-1))
        count = np.diff(start, append=len(by))
        of, word = owner[by[start]], index.before[at[by[start]]]
        smaller = start - first[of]  # of the interval's rows, those before smaller words
        keep = word > 0
        return of[keep], word[keep], index.leads[at[by[start]]][keep], (other[of] + smaller)[keep], count[keep]

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For lengths 2 up to ``max_words``: (ids of the words in columns, counts). The last word is won to the left, those
        before it to the right."""
        words = np.arange(1, len(self.ids))[:, None]
        ahead, back, size = self.starts[1:-1], self.starts[1:-1], np.diff(self.starts)[1:]
        for length in range(2, self.max_words + 1):
            if length < self.max_words or length == 2:
                of, word, back, ahead, size = self._extend(self.back, back, ahead, size)
                words = np.concatenate([words[of], word[:, None]], axis=1)
            else:
                of, word, ahead, back, size = self._extend(self.ahead, ahead, back, size)
                words = np.concatenate([word[:, None], words[of]], axis=1)
            yield self.ids[words], size


def _text_of(shard: pa.Table, known: pa.Table) -> np.ndarray:
    """A shard's text in corpus-wide word ids; 0 for rare words and ends of pieces."""
    local = np.frombuffer(shard.column("words")[0].as_py(), np.int32)
    ids = np.zeros(int(local.max(initial=0)) + 1, np.int64)
    for places, own in zip(known.column("places").to_pylist(), known.column("ids").to_pylist(), strict=True):
        if places is not None:
            ids[np.frombuffer(places, np.int32)] = np.frombuffer(own, np.int64)
    return ids[local]


def _pairs(cells: int):
    """A shard's pairs of words with their counts, in packed rows by cell."""

    def run(shard: pa.Table, known: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if shard.num_rows:
            (pair, counts), *_ = BidirectionalIndex(_text_of(shard, known), 2).phrases()
            keys = pair[:, 0].astype(np.uint64) << np.uint64(32) | pair[:, 1].astype(np.uint64)
            cell = ((mix(keys) >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
            by = np.argsort(cell, kind="stable")
            keys, counts, bounds = keys[by], counts[by].astype(np.uint32), np.searchsorted(cell[by], np.arange(cells + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(bounds))
            of = [slice(bounds[c], bounds[c + 1]) for c in used]
            out = [used, [shard.column("shard")[0].as_py()] * len(used), [keys[s].tobytes() for s in of], [counts[s].tobytes() for s in of]]
        return pa.table([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "shard", "keys", "counts"])

    return run


def _frequent(min_count: int):
    """One cell: the sums across shards. Each shard's pairs that are frequent, and once (without a shard) all with their counts."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        at = np.cumsum([0, *map(len, keys)])
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        total = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)
        good = total >= min_count
        mine = [k[good[back[a:b]]] for k, a, b in zip(keys, at[:-1], at[1:], strict=True)]
        rows = [(s, k.tobytes(), None) for s, k in zip(table.column("shard").to_pylist(), mine, strict=True) if len(k)]
        rows += [(None, distinct[good].tobytes(), total[good].tobytes())] if good.any() else []
        shards, packed, sums = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array([table.column("cell")[0].as_py()] * len(rows), pa.int32()), pa.array(shards, pa.int64()), pa.array(packed, pa.binary()), pa.array(sums, pa.binary())], ["cell", "shard", "keys", "counts"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            p = np.frombuffer(keys, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.zeros(len(p), np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["p", "q", "a"])


def _only_frequent(text: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """``text`` without the words outside frequent pairs, and with a break between neighbours that are no frequent pair."""
    keys = text[:-1].astype(np.uint64) << np.uint64(32) | text[1:].astype(np.uint64)
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    joined = np.zeros(len(text), bool)  # a word and the next one
    joined[:-1] = frequent[at] == keys
    keep = joined.copy()
    keep[1:] |= joined[:-1]
    runs = 1 + ~joined[keep]
    out = np.repeat(text[keep], runs)
    out[np.cumsum(runs)[runs == 2] - 1] = 0
    return out


def _longer(shard: pa.Table, more: pa.Table) -> pa.Table:
    """A shard's phrases of three words and more, of frequent pairs throughout, with their counts."""
    p, q, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    packed = more.column("keys").drop_null().to_pylist()
    if shard.num_rows and packed:
        frequent = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in packed]))
        text = _text_of(shard, more)
        for words, counts in BidirectionalIndex(_only_frequent(text, frequent), MAX_WORDS).phrases():
            if words.shape[1] > 2:
                w = np.zeros((len(words), 4), np.uint64)
                w[:, : words.shape[1]] = words
                p.append((w[:, 0] << np.uint64(32) | w[:, 1]).view(np.int64))
                q.append((w[:, 2] << np.uint64(32) | w[:, 3]).view(np.int64))
                a.append(counts)
    return pa.table([pa.array(np.concatenate(x)) for x in (p, q, a)], ["p", "q", "a"])


def _packed(words: Column) -> list[Column]:
    """(p, q) of up to four word ids."""
    at = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(0).cast("long"))
    return [F.shiftleft(at(0), 32).bitwiseOR(at(1)).alias("p"), F.shiftleft(at(2), 32).bitwiseOR(at(3)).alias("q")]


def _words_of(p: str, q: str) -> Column:
    halves = [f(F.col(c)) for c in (p, q) for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.filter(F.array(*halves), lambda w: w > 0)


def _score() -> Column:
    """floor(2000000 a / (l + r)), exact for any long counts."""
    return F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Each candidate with l, r and score of its lowest cut, and the counts of its most frequent extensions by a word."""
    c = candidates.withColumn("ws", _words_of("p", "q"))
    cuts = c.select("p", "q", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    for name, part in (("l", F.slice("ws", F.lit(1), F.col("k"))), ("r", F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")))):
        x, y = _packed(part)
        cuts = cuts.withColumns({"x": x, "y": y}).join(counts.select(F.col("p").alias("x"), F.col("q").alias("y"), F.col("a").alias(name)), ["x", "y"]).drop("x", "y")
    best = cuts.groupBy("p", "q").agg(F.first("a").alias("a"), F.min(F.struct(_score().alias("score"), "k", "l", "r")).alias("cut"))
    for name, start in (("right_extension", 1), ("left_extension", 2)):
        inner = _packed(F.slice("ws", F.lit(start), F.size("ws") - 1))
        best = best.join(c.where(F.size("ws") > 2).select(*inner, "a").groupBy("p", "q").agg(F.max("a").alias(name)), ["p", "q"], "left")
    return best.select("p", "q", "a", "cut.l", "cut.r", "cut.score", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("left_extension", "right_extension")))


def mine_phrases(docs: DataFrame, min_count: int = 30, absorbed_percent: int = 80, top: int | None = None) -> DataFrame:
    """Phrases of 2 to 4 words of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score, left_extension, right_extension.

    A-Z are lower-cased, texts split at ``.,;:!?`` and line ends, and words at blanks and tabs. a: the phrase's count in its
    language, at least ``min_count``; l and r: the counts of the two parts of its lowest-scoring cut; n: the language's
    words; extensions: the count of the most frequent candidate with one word more on that side, or 0. Phrases of which an
    extension has ``absorbed_percent`` of their occurrences are left out; with ``top``, so are those of a lower rank.

    A null text is empty, a null language ``und``; repeated rows count each; of equal score and count, phrases rank by their
    bytes; an empty table gives no rows; other columns are not read. A very long text is split where it stands, in parts."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    shards = written(texts.mapInArrow(_shards, SHARDS))
    coded = shards.select("shard", "words")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    size = shards.agg(F.sum("n").alias("n"), F.sum("size").alias("distinct")).first()
    word_cells, cells = 1 + (size["distinct"] or 0) // CELL_WORDS, 1 + (size["n"] or 0) // CELL_PAIRS
    dictionaries = shards.select("shard", "lang", "dictionary", "counts").mapInArrow(_word_cells(word_cells), WORD_CELLS)
    words = written(dictionaries.groupBy("cell").applyInArrow(_frequent_words(min_count, word_cells), WORDS))
    known, frequent = words.where("shard IS NOT NULL").select("shard", "places", "ids"), words.where("shard IS NULL").select("lang", "word", "n", "id")
    pairs = coded.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_pairs(cells), CELLS)
    answers = written(pairs.groupBy("cell").applyInArrow(_frequent(min_count), CELLS))
    none = F.lit(None).cast("binary")
    both = known.withColumn("keys", none).union(answers.where("shard IS NOT NULL").select("shard", none, none, "keys"))
    longer = coded.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(_longer, "p long, q long, a long").groupBy("p", "q").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    candidates = written(answers.where("shard IS NULL").mapInArrow(_unpack, "p long, q long, a long").union(longer))
    counts = candidates.union(frequent.select(F.shiftleft("id", 32).alias("p"), F.lit(0).cast("long").alias("q"), F.col("n").alias("a")))
    scored = _scored(candidates, counts)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.where(F.greatest(wide("left_extension"), wide("right_extension")) * 100 < wide("a") * absorbed_percent)
    spelt = scored.select("*", F.posexplode(_words_of("p", "q")).alias("place", "id")).join(frequent.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("p", "q").agg(*(F.first(c).alias(c) for c in ("lang", "a", "l", "r", "score", "left_extension", "right_extension")), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("ws"))
    spelt = spelt.withColumn("phrase", F.array_join("ws.word", " ")).join(totals, "lang")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top:  # the first of each share, so that a language's last sort is bounded
        shares = Window.partitionBy("lang", F.pmod(F.xxhash64("p", "q"), F.lit(SHARES)))
        spelt = spelt.withColumn("place", F.row_number().over(shares.orderBy(*order))).where(F.col("place") <= top)
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_extension", "right_extension")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), top=2000).drop("left_extension", "right_extension")
