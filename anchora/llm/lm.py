"""Language-model scores: a bigram model by deleted interpolation over corpus-wide counts.

Training documents are an estimation part and a held-out part, by a hash of their text, so copies stay together. Mixture
weights come from the held-out tokens under the counts of the estimation part; scores use the counts of both.

Documents form batches by hash. A batch asks for the counts of its distinct n-grams with one packed row for each hash
cell; the cell adds up what all batches counted and answers each in the same order. So a corpus-wide vocabulary is
never gathered anywhere, and no n-gram is dropped. Batches and cells grow with the square root of the input up to a
bound, so that the packed rows grow with the input and not with its square; beyond the bound a batch still sends no row
to a cell of which it has no n-gram, so its rows are at most its distinct n-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchora.llm.base import LOWER, Rolling, fold, mix, text_parts, word_ranges, written

#: Text bytes in a batch of documents and in a cell of n-grams, about, for inputs of up to SCALE_BYTES; and at most.
BATCH_BYTES, SCALE_BYTES, MOST_BYTES = 16 << 20, 4 << 30, 128 << 20
#: One training text in so many is held out.
HELD_OUT = 8
#: Rounds of EM, steps of the histogram's grid for each factor of two, and tokens that hold a bucket to all contexts.
EM_ROUNDS, STEPS, PRIOR = 30, 8, 20.0
#: Whose counts: of the estimation part, of the held-out part; what a document is else.
ESTIMATE, HELD, NEITHER = 0, 1, 2

CELLS = "cell int, batch int, kind int, grams binary, counts binary, held binary"
ANSWERS = "batch int, cell int, kind int, counts binary, held binary, total long, held_total long, distinct long, first_distinct long"


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one batch's documents: unigram and bigram of each token in order, its document, and each document's part."""
    unigrams, bigrams, rows, base = [], [], [], 0
    for chunk in table.column("text").chunks:
        for _, offsets, buf in text_parts(chunk):
            buf = LOWER[buf]
            start, end, row = word_ranges(buf, offsets)
            n = len(offsets) - 1
            word = Rolling(buf).of(start, end) | np.uint64(1)  # odd; the end token is 0, the start's context 2
            at = np.searchsorted(row, np.arange(n), "right") + np.arange(n)
            tokens, doc = np.zeros(len(word) + n, np.uint64), np.zeros(len(word) + n, np.int64)
            inner = np.ones(len(tokens), bool)
            inner[at] = False
            tokens[inner], doc[inner], doc[at] = word, row, np.arange(n)
            context = np.empty_like(tokens)
            context[1:] = tokens[:-1]
            if n:
                context[np.concatenate([[0], at[:-1] + 1])] = 2
            unigrams.append(tokens)
            bigrams.append(mix(mix(context) + tokens * np.uint64(0x9E3779B97F4A7C15)))
            rows.append(doc + base)
            base += n
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(unigrams, np.uint64), join(bigrams, np.uint64), join(rows, np.int64), table.column("part").to_numpy()


def _cell_of(grams: np.ndarray, cells: int) -> np.ndarray:
    """Cells are ranges of the mixed hash, so sorted n-grams are in cell order."""
    return ((grams >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)


def _ask(cells: int):
    def run(key, table):
        unigrams, bigrams, rows, part = _columns(table)
        used = part[rows]
        out = {"cell": [], "kind": [], "grams": [], "counts": [], "held": []}
        for kind, grams in enumerate((mix(unigrams), bigrams)):
            distinct, back = np.unique(grams, return_inverse=True)
            counts = [np.bincount(back, weights=used == k, minlength=len(distinct)).astype(np.uint32) for k in (ESTIMATE, HELD)]
            bounds = np.searchsorted(_cell_of(distinct, cells), np.arange(cells + 1, dtype=np.uint64))
            for cell in np.flatnonzero(np.diff(bounds)):
                of = slice(bounds[cell], bounds[cell + 1])
                out["cell"].append(cell)
                out["kind"].append(kind)
                out["grams"].append(_bytes_of(distinct[of]))
                for name, c in zip(("counts", "held"), counts, strict=True):
                    out[name].append(_packed(c[of]))
        n = len(out["cell"])
        blobs = [pa.array(out[c], pa.binary()) for c in ("grams", "counts", "held")]
        return pa.table([pa.array(out["cell"], pa.int32()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array(out["kind"], pa.int32()), *blobs], ["cell", "batch", "kind", "grams", "counts", "held"])

    return run


def _bytes_of(grams: np.ndarray) -> bytes:
    """Ascending 64-bit hashes: the first one, how many bytes the widest step takes, and all steps in so many bytes. A batch
    has so many bigrams that six bytes do."""
    steps = np.diff(grams)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return b"".join((grams[:1].tobytes(), np.uint8(width).tobytes(), np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()))


def _grams_of(data: bytes) -> np.ndarray:
    width = data[8]
    n = (len(data) - 9) // width
    wide = np.zeros((n + 1, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8)
    wide[1:, :width] = np.frombuffer(data, np.uint8, n * width, 9).reshape(n, width)
    return np.cumsum(wide.view(np.uint64)[:, 0], dtype=np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more stand behind them, by place, and their number comes first. Most counts are
    0, 1 or little more, in no order, so they are sent as a Huffman code of these bytes and their runs."""
    large = np.flatnonzero(counts >= 255).astype(np.uint32)
    coder = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return coder.compress(b"".join((np.uint32(len(large)).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes(), counts[large].astype(np.uint32).tobytes()))) + coder.flush()


def _unpacked(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    large = int(np.frombuffer(data, np.uint32, 1)[0])
    n = len(data) - 4 - 8 * large
    counts = np.frombuffer(data, np.uint8, n, 4).astype(np.uint32)
    counts[np.frombuffer(data[4 + n : 4 + n + 4 * large], np.uint32)] = np.frombuffer(data[4 + n + 4 * large :], np.uint32)
    return counts


def _answer(table: pa.Table) -> pa.Table:
    """One cell and kind: add the batches' counts and give each batch the totals of what it asked for."""
    kind = table.column("kind")[0].as_py()
    grams = [_grams_of(x) for x in table.column("grams").to_pylist()]
    at = np.cumsum([0, *map(len, grams)])
    distinct, back = np.unique(np.concatenate(grams), return_inverse=True)
    del grams
    totals, answers = [], []
    for name in ("counts", "held"):
        counts = np.concatenate([_unpacked(x) for x in table.column(name).to_pylist()])
        totals.append(np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.uint32))
        answers.append([_packed(totals[-1][back[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)])
    n = len(at) - 1
    once = lambda x: pa.array([int(x) if kind == 0 else 0] + [0] * (n - 1), pa.int64())
    sums = [once(totals[0].sum(dtype=np.int64)), once(totals[1].sum(dtype=np.int64)), once(((totals[0] > 0) | (totals[1] > 0)).sum()), once((totals[0] > 0).sum())]
    return pa.table(
        [table.column("batch"), table.column("cell"), table.column("kind"), *(pa.array(x, pa.binary()) for x in answers), *sums],
        ["batch", "cell", "kind", "counts", "held", "total", "held_total", "distinct", "first_distinct"],
    )


def _counted(table: pa.Table, answers: pa.Table, whole: bool) -> tuple[np.ndarray, ...]:
    """Per token: its word's count, its bigram's (of the estimation part, or of the ``whole`` training text), whether it
    starts a document, its document; and each document's part."""
    unigrams, bigrams, rows, part = _columns(table)
    kinds, cells = answers.column("kind").to_numpy(), answers.column("cell").to_numpy()
    names = ("counts", "held") if whole else ("counts",)
    found = []
    for kind, grams in enumerate((mix(unigrams), bigrams)):
        mine = np.flatnonzero(kinds == kind)
        mine = mine[np.argsort(cells[mine])]
        of = [np.concatenate([_unpacked(answers.column(c)[int(i)].as_py()) for i in mine]) if len(mine) else np.zeros(0, np.uint32) for c in names]
        totals = sum(x.astype(np.int64) for x in of)
        back = np.unique(grams, return_inverse=True)[1]
        found.append(totals[back] if len(back) else np.zeros(0, np.int64))
    starts = np.ones(len(rows), bool)
    starts[1:] = rows[1:] != rows[:-1]
    return found[0], found[1], starts, rows, part


def _parts(c1: np.ndarray, c2: np.ndarray, starts: np.ndarray, n: int, v: int, n_docs: int):
    """Context bucket and the three estimates of each token."""
    before = np.empty_like(c1)
    before[1:] = c1[:-1]
    before[starts] = n_docs
    p2 = np.where(before > 0, c2 / np.maximum(before, 1), 0.0)
    bucket = np.where(before > 0, 1 + np.log2(np.maximum(before, 1)).astype(np.int64), 0)
    return bucket, p2, c1 / max(n, 1), 1.0 / (v + 1)


def _held_out(n: int, v: int, n_docs: int):
    """Histogram of (bucket, log p2, log p1) over held-out tokens, by the counts of the estimation part."""

    def run(table, answers):
        c1, c2, starts, rows, part = _counted(table, answers, whole=False)
        bucket, p2, p1, _ = _parts(c1, c2, starts, n, v, n_docs)
        grid = lambda p: np.where(p > 0, 1 + np.round(-STEPS * np.log2(np.maximum(p, 1e-30))).astype(np.int64), 0)
        key = (bucket << 20 | grid(p2) << 10 | grid(p1))[part[rows] == HELD]
        keys, counts = np.unique(key, return_counts=True)
        return pa.table([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])

    return run


def learn_weights(rows: list[tuple[int, int]], v: int, rounds: int = EM_ROUNDS, buckets: int = 64) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context-frequency bucket, by expectation-maximisation."""
    keys = np.array([k for k, _ in rows], np.int64)
    n = np.array([c for _, c in rows], np.float64)
    value = lambda g: np.where(g > 0, 2.0 ** (-(g - 1) / STEPS), 0.0)
    bucket = keys >> 20
    p = np.stack([value((keys >> 10) & 1023), value(keys & 1023), np.full(len(keys), 1.0 / (v + 1))], axis=1)
    # all contexts together first; then each bucket, which starts from that and is held to it by PRIOR tokens
    whole = _maximise(np.zeros(len(keys), np.int64), p, n, np.array([[0.4, 0.5, 0.1]]), rounds, 0.0)
    weights = _maximise(bucket, p, n, np.tile(whole, (buckets, 1)), rounds, PRIOR)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _maximise(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, weights: np.ndarray, rounds: int, prior: float) -> np.ndarray:
    start = weights
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, weights=share[:, k], minlength=len(start)) for k in range(3)], axis=1) + prior * start + 1e-3
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def _scored(weights: np.ndarray, n: int, v: int, n_docs: int):
    def run(table, answers):
        c1, c2, starts, rows, part = _counted(table, answers, whole=True)
        bucket, p2, p1, p0 = _parts(c1, c2, starts, n, v, n_docs)
        w = weights[bucket]
        size = table.num_rows
        total = lambda x: np.bincount(rows, weights=x, minlength=size)
        base = total(np.log10((c1 + 1) / (n + 1 * (v + 1))))
        score = total(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0))
        return pa.table(
            [table.column("doc_id"), pa.array(part != NEITHER), pa.array(total(np.ones(len(rows))).astype(np.int64)), pa.array(total(c1 > 0).astype(np.int64)), pa.array(base), pa.array(score)],
            ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def part_bytes(all_bytes: int) -> int:
    """Text bytes of a batch and of a cell for an input of ``all_bytes``."""
    return max(BATCH_BYTES, min(MOST_BYTES, int(BATCH_BYTES * (all_bytes / SCALE_BYTES) ** 0.5)))


def score_documents(docs: DataFrame, train: str = "train") -> DataFrame:
    """Per row of ``docs`` (doc_id, text and a boolean ``train``): n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (ASCII lower case) and one end. base_score: add-one unigram; score: log10 probability under
    interpolated bigram, unigram and uniform estimates. Counts come from all rows with ``train``; mixture weights from
    those of them that are held out, and where there are none from the starting weights. A null or empty text has the end
    token alone; without training rows all counts are 0; repeated rows and null ids stay; an empty table gives none; a
    very long text is one batch of its own, whose memory follows that text."""
    part = F.when(~F.coalesce(F.col(train), F.lit(False)), NEITHER).when(F.pmod(F.xxhash64("text", F.lit("held out")), F.lit(HELD_OUT)) == 0, HELD).otherwise(ESTIMATE)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train).select("doc_id", "text", part.alias("part"))
    size = d.agg(F.sum(F.octet_length("text")).alias("bytes"), *(F.sum((F.col("part") == k).cast("long")).alias(n) for k, n in ((ESTIMATE, "first"), (HELD, "held")))).first()
    first_docs, n_docs = size["first"] or 0, (size["first"] or 0) + (size["held"] or 0)
    batches = 1 + (size["bytes"] or 0) // part_bytes(size["bytes"] or 0)
    d = d.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))
    asked = d.groupBy("batch").applyInArrow(_ask(batches), CELLS)
    answers = written(asked.groupBy("cell", "kind").applyInArrow(_answer, ANSWERS))
    sums = answers.agg(*(F.sum(c).alias(c) for c in ("total", "held_total", "distinct", "first_distinct"))).first()
    first_n, n, first_v, v = sums["total"] or 0, (sums["total"] or 0) + (sums["held_total"] or 0), sums["first_distinct"] or 0, sums["distinct"] or 0
    slim = lambda *more: answers.select("batch", "cell", "kind", "counts", *more)
    held_out = d.groupBy("batch").cogroup(slim().groupBy("batch")).applyInArrow(_held_out(first_n, first_v, first_docs), "key long, n long")
    grid = held_out.groupBy("key").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([(r["key"], r["n"]) for r in grid], first_v)
    out = d.groupBy("batch").cogroup(slim("held").groupBy("batch")).applyInArrow(
        _scored(weights, n, v, n_docs), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_documents(docs.select("doc_id", "text", (fold(F.col("doc_id"), 7) != 2).alias("train")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
