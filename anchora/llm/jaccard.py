"""N-gram Jaccard join by parity sketches.

A document's shingles fall into chunks by hash, and each flips one bit of its chunk: the Hamming distance of two
sketches is a lower bound of the sets' symmetric difference. Similar sets differ in fewer elements than there are
chunks, so they agree in several whole chunks; documents of one size band meet on (band, chunk, XOR of the chunk's
hashes). A document that must agree in ``a`` chunks leaves out its a - 1 most common keys, as one of the rarer ones is
shared as well. Only what the bound lets through is compared shingle by shingle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.llm.base import LOWER, Rolling, mix, semi_by_id, text_parts, word_ranges, written
from anchora.plans.components import components

#: Size bands grow by this factor; the similarity asked for is in hundredths.
BAND_GROWTH = 1.4
#: Rows of a key that one task compares with each other, or with as many others.
TILE = 1024
#: Bytes of text whose shingles are hashed at once; the prefix sums take 32 times as many.
PART_BYTES = 1 << 19
#: Up to this many documents with shared keys, their ids (8 bytes each) are broadcast to pick their texts.
BROADCAST_IDS = 200_000


def band_tops(threshold: int, largest: int = 1 << 40) -> list[int]:
    """Largest set size of each band."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_GROWTH)))
    return tops


def chunk_count(top: int, threshold: int) -> tuple[int, int]:
    """(chunks, chunks in which similar sets of at most ``top`` elements agree at least).

    J >= t/100 means that the difference is at most (a + b) * (100 - t) / (100 + t). A few chunks more than that allow
    to leave out empty chunks, which say nothing, where a set has fewer of them than agreeing chunks."""
    most = 2 * top * (100 - threshold) // (100 + threshold)
    more = 1 + (max(1, most // 8) if most else 0)
    return most + more, more


def shingles(offsets: np.ndarray, buf: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted: ``width`` words, or all of them where there are fewer."""
    buf = LOWER[buf]
    start, end, row = word_ranges(buf, offsets)
    word = Rolling(buf).of(start, end)
    n = len(offsets) - 1
    lo = np.searchsorted(row, np.arange(n + 1))
    total = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - width + 1 + k] + np.uint64(1))
    out = []
    for r in range(n):
        a, b = lo[r], lo[r + 1]
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(0xC2B2AE3D27D4EB4F) + word[k])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity_sketch(hashes: np.ndarray, top: int, threshold: int, band: int) -> tuple[bytes, np.ndarray, int]:
    """(sketch of 8 bits for each chunk, join keys of the chunks with the band in the low byte, how many of the keys a
    similar set of the band shares at least).

    A set with enough empty chunks lists them too; what it shares with one that does not is one key for sure."""
    chunks, agree = chunk_count(top, threshold)
    chunk = ((hashes >> np.uint64(20)) % np.uint64(chunks)).astype(np.int64)
    bits, xor = np.zeros(chunks, np.uint8), np.zeros(chunks, np.uint64)
    np.bitwise_xor.at(bits, chunk, np.uint8(1) << (hashes & np.uint64(7)).astype(np.uint8))
    np.bitwise_xor.at(xor, chunk, mix(hashes))
    place = np.arange(chunks, dtype=np.uint64) * np.uint64(4096) + np.uint64(band)
    keys = mix(xor + place * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(255) | np.uint64(band)
    empty = np.bincount(chunk, minlength=chunks) == 0
    if empty.sum() < agree:
        return bits.tobytes(), keys[~empty], agree - int(empty.sum())
    return bits.tobytes(), keys, 1


def _bands(hashes: np.ndarray, tops: np.ndarray, threshold: int):
    """(band, sketch, keys, keys shared at least) in the set's own band, and in the next one where a similar set can lie
    there."""
    if not len(hashes):
        return
    band = int(np.searchsorted(tops, len(hashes)))
    yield band, *parity_sketch(hashes, int(tops[band]), threshold, band)
    if 100 * len(hashes) >= threshold * (int(tops[band]) + 1):
        yield band + 1, *parity_sketch(hashes, int(tops[band + 1]), threshold, band + 1)


def _set_rows(width: int, threshold: int):
    """What tells equal sets (their size, the XOR and the sum of their hashes), and their sketches."""
    tops = np.array(band_tops(threshold))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, offsets, buf in text_parts(batch.column("text"), PART_BYTES):
                sets = shingles(offsets, buf, width)
                xor = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
                added = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                columns = [ids.slice(first, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array(xor.astype(np.int64)), pa.array(added.astype(np.int64))]
                sketches, shared = [], []
                for x in sets:
                    found = list(_bands(x, tops, threshold))
                    sketches.append([bits for _, bits, _, _ in found])
                    shared.append([(band, least) for band, _, _, least in found])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sketches, pa.list_(pa.binary())), pa.array(shared, pa.map_(pa.int32(), pa.int32()))], ["doc_id", "n", "xor", "added", "sketches", "shared"])

    return run


def _key_rows(width: int, threshold: int):
    """(key, id) for each chunk of each text."""
    tops = np.array(band_tops(threshold))

    def run(batches):
        for batch in batches:
            rows = batch.column("doc_id").to_pylist()
            for first, offsets, buf in text_parts(batch.column("text"), PART_BYTES):
                keys, ids = [], []
                for k, x in enumerate(shingles(offsets, buf, width)):
                    if rows[first + k] is None:
                        continue
                    for _, _, data, _ in _bands(x, tops, threshold):
                        keys.append(data)
                        ids.append(np.full(len(data), rows[first + k], np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(ids))], ["key", "id"])

    return run


def _shared_keys(batches):
    """Of rows sorted by (key, id): the distinct ones whose key two or more ids have. One batch is held at a time."""
    key, id_, wide = None, None, False  # the last row, and whether its key has had another id

    for batch in batches:
        keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if not len(keys):
            continue
        if key is not None:
            keys, ids = np.concatenate([[key], keys]), np.concatenate([[id_], ids])
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[fresh], ids[fresh]
        twin = np.zeros(len(keys) + 1, bool)
        twin[1:-1] = keys[1:] == keys[:-1]
        keep = twin[:-1] | twin[1:]
        if key is not None:
            keep[0] &= not wide  # sent before
        keep[-1] &= bool(twin[-2])
        if len(keys) > 1 or key is None:
            wide = bool(twin[-2])
        key, id_ = keys[-1], ids[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep])], ["key", "id"])


def _near_in_tiles(table: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (lesser id, greater id) of whole tiles that stand one after the other in ``table``.

    Rows of one sketch width are compared at once: each with the next row of its tile, then with the one after it."""
    key, width, tile, part, ids, sizes, labels = (table.column(c).to_numpy() for c in ("key", "width", "tile", "part", "id", "n", "label"))
    bits = table.column("bits").combine_chunks()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (width[1:] != width[:-1]) | (tile[1:] != tile[:-1])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    two = np.minimum.reduceat(part, at) != np.maximum.reduceat(part, at)
    found = []
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        mine = bits.take(pa.array(rows))
        sketch = np.frombuffer(mine.buffers()[2], np.uint8, len(rows) * int(w)).reshape(len(rows), int(w))
        g, p, n, label = group[rows], part[rows], sizes[rows], labels[rows]
        for step in range(1, len(rows)):
            a = np.flatnonzero(g[:-step] == g[step:])
            if not len(a):
                break
            b = a + step
            keep = (label[a] != label[b]) & (~two[g[a]] | (p[a] != p[b])) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * threshold)
            a, b = a[keep], b[keep]
            far = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
            near = far * (100 + threshold) <= (n[a] + n[b]) * (100 - threshold)
            found.append((ids[rows[a[near]]], ids[rows[b[near]]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def _tile_pairs(threshold: int, max_bytes: int = 4 << 20):
    """Of rows sorted by (key, width, tile): all pairs of different labels in each tile whose sketches' distance allows the
    similarity; in a tile of two parts, pairs of one row from each. Some megabytes of whole tiles are held at a time."""
    names = ("key", "width", "tile")

    def emit(table: pa.Table):
        a, b = _near_in_tiles(table, threshold)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.nbytes for t in held) < max_bytes:
                continue
            table = pa.concat_tables(held)
            last = np.ones(table.num_rows, bool)  # rows of the last tile, which may go on
            for c in names:
                column = table.column(c).to_numpy()
                last &= column == column[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield from emit(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            yield from emit(pa.concat_tables(held))

    return run


def _in_tiles(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n, label, bits) with the tile of each meeting: a key's rows of one sketch width fall into parts of
    about TILE by their id, and every two parts meet in a tile, each part also alone."""
    rows = rows.withColumn("width", F.length("bits"))
    parts = written(rows.groupBy("key", "width").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).where("parts > 1"))
    split = rows.join(parts, ["key", "width"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least("part", other) * F.col("parts") + F.greatest("part", other))
    return split.withColumn("tile", F.explode(tile)).select("key", "width", "tile", "part", "id", "n", "label", "bits")


def _shingle_rows(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, offsets, buf in text_parts(batch.column("text"), PART_BYTES):
                sets = shingles(offsets, buf, width)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["id", "hashes"])

    return run


def _near_sketches(threshold: int):
    """Pairs whose sketches of equal length are near enough for the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, left, right in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "left", "right")), strict=True):
                far = [int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()) for x in left for y in right if len(x) == len(y)]
                keep.append(bool(far) and min(far) * (100 + threshold) <= (n + m) * (100 - threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs that are similar: first by their sketches, then, for what is left, shingle by shingle."""
    slim = lambda i, n, s: sets.select(F.col("doc_id").alias(i), F.col("n").alias(n), F.col("sketches").alias(s))
    drawn = pairs.distinct().join(slim("a", "n", "left"), "a").join(slim("b", "m", "right"), "b")
    near = written(drawn.select("a", "b", "n", "m", "left", "right").mapInArrow(_near_sketches(threshold), "a long, b long").distinct())
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    text = docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"])
    hashes = written(text.mapInArrow(_shingle_rows(width), "id long, hashes array<long>"))
    left = near.join(hashes.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a")
    both = left.join(hashes.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b")
    common = F.size(F.array_intersect("left", "right")).cast("long")  # native, row by row: whole sets of many pairs would fill a batch
    return both.withColumn("common", common).where(100 * F.col("common") >= threshold * (F.size("left") + F.size("right") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, star_turns: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles and component_id, the least doc_id reachable by links.

    Documents link when their sets of distinct ``width``-word shingles (ASCII lower case; all words where there are
    fewer) have a Jaccard similarity of ``threshold`` hundredths or more. Null, empty and wordless texts have no
    shingles and stand alone. Equal sets are one class, represented by its least id; classes meet on shared chunks.
    Star turns link each key group to one member; the last turn proposes all pairs of still different components that
    the sketches' distance allows, so no link between different components is lost. Repeated rows stay; an empty table
    gives none; other columns are ignored."""
    d = docs.select("doc_id", "text")
    sets = written(d.mapInArrow(_set_rows(width, threshold), "doc_id long, n long, xor long, added long, sketches array<binary>, shared map<int,int>"))
    reps = written(sets.where("n > 0").groupBy("n", "xor", "added").agg(F.min("doc_id").alias("id")))
    keys = d.mapInArrow(_key_rows(width, threshold), "key long, id long").repartition("key").sortWithinPartitions("key", "id")
    shared = written(keys.mapInArrow(_shared_keys, "key long, id long").join(reps.select("id"), "id", "left_semi").select("key", "id"))
    several = written(shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    least = sets.select(F.col("doc_id").alias("id"), "shared").where("n > 0").dropDuplicates(["id"])
    band = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    ranked = shared.join(several, "key").withColumn("band", band).join(least, "id")
    common = W.partitionBy("id", "band").orderBy(F.desc("n"), "key")
    shared = written(ranked.withColumn("place", F.row_number().over(common)).where(F.col("place") >= F.coalesce(F.col("shared")[F.col("band")], F.lit(1))).select("key", "id"))
    links = labels = None

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))

    def unresolved() -> DataFrame:
        open_keys = labelled(shared).groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        return labelled(shared.join(open_keys, "key", "left_semi"))

    for turn in range(star_turns + 1):
        if turn < star_turns:
            rows = labelled(shared) if turn == 0 else unresolved()
            pivot = F.min_by(F.struct("id", "label"), F.xxhash64("id", F.lit(turn)) if turn else F.col("id"))
            pivots = written(rows.groupBy("key").agg(pivot.alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot.id", "pivot.label").toDF("key", "first", "first_label"))
            star = rows.join(pivots, "key").where("label <> first_label")
            pairs = star.select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()
        else:
            rows = written(unresolved().select("key", "id", "label"))
            bits = sets.withColumnRenamed("doc_id", "id").join(rows.select("id").distinct(), "id", "left_semi").select("id", "n", F.explode("sketches").alias("bits"))
            tiles = _in_tiles(rows.join(bits, "id").select("key", "id", "n", "label", "bits")).repartition("key", "width", "tile")
            pairs = tiles.sortWithinPartitions("key", "width", "tile").mapInArrow(_tile_pairs(threshold), "a long, b long")
        new = _verified(pairs, sets, d, width, threshold)
        fresh = written(new)
        if turn and fresh.isEmpty():
            if turn < star_turns:
                continue
            break
        links = fresh if links is None else links.union(fresh)
        labels = written(components(links))
    of_class = reps.select("n", "xor", "added", "id").join(labels, "id", "left").select("n", "xor", "added", F.coalesce("label", "id").alias("component"))
    out = sets.drop("sketches", "shared").join(of_class, ["n", "xor", "added"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with the document of the least doc_id of each near-duplicate group; repeated rows count as copies.

    Texts without words form no groups."""
    found = near_duplicates(docs, width, threshold).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return semi_by_id(docs, found).dropDuplicates(["doc_id", "text"])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, threshold=90)
