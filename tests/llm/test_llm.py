"""The dealt operators on small tables, held against plain loops."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anchora.llm import decontaminate, jaccard, langid, lm, packing, quality, rules, secrets, suffix, urls
from anchora.llm.base import Rolling, word_ranges

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null, empty, blank, short, repeated and long texts, a repeated row and null ids.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "É\x0bü\x1cx  y"), (None, "no id here"), (6, "ab " * 5000), (7, "\n".join(["same line here."] * 40))]


def table(spark, rows, **extra):
    """Rows with the columns of documents, and others whose names operators use themselves."""
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    for name in ("score", "row", "n", "label", "words", "spans", "train", "id"):
        d = d.withColumn(name, F.lit("x"))
    return d


def prose(seed, n, words=60, vocabulary=400):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(words // 2, words))) + "." for _ in range(n)]


def test_word_ranges_stop_at_texts():
    buf = np.frombuffer(b"ab cdef", np.uint8)
    start, end, row = word_ranges(buf, np.array([0, 5, 5, 7]))
    assert list(zip(start, end, row, strict=True)) == [(0, 2, 0), (3, 5, 0), (5, 7, 2)]


def test_rules(spark):
    rows = ODD + list(enumerate(prose(1, 40), 100)) + [(200, "a b c d a b c x a b c " * 9), (201, "ONE TWO THREE FOUR FIVE SIX SEVEN. " * 20), (202, "x | y | z | u | v\n" * 30)]
    got = {}
    for r in rules.quality_rules(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        w = WORD.findall(t or "")
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = Counter(wins)
        covered = {k + j for k, x in enumerate(wins) if seen[x] > 1 for j in range(3)}
        full = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(covered))
        assert want in [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got[i]]
    assert all(not r["kept"] for i in (1, 2, 3, 201, 202) for r in got[i])
    assert rules.quality_rules(table(spark, rows).limit(0)).count() == 0


def base_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark):
    key = hashlib.sha256(b"k").hexdigest()
    random_token = "qZ7xK2pV9mLr4TbW8nYc3HdJ6fGs"
    rows = ODD + [(10, f"😀 token: secret: abcdefgh12 Password = '{key}' AKIA{'A1' * 8} x"), (11, f"api_key:short {key[:40]} and {random_token} here"), (12, "plainidentifierwithoutdigits 20240101-1234567890123 ordinary words only")]
    rows += list(enumerate(prose(2, 60), 100))
    samples = secrets.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    found = secrets.scan_secrets(table(spark, rows), samples).select("doc_id", secrets.span_text("base").alias("base"), secrets.span_text("spans").alias("spans")).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add(r["base"])
    for i, t in rows:
        assert base_spans(t or "") in by[i]
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert "markov" in spans[11] and "markov" not in spans[12] and all("markov" not in spans[k] for k in range(100, 160))
    masked = {r["doc_id"]: r for r in secrets.redact_secrets(table(spark, rows)).collect()}
    assert key[:40] not in masked[11]["text"] and key not in masked[10]["text"] and masked[10]["n_chars"] == len(masked[10]["text"])
    assert masked[1]["text"] is None and masked[12]["text"] == rows[len(ODD) + 2][1]


def test_secrets_without_digits_beside_base_spans_and_in_paths(spark):
    letters, mixed = "qZxKVpmLrTbWYcHdJfGsXwQz", "qZ7xK2pV9mLr4TbW8nYc"
    rows = [(1, f"see {letters} here"), (2, f"AKIA{'A1' * 8}/{mixed} x"), (3, f"at /organisation/repository/settings/{mixed} x"), (4, "at /organisation/repository/settings/ordinary-words-only x")]
    samples = secrets.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    found = secrets.scan_secrets(table(spark, rows), samples).collect()
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "markov"] for r in found}
    assert len(got[1]) == len(got[2]) == len(got[3]) == 1 and got[4] == []
    assert letters in got[1][0] and mixed in got[2][0] and mixed in got[3][0]


def test_secrets_in_a_table_of_few_words(spark):
    """A key of each alphabet is found in a table of ten lines, without samples handed in, and ordinary identifiers are not."""
    rnd = random.Random(8)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"]
    keys = ["".join(rnd.choice(a) for _ in range(30)) for a in alphabets]
    plain = ["userAccountRepositoryFactory", "/home/settings/configuration-2024-01-15", "requestResponseHandler_v2", "123456789012345678"]
    rows = [(k, f"see {x} in line {k}") for k, x in enumerate(keys + plain)]
    found = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"]] for r in secrets.scan_secrets(table(spark, rows)).collect()}
    assert [found[k] for k in range(len(keys))] == [[x] for x in keys] and not any(found[k] for k in range(len(keys), len(rows)))


def test_secrets_on_held_out_samples(spark):
    samples = secrets.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    assert samples.groupBy("held_out").agg(F.countDistinct("label").alias("n")).where("n = 2").count() == 2
    table_ = secrets.markov_table(samples.where("not held_out"))
    r = secrets.rates(samples.where("held_out"), table_, 0.5).first()
    assert r["tp"] / (r["tp"] + r["fp"]) > 0.97 and r["tp"] / (r["tp"] + r["fn"]) > 0.97, r
    pairs = Counter(p for s in samples.where("not held_out and token rlike '[A-Z]' and token rlike '[a-z]'").collect() for p in ((s["label"], a, b) for a, b in zip(s["token"], s["token"][1:], strict=False)))
    place = {c: k for k, c in enumerate(secrets.ALPHABET)}
    rows = [Counter(), Counter()]
    for (label, a, b), n in pairs.items():
        rows[label][place.get(a, secrets.WIDTH - 1), place.get(b, secrets.WIDTH - 1)] += n
    for a, b in (("q", "Z"), ("t", "h"), ("9", "a"), ("_", "v"), ("A", "K")):
        odds = [(rows[k][place[a], place[b]] + 0.1) / (sum(n for (x, _), n in rows[k].items() if x == place[a]) + 0.1 * secrets.WIDTH) for k in (0, 1)]
        assert abs(table_[place[a] * secrets.WIDTH + place[b]] - np.log(odds[1] / odds[0])) < 1e-9


@pytest.mark.parametrize("block", [2, 64])
def test_secrets_replace_and_lay_out_many_matches(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "BLOCK", block)
    rnd = random.Random(3)
    text = "".join(rnd.choice("aé😀 xyz") for _ in range(400))
    spans = sorted((a, rnd.randint(0, 3), a + rnd.randint(1, 25)) for a in (rnd.randint(0, 370) for _ in range(23)))
    gone, want, until = bytearray(len(text)), [], 0
    for a, _, b in spans:
        want += [text[until : max(a, until)]] + (["[SECRET]"] if a >= until and b > until else [])
        until = max(until, b)
        gone[a:b] = b"\1" * (b - a)
    rows = spark.createDataFrame([(text, [(a, r, "hex", b, "v") for a, r, b in spans])], "text string, spans array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    got = rows.select(secrets.redacted(F.col("text"), F.col("spans")), secrets._blanked(F.col("text"), F.col("spans"))).first()
    assert got[0] == "".join(want) + text[until:] and got[1] == "".join(" " if g else c for c, g in zip(text, gone, strict=True))
    many = " ".join(f"{'é' * rnd.randint(0, 3)}{rnd.getrandbits(160):040x}" for _ in range(9))
    spans = spark.range(1).select(secrets.spans_of(F.lit(many), secrets.HEX, "hex").alias("s")).first()["s"]
    assert [(x["start"], x["end"], x["value"]) for x in spans] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9a-f]{32,}", many)]


def test_secrets_take_time_in_proportion_to_matches(spark):
    import time

    texts = [" ".join(f"{k:x} {hashlib.sha1(str(k).encode()).hexdigest()}" for k in range(n)) for n in (200, 20_000)]
    samples = secrets.labelled_samples(table(spark, [(1, texts[0])]))
    scan = lambda t: len(secrets.scan_secrets(table(spark, [(1, t)]), samples).select("base", secrets.redacted(F.col("text"), F.col("spans")).alias("r")).first()["base"])
    assert scan(texts[0]) == 200
    begun = time.time()
    assert scan(texts[1]) == 20_000
    assert time.time() - begun < 40


@pytest.mark.parametrize("limit", [16, 2048])
def test_packing(spark, limit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = [r for r in ODD if r[0]] + list(enumerate(prose(3, 80), 100)) + [(300, "it's DON'T x.y, (a);b!? Straße İz ǅ é <|endoftext|> 12ab…")]
    out = packing.pack_documents(table(spark, rows), limit=limit).toPandas()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    for r in out.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    total = sum(len(ids[i]) for i, _ in rows)
    assert out["length"].sum() == total
    by = out.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id")["length"].cumsum() - by["length"] == by["offset"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= limit
    assert out["sequence_id"].nunique() <= 1.1 * -(-total // limit) + 1


def brute_matches(size, is_gap):
    waiting, pairs = [], []
    for k in range(len(size)):
        if not is_gap[k]:
            waiting.append(k)
        elif waiting:
            pairs.append((waiting.pop(), k))
    return pairs


def test_sweep_equals_serial_sweep_in_one_range_and_in_many():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 60, 300):
        size, is_gap = rng.integers(1, 30, n), rng.random(n) < 0.5
        order = np.lexsort((is_gap, size))
        size, is_gap = size[order], is_gap[order]
        want = brute_matches(size, is_gap)
        assert sorted(zip(*packing.matched(size, is_gap), strict=True)) == sorted(want)
        bounds = [0, *sorted(rng.integers(0, n + 1, 4)), n]
        pairs, open_ = [], {}
        for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            doc, gap = packing.matched(size[a:b], is_gap[a:b])
            pairs += list(zip((doc + a).tolist(), (gap + a).tolist(), strict=True))
            rest = sorted(set(range(a, b)) - {*(doc + a).tolist(), *(gap + a).tolist()})
            open_[part] = [k for k in rest if not is_gap[k]], [k for k in rest if is_gap[k]]
        for of, high, at, low, count in packing.carried([(p, len(d), len(g)) for p, (d, g) in open_.items()]):
            pairs += [(open_[of][0][high - i], open_[at][1][low + i]) for i in range(count)]
        assert sorted(pairs) == sorted(want)


def test_packing_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 150)
    rnd = random.Random(5)
    lengths = [17] * 300 + [rnd.randint(1, 64) for _ in range(500)]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    out = packing.pack(rows, 64).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(out["doc_id"]) == list(range(len(lengths)))
    assert (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all()
    assert out.groupby("sequence_id")["length"].sum().max() <= 64
    gaps: list[int] = []  # a serial best fit, the longest first
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((64 if fit is None else fit) - n)
    assert out["sequence_id"].nunique() <= 1.03 * len(gaps) + 1


@pytest.mark.parametrize("mix", ["empty", "grains", "all"])
def test_small_pieces_go_many_at_once(spark, monkeypatch, mix):
    """Tables written follow the logarithm of the pieces, and sequences stay near those of a serial best fit."""
    tables, write = [], packing.written
    monkeypatch.setattr(packing, "written", lambda d: tables.append(1) or write(d))
    monkeypatch.setattr(packing, "LINE", 5000)
    rnd = random.Random(1)
    sizes = {"empty": [1] * 10_000, "grains": [rnd.randint(1, 128) for _ in range(4000)], "all": [rnd.choice([rnd.randint(1, 60), rnd.randint(60, 500), rnd.randint(500, 2048)]) for _ in range(1500)]}[mix]
    out = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(3), 2048).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(out["doc_id"]) == list(range(len(sizes)))
    assert (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all() and out.groupby("sequence_id")["length"].sum().max() <= 2048
    gaps: list[int] = []
    for n in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((2048 if fit is None else fit) - n)
    assert out["sequence_id"].nunique() <= 1.02 * len(gaps) + 1
    assert len(tables) <= {"empty": 16, "grains": 36, "all": 60}[mix]


def test_word_parts():
    text = "Don't ÀB,c12; straße×a ſx é"
    buf = np.frombuffer(text.encode(), np.uint8)
    solid, bounds, row, letters = packing.word_parts(np.array([0, len(buf)]), buf)
    assert [bytes(solid[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == ["don't", "àb", ",", "c", "1", "2", ";", "straße×a", "ſx", "é"]
    assert set(row.tolist()) == {0} and letters.tolist() == [False, True, False, True, False, False, False, False, False, True]


def test_decontamination(spark):
    items = prose(7, 12, 40)
    rnd = random.Random(8)
    some = items[3].split()
    for k in range(4, len(some), 9):
        some[k] = "changed"
    rows = ODD + list(enumerate(prose(9, 30), 100)) + [(200, "before " + items[5] + " after"), (201, "x y " + " ".join(some) + " z"), (202, prose(9, 1)[0] + " tiny item text " + "z")]
    bench = spark.createDataFrame([*enumerate(items), (50, "tiny item text"), (51, None), (52, "")], "item_id long, text string").withColumn("doc_id", F.lit(rnd.random()))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(table(spark, rows), bench).collect()}
    assert got == {(200, 5), (201, 3), (202, 50)}
    assert decontaminate.decontaminate(table(spark, rows), bench).count() == len(rows) - 3
    assert decontaminate.find_overlaps(table(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_masks_hit_every_pattern():
    for width in range(1, 21):
        replaced = max(k for k in range(width) if (width - k) / width >= 0.8)
        masks = [int(m, 2) << at for m in decontaminate.masks_for(width, 0.8) for at in range(width - len(m) + 1)]
        for gone in itertools.combinations(range(width), replaced):
            holes = sum(1 << k for k in gone)
            assert any(not m & holes for m in masks), (width, gone)


def test_decontamination_finds_replaced_words_of_any_width(spark):
    widths = [5, 9, 10, 14, 15, 16, 19, 20, 30]
    items = [(w, " ".join(f"w{w}x{k}" for k in range(w))) for w in widths]
    rnd, rows, want = random.Random(18), [], set()
    for w, text in items:
        n = min(w, 20)
        for t in range(40):
            some, at = text.split(), rnd.randint(0, w - n)
            some[:at], some[at + n :] = ["other"] * at, ["other"] * (w - at - n)
            for k in rnd.sample(range(at, at + n), n // 5 + t % 2):
                some[k] = "changed"
            rows.append((1000 * w + t, "before it " + " ".join(some) + " after it"))
            want |= set() if t % 2 else {(1000 * w + t, w)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(table(spark, rows), bench).collect()}
    assert got == want


def test_decontamination_equals_all_pairs(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30)))) for k in range(12)] + [(50, "same same same same same same"), (51, None), (52, "...")]
    docs = [(None, items[0][1]), (1, None), (2, ""), (3, "same " * 40)]
    for k in range(60):
        part = (items[rnd.randint(0, 11)][1]).split()
        part = [rnd.choice(words) if rnd.random() < 0.15 else w for w in part][rnd.randint(0, 4) :]
        docs.append((100 + k, " ".join([*(rnd.choice(words) for _ in range(rnd.randint(0, 15))), *part, *(rnd.choice(words) for _ in range(rnd.randint(0, 5)))])))
    docs += [docs[-1], docs[5]]
    want = {}
    for d, text in docs:
        doc = (text or "").lower().split()
        for i, item in items:
            it = re.findall(r"\w+", item or "")
            width = min(len(it), 20)
            best = 0
            for shift in range(-len(it), len(doc)) if it else ():
                equal = [0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(it)]
                best = max(best, max(sum(equal[s : s + width]) for s in range(len(it) - width + 1)))
            if it and best / width >= 0.8:
                want[d, i] = max(want.get((d, i), 0), best)
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.find_overlaps(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 20


def test_urls(spark):
    pages = [(1, None, None), (2, "no scheme", ""), (3, "http://Sub.Example.com/en/x?q", ""), (4, "http://www.example.com/en/x", ""), (5, "http://a.net/es/1", ""), (6, "http://a.net/de/1", ""), (7, "http://com", ""), (8, "http://b.org/x", '<a href="http://a.net/de/2">'), (8, "http://b.org/x", "")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("y"))
    r = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge_urls(d, r).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("sub.example.com", "/en/x", "example.com/en/", "block") and got[4][2:] == ("www.example.com/en/", "allow")
    assert got[5][2:] == ("net/es/", "block") and got[6] == ("a.net", "/de/1", None, "block") and got[7] == ("com", "", None, "allow")
    assert got[8][3] == "block"  # it links to a host with blocked pages
    assert urls.judge_urls(d.limit(0), r).count() == 0


def test_host_edges(spark):
    html = """<a href="/x">1</a> <a HREF='y.html'> <a href=//b.org/z> <a href="https://C.org:80/?q"> <a href="mailto:me@d.org"> <a href="#top"> <link href="http://a.net">"""
    pages = spark.createDataFrame([("http://A.net/p", html), ("http://a.net/q", None), (None, html)], "url string, html string")
    got = {(r["src"], r["dst"]): r["weight"] for r in urls.host_edges(pages).collect()}
    assert got == {("a.net", "a.net"): 3.0, ("a.net", "b.org"): 1.0, ("a.net", "c.org:80"): 1.0}


def test_propagation_equals_matrix(spark):
    rnd = random.Random(4)
    names = "abcdefg"  # g has no edge out and none in
    e = [(x, y, float(rnd.randint(1, 3))) for x in names[:-1] for y in names[:-1] if x != "f" and rnd.random() < 0.4]
    seeds = [("a", 2.0, 0.0), ("b", 1.0, 1.0), ("g", 1.0, 0.0)]
    out = urls.propagate(spark.createDataFrame(e, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), tolerance=1e-9).collect()
    m = np.zeros((7, 7))
    for x, y, w in e:
        m[names.index(x), names.index(y)] = w
    for kind, links, start in (("trust", m, [0.5, 0.25, 0, 0, 0, 0, 0.25]), ("distrust", m.T, [0, 1.0, 0, 0, 0, 0, 0])):
        start = np.array(start)
        sums = links.sum(axis=1, keepdims=True)
        p = np.where(sums > 0, links / np.where(sums > 0, sums, 1), start)  # a walk without a way on returns to the seeds
        p = 0.85 * p + 0.15 * start
        want = np.linalg.solve(np.vstack([(p.T - np.eye(7))[:-1], np.ones(7)]), np.array([0, 0, 0, 0, 0, 0, 1.0]))
        got = {r["host"]: r[kind] for r in out}
        assert all(abs(got.get(x, 0) - want[k]) < 1e-7 for k, x in enumerate(names)) and abs(sum(got.values()) - 1) < 1e-9
    with pytest.raises(RuntimeError):
        urls.propagate(spark.createDataFrame(e, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), tolerance=1e-9, most_rounds=2)


def shingle_sets(rows, width):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


@pytest.mark.parametrize(("width", "threshold"), [(3, 90), (5, 80)])
def test_jaccard(spark, width, threshold):
    rnd = random.Random(6)
    rows = [r for r in ODD if r[0]]
    for g, base in enumerate(prose(11, 8, 120)):
        for c in range(14):
            w = base.split()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 5)}"
            rows.append((1000 + 100 * g + c, " ".join(w)))
    rows += [(5000 + k, "two words" if k % 2 else "a b c d e f g") for k in range(4)]
    sets = shingle_sets(rows, width)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= threshold * (len(x) + len(y) - both):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table(spark, rows), width, threshold).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets}
    kept = jaccard.keep_one_of_each(table(spark, rows), width, threshold).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted({root(i) for i, _ in rows})


@pytest.mark.parametrize("tile", [2, 1024])
def test_jaccard_tiles_alone_are_whole(spark, monkeypatch, tile):
    """Without star turns every link comes from the tiles; common boilerplate makes hot keys between unlike documents."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    stock = " ".join(prose(77, 1, 60))
    rows = [(k, stock + " " + t) for k, t in enumerate(prose(12, 9, 70))]
    rows += [(100 + k, t.replace(" ", "  ", 3) + (" more" if k % 2 else "")) for k, (_, t) in enumerate(rows)]
    rows += [(200 + k, f"{t} then more of it {k}") for k, (_, t) in enumerate(rows[:9])]
    sets = shingle_sets(rows, 3)
    alone = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table(spark, rows), 3, 80, star_turns=0).collect()}
    parent = {i: i for i, _ in rows}
    for _ in range(4):
        for i, x in sets:
            for j, y in sets:
                if 100 * len(x & y) >= 80 * len(x | y):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert alone == parent and len(set(alone.values())) == 9
    assert jaccard.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_shared_keys_over_batches():
    rng = random.Random(2)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 5)) for _ in range(60))
    by = {}
    for k, i in rows:
        by.setdefault(k, set()).add(i)
    want = sorted((k, i) for k, ids in by.items() if len(ids) > 1 for i in ids)
    for size in (1, 2, 3, 7, 100):
        batches = [pa.record_batch([pa.array([r[c] for r in rows[a : a + size]], pa.int64()) for c in (0, 1)], ["key", "id"]) for a in range(0, len(rows), size)]
        got = [r for b in jaccard._shared_keys(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(got) == want


def test_jaccard_similar_sets_share_the_keys_promised():
    """Similar sets share a key among those left when each leaves out its most common ones, whatever is common."""
    rng = np.random.default_rng(9)
    tops = np.array(jaccard.band_tops(80))
    for trial in range(300):
        n = int(rng.integers(2, 200))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = x.copy()
        while True:
            z = np.unique(np.concatenate([y[rng.random(len(y)) > 0.04], rng.integers(0, 1 << 62, int(rng.integers(0, 3))).astype(np.uint64)]))
            both = len(np.intersect1d(x, z))
            if 100 * both < 80 * (len(x) + len(z) - both):
                break
            y = z
            if rng.random() < 0.3:
                break
        common = {}
        ok = False
        for band, _, keys, least in jaccard._bands(x, tops, 80):
            for other, _, keys2, least2 in jaccard._bands(y, tops, 80):
                if band == other:
                    for k in (*keys.tolist(), *keys2.tolist()):
                        common.setdefault(k, rng.random())
                    left = [set(sorted(ks.tolist(), key=lambda k: common[k])[few - 1 :]) for ks, few in ((keys, least), (keys2, least2))]
                    ok = ok or bool(left[0] & left[1])
        assert ok, trial


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train, test = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0 and n_chars > 100")
    out = langid.identify_language(test, train).select("lang", "lang_pred", "score").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.9 and out["score"].between(0, 1).all()
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(table(spark, ODD), train).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[6] != "und"
    kept = langid.keep_known_languages(table(spark, ODD), train)
    assert kept.columns == table(spark, ODD).columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert langid.identify_language(docs.limit(0), docs.limit(0)).count() == 0


def test_language_distance_by_hand():
    offsets, buf = np.array([0, 5]), np.frombuffer(b"ab ab", np.uint8)
    keys, n = langid._grams(offsets, buf, np.array([0]))
    grams = {int(k): int(c) for k, c in zip(keys, n, strict=True)}
    text = "ab ab"
    want = Counter(int.from_bytes(text[k : k + m].encode(), "big") for m in (1, 2, 3) for k in range(len(text) - m + 1) if not (m == 1 and text[k] == " "))
    assert grams == dict(want)


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_BYTES", 3000)
    rnd = random.Random(13)
    phrases = [" ".join(p.split()[:4]) for p in prose(13, 25, 20)]
    rows = ODD + [(100 + k, " ".join(rnd.choice(phrases) for _ in range(15))) for k in range(60)]
    d = table(spark, rows).withColumn("train", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)))
    out = lm.score_documents(d).collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    counts = Counter(x for i, t in rows if i is None or i % 3 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for _, t in rows)
    assert Counter((r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    long = [r for r in out if r["n_tokens"] > 20]
    assert sum(r["score"] for r in long) > sum(r["base_score"] for r in long)
    assert lm.score_documents(d.limit(0)).count() == 0


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    """Weights from all held-out tokens under the estimation part's counts; scores from the counts of both."""
    monkeypatch.setattr(lm, "BATCH_BYTES", 500)
    monkeypatch.setattr(lm, "HELD_OUT", 3)
    seen, learn = [], lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda rows, v: seen.append((dict(rows), v, learn(rows, v))) or seen[-1][2])
    rnd = random.Random(19)
    words = [p.split()[0].lower() for p in prose(19, 12, 3)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for k in range(60)]
    d = table(spark, rows).withColumn("train", F.col("doc_id") % 4 != 0)
    held = {r[0] for r in d.where(F.pmod(F.xxhash64("text", F.lit("held out")), F.lit(3)) == 0).select("doc_id").collect()}
    out = {r["doc_id"]: r["score"] for r in lm.score_documents(d).collect()}
    tokens = {i: [*t.split(), None] for i, t in rows}

    def model(ids):
        c1 = Counter(x for i in ids for x in tokens[i])
        c2 = Counter(p for i in ids for p in zip(["start", *tokens[i]], tokens[i], strict=False))
        n, v, docs = sum(c1.values()), len(c1), len(ids)

        def parts(i):
            for k, x in enumerate(tokens[i]):
                before = tokens[i][k - 1] if k else "start"
                c = docs if before == "start" else c1[before]
                yield (1 + int(np.log2(c)) if c else 0), (c2[before, x] / c if c else 0.0), c1[x] / n, 1 / (v + 1)

        return parts

    train = [i for i, _ in rows if i % 4]
    first = model([i for i in train if i not in held])
    grid = lambda p: 1 + round(-lm.STEPS * float(np.log2(p))) if p else 0
    want = Counter((b << 20) | (grid(p2) << 10) | grid(p1) for i in train if i in held for b, p2, p1, _ in first(i))
    assert seen[0][0] == dict(want) and sum(want.values()) == sum(len(tokens[i]) for i in train if i in held)
    w, both = seen[0][2], model(train)
    for i, _ in rows:
        assert abs(out[i] - sum(np.log10(w[b] @ [p2, p1, p0]) for b, p2, p1, p0 in both(i))) < 1e-6


def test_lm_counts_round_trip():
    for counts in ([], [0, 1, 254, 255, 256, 1 << 31, 3], [300] * 5):
        assert lm._unpacked(lm._packed(np.array(counts, np.uint32))).tolist() == counts


def test_lm_grams_round_trip():
    rng = np.random.default_rng(2)
    top = (1 << 64) - 1
    for grams in ([7], [0, 1], [0, top], [5, 5 + 255, 5 + 511, top - 1, top], sorted(set(rng.integers(0, top, 5000, np.uint64).tolist()))):
        assert lm._grams_of(lm._bytes_of(np.array(grams, np.uint64))).tolist() == grams
    assert len(lm._bytes_of(np.unique(rng.integers(0, 1 << 62, 400_000, np.uint64)))) < 6.1 * 400_000


def test_lm_packed_rows_follow_the_input():
    rows = [(b // lm.part_bytes(b)) ** 2 / b for b in (8 << 30, 64 << 30, 240 << 30)]
    assert max(rows) < 1.2 * min(rows) and lm.part_bytes(1 << 30) == lm.BATCH_BYTES and lm.part_bytes(1 << 50) == lm.MOST_BYTES


def test_lm_weights_move_to_what_predicts():
    key = lambda b, p2, p1: (b << 20) | ((1 - lm.STEPS * p2) << 10) | (1 - lm.STEPS * p1)
    w = lm.learn_weights([(key(9, -1, -10), 1000), (key(2, -12, -3), 1000)], 10**6)
    assert w[9, 0] > 0.9 and w[2, 1] > 0.9 and np.allclose(w.sum(axis=1), 1)


def removed(rows, length):
    seen = Counter(x[k : k + length] for x in ((t or "").encode() for _, t in rows) for k in range(len(x) - length + 1))
    for i, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield i, x, gone


@pytest.mark.parametrize("bucket_rows, pairs", [(3, 4), (1000, 8), (1000, 2)])
def test_suffix(spark, monkeypatch, bucket_rows, pairs):
    monkeypatch.setattr(suffix, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(suffix, "PAIRS", pairs)
    rnd = random.Random(14)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(20, 120))) for _ in range(12)]
    rows = [r for r in ODD if r[0]] + [(100 + i, "".join(rnd.choice(base)[rnd.randint(0, 30) : rnd.randint(30, 120)] for _ in range(rnd.randint(0, 7)))) for i in range(150)]
    rows += [(300, "x" * 95), (301, "y" + "x" * 41), (302, "x" * 40), (303, base[0] + "ab" * 50 + base[1]), (304, "ab" * 21), (305, "abc" * 60 + base[2]), (306, "\0" * 44 + base[3]), (307, "bcabc" + base[2])]
    length = 40
    want = Counter()
    for i, x, gone in removed(rows, length):
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffix.remove_repeats(table(spark, rows), length, 10).collect())
    assert got == want
    assert suffix.remove_repeats(table(spark, rows).limit(0), length, 10).count() == 0


def test_multikey_sort_equals_sorting_bytes():
    rng = random.Random(6)
    for trial in range(30):
        parts = [bytes(rng.choice(b"\0ab\xff") for _ in range(rng.randint(0, 12))) for _ in range(4)]
        strings = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [bytes(7 * [255]), bytes(8 * [255]), b"\0", b"", b"long" * 100 + b"a", b"long" * 100 + b"b"]
        group = np.array([rng.randint(0, 3) for _ in strings])
        size = np.array([len(x) for x in strings])
        start = np.cumsum(size) - size
        order, common = suffix.Strings(np.frombuffer(b"".join(strings), np.uint8)).multikey_sorted(start, size, group)
        assert [(group[k], strings[k]) for k in order] == sorted((g, x) for g, x in zip(group, strings, strict=True))
        for n in range(len(order)):
            a, b = order[n - 1], order[n]
            want = -1 if n == 0 or group[a] != group[b] else len(os.path.commonprefix([strings[a], strings[b]]))
            assert common[n] == want, (trial, n)


def test_periodic_texts_need_few_suffixes():
    for unit in (b"a", b"ab", b"abcde"):
        text = np.frombuffer(b"start of it " + unit * 40_000 + b" and its end", np.uint8)
        kind, _, _, low, high = suffix.sampled_suffixes(text, 400, 80)
        assert (kind == 1).sum() < 700
        covered = np.zeros(len(text), bool)
        for k, a, b in zip(kind, low, high, strict=True):
            if k < 2:
                covered[a : b + 1] = True
        assert covered[: len(text) - 399].all()


def test_quality(spark):
    good, bad = prose(15, 80), [" ".join(w + "###" for w in t.split()) for t in prose(16, 80)]
    rows = list(enumerate(good)) + list(enumerate(bad, 100)) + [(500, None), (501, ""), (502, good[0])]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i % 3 and i < 200] + [(900, 1), (1, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.score_quality(table(spark, rows), labels).collect()}
    held = [r for i, r in out.items() if i % 3 == 0 and i < 200]
    assert np.mean([(r["doc_id"] < 100) == bool(r["predicted"]) for r in held]) > 0.95
    assert 0 <= out[500]["score"] == out[501]["score"] <= 1
    none = quality.score_quality(table(spark, rows), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality.score_quality(table(spark, rows).limit(0), labels).count() == 0


def test_word_vectors_and_pooling_equal_brute_force(spark):
    rows = list(enumerate(prose(23, 9, 12))) + [(50, None), (51, "a  A. 1"), (52, "x")]
    got = quality.word_vectors(table(spark, rows).repartition(3))
    places, signs = quality._index_vectors()
    index = np.zeros((quality.BUCKETS, quality.WIDTH))
    for b in range(quality.BUCKETS):
        for k in range(quality.NONZERO):
            index[b, places[b, k]] += signs[b, k]

    def buckets(text):
        out = []
        for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\u0080-\U0010ffff\s]+", text or ""):
            word = m.group().translate(LOWER).encode()
            out.append((int(Rolling(np.frombuffer(word, np.uint8)).of(np.array([0]), np.array([len(word)]))[0] % np.uint64(quality.BUCKETS)), m.group()))
        return out

    sums, seen = np.zeros((quality.BUCKETS, quality.WIDTH)), np.zeros(quality.BUCKETS)
    for _, text in rows:
        b = [x for x, _ in buckets(text)]
        for k, x in enumerate(b):
            seen[x] += 1
            for step in range(1, quality.WINDOW + 1):
                for other in (k - step, k + step):
                    if 0 <= other < len(b):
                        sums[x] += index[b[other]]
    want = sums / np.maximum(seen[:, None], 1)
    want -= (want * seen[:, None]).sum(axis=0) / seen.sum()
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    weight = 1e-3 / (1e-3 + seen / seen.sum())
    known = seen > 0
    assert np.allclose(got[known, :-1], want[known], atol=1e-5) and np.allclose(got[:, -1], weight, atol=1e-6)
    text = rows[0][1]
    buf = np.frombuffer(text.encode(), np.uint8)
    pooled = quality._features(got, np.array([0, len(buf)]), buf)[0]
    each = np.array([want[x] * weight[x] for x, _ in buckets(text)])
    assert np.allclose(pooled[: quality.WIDTH], each.mean(axis=0), atol=1e-4)
    assert np.allclose(pooled[quality.WIDTH : 2 * quality.WIDTH], each.std(axis=0), atol=1e-4)


def test_language_choice_equals_brute_force(spark):
    """Profiles, distances and choice by plain loops over UTF-8 n-grams."""
    rnd = random.Random(31)
    alphabets = {"aa": "abcdeé", "bb": "defghü", "cc": "aehiou"}
    docs = [(k, " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(3, 20))), lang) for k, lang in enumerate(list(alphabets) * 8)]
    size = 40

    def top(texts):
        n = Counter()
        for t in texts:
            raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in t.lower().encode())
            raw = re.sub(rb" +", b" ", raw)
            for m in (1, 2, 3):
                n.update(raw[k : k + m] for k in range(len(raw) - m + 1) if raw[k : k + m] != b" ")
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], int.from_bytes(x[0], "big")))][:size]

    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    profiles = langid.train_profiles(d, size)
    want = {lang: top([t for _, t, x in docs if x == lang]) for lang in alphabets}
    assert profiles == {lang: [int.from_bytes(g, "big") for g in grams] for lang, grams in want.items()}
    got = {r["doc_id"]: r["p"] for r in d.select("doc_id", langid.predict_language(F.col("text"), profiles, size).alias("p")).collect()}
    for k, t, _ in docs:
        mine = top([t])
        far = {lang: sum(abs(want[lang].index(g) - r) if g in want[lang] else size for r, g in enumerate(mine)) for lang in want}
        best = min(sorted(far), key=lambda x: far[x])
        assert got[k]["lang"] == best and abs(got[k]["score"] - (1 - far[best] / (len(mine) * size))) < 1e-9


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_on_empty_and_odd_tables(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"row": F.lit("r"), "label": F.lit(1), "n": F.lit(2), "key": F.lit("k"), "band": F.lit("b"), "part": F.lit("p"), "id": F.lit("i")})
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    some = stage(spark, docs.limit(40).union(docs.limit(2)), "/root/testdata/sf0.001")
    assert some.count() > 0 and (name == "best-fit packing" or some.columns == docs.columns)


def test_pipeline_stages_keep_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    now = docs.union(odd).union(docs.where("doc_id = 1"))
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "best-fit packing":
            assert after.columns == docs.columns
        sizes.append(after.count())
        now = after
    assert sizes[0] == 201 and sizes[1] < sizes[0] and sizes[2] <= sizes[1] == sizes[1] and sizes[3] == sizes[2]


def test_counts_are_sent_in_few_bits():
    from anchora.llm import lm

    counts = np.random.default_rng(1).choice(np.array([0, 1, 2, 3, 300, 70_000], np.uint32), 50_000, p=[0.4, 0.4, 0.1, 0.09, 0.009, 0.001])
    data = lm._packed(counts)
    assert np.array_equal(lm._unpacked(data), counts) and len(data) < len(counts) / 2
    assert len(lm._unpacked(lm._packed(counts[:0]))) == 0


def test_jaccard_hashes_a_batch_in_small_parts():
    """The working memory of a task follows the part, not the batch."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{k}x{i}" for i in range(800)) for k in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert batch.nbytes > 3 << 20
    tracemalloc.start()
    for _ in jaccard._shingle_rows(5)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
