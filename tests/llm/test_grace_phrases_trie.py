"""Exact duplicates, phrases and the conversation trie against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from anchora.llm import grace, phrases, trie
from anchora.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# exact duplicates -----------------------------------------------------------------------------------


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda x: (x is not None, x or 0))
        first = ids.index(keep)
        out += [(i, keep, len(ids), k == first, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


ODD = [(1, None), (2, ""), (3, "Ab"), (9, "aB"), (4, "ÄB"), (5, "äb"), (None, "ab"), (None, None), (3, "Ab"), (9, "aB"), (6, "x" * 300_000), (7, "X" * 300_000), (8, "x" * 299_999)]


def test_exact_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"id": F.lit(1), "hash": F.lit("h"), "to": F.lit(0), "bucket": F.lit(2)})
    assert sorted((tuple(r) for r in grace.exact_duplicates(docs).collect()), key=str) == exact(ODD)
    assert grace.exact_duplicates(docs.limit(0)).count() == 0
    kept = grace.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, ""), (9, "aB"), (4, "ÄB"), (5, "äb"), (7, "X" * 300_000), (8, "x" * 299_999)], key=str)


def test_exact_duplicates_through_levels(spark, monkeypatch):
    """Small buckets: hot contents, buckets of many contents and copies that only merging makes smaller."""
    for name, value in (("BUCKET_BYTES", 3000), ("COMBINE_BYTES", 900), ("BITS", 1), ("COPIES", 4)):
        monkeypatch.setattr(grace, name, value)
    rows = [(k, "one text") for k in range(300)] + [(1000 + k, f"text {k % 40}") for k in range(200)] + [(2000 + k, "y" * 2000) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in grace.exact_duplicates(docs).collect()), key=str) == exact(rows)


def test_content_table_compares_contents():
    table = grace.ContentTable(2)
    assert [table.put(7, t) for t in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]  # one hash for all
    assert [table.put(h, b"%d" % h) for h in range(100)] == list(range(3, 103))
    assert [table.put(h, b"%d" % h) for h in range(100)] == list(range(3, 103)) and table.put(7, b"c") == 2


# phrases --------------------------------------------------------------------------------------------


def mined(rows, min_count, percent=80, top=None):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= min_count}
        longest = Counter()
        for g, a in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longest[g[i : i + m]] = max(longest[g[i : i + m]], a)
        found = []
        for g, a in candidates.items():
            if 100 * longest[g] >= percent * a:
                continue
            cuts = [(2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases(spark, monkeypatch):
    for name, value in (("SHARD_WORDS", 150), ("TASK_WORDS", 200), ("PART_BYTES", 40), ("CELL_PAIRS", 100), ("CELL_WORDS", 7)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ä", "new", "york", "a", "x\x00y", "-", "straße", "city"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts] + [("en", "New York City of " * 200), ("en", None), ("fr", ""), ("en", "a a a a a a a a a"), ("de", ".,;"), ("de", "the of")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, n long, words string").repartition(3)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for top in (None, 7):
        found = phrases.mine_phrases(docs, min_count=6, top=top)
        assert sorted(tuple(r) for r in found.select(columns).collect()) == mined(rows, 6, top=top)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0
    assert phrases.mine_phrases(docs.where("lang = 'fr'")).count() == 0


def test_bidirectional_index_lists_every_phrase():
    rng = np.random.default_rng(3)
    for size, words, longest in ((0, 3, 4), (1, 3, 4), (200, 4, 4), (200, 2, 3), (300, 50, 2)):
        text = rng.integers(0, words, size) * 7
        found = {tuple(int(x) for x in w): int(c) for ws, cs in phrases.BidirectionalIndex(text, longest).phrases() for w, c in zip(ws, cs, strict=True)}
        t = text.tolist()
        assert found == Counter(tuple(t[i : i + m]) for m in range(2, longest + 1) for i in range(len(t) - m + 1) if 0 not in t[i : i + m])


# trie -----------------------------------------------------------------------------------------------


def tried(sequences):
    """conv_id -> turns (any hashable with the words of it) to the rows of the query."""
    members, ends, words = defaultdict(list), defaultdict(list), {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            words[tuple(turns[:d])] = turns[d - 1][1] if d else 0
        ends[tuple(turns)].append(c)
    kids = Counter(s[:-1] for s in members if s)
    saved, leaves = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * words[s]
            leaves[s[:d]] += not kids[s]
    sha = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], sha(s)) for s, m in members.items())


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, len(re.findall("[^ \t-\r]+", text))))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(trie, "RUN_IDS", 2)
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "a", None]), rng.choice(["yes", "no no", None, "", "well\tthen so"])) for c in range(1, 90) for t in range(rng.choice([1, 2, 2, 4, 7]))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(5)] + [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (40, 0, "user", "x " * 40_000)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ends": F.lit(1), "key": F.lit("k"), "h": F.lit(5)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie.prefix_trie(trie.shared_heads(trie.conversation_turns(conversations)))
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(tuple(r) for r in found.select(columns).collect()) == tried(rebuilt(rows))
        if chunk == 3:
            assert trie.prefix_trie(trie.shared_heads(trie.conversation_turns(conversations.limit(0)))).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_exact_dedup", "op13_prefix_trie"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    ours = QUERIES[name](spark, SF).select(theirs.columns)
    assert sorted((tuple(r) for r in ours.collect()), key=str) == sorted(theirs.fetchall(), key=str)
