"""Registered queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from anchora.llm.decontaminate import op4_decontamination
from anchora.llm.grace import op12_exact_dedup
from anchora.llm.jaccard import op7_jaccard_join
from anchora.llm.langid import op8_language_id
from anchora.llm.lm import op9_lm_scoring
from anchora.llm.packing import op3_best_fit_packing
from anchora.llm.phrases import op11_phrase_mining
from anchora.llm.quality import op1_quality_classifier
from anchora.llm.rules import BOILERPLATE, op6_quality_rules
from anchora.llm.secrets import op2_secret_scans
from anchora.llm.suffix import op10_suffix_dedup
from anchora.llm.trie import op13_prefix_trie
from anchora.llm.urls import op5_url_filters

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scans": op2_secret_scans,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_decontamination": op4_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

_FAULTS = """(sym > 0 AND spaces + 1 >= 4 AND sym / greatest(length(line) - spaces, 1) > 0.15) OR (bars >= 3 AND bars * 5 > spaces + 1)
  OR (length(line) >= 20 AND upper(line) = line AND lower(line) <> line) OR """ + " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

_RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) x),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) y WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) z GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
judged AS (SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(line) - length(regexp_replace(line, '[ \t]', '', 'g')) AS spaces,
  length(line) - length(regexp_replace(line, '[#*$%&|<>~^=_+{{}}\[\]\\]', '', 'g')) AS sym, length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) AS bars FROM lines),
kept_lines AS (SELECT doc_id, sum(n - 1) AS dups, sum(CASE WHEN {_FAULTS} THEN 0 ELSE solid END) AS solid FROM judged GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(solid, 0) AS solid FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN kept_lines USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars = 0 THEN 0.0 ELSE 1 - solid / word_chars END AS lost FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept, lost FROM f"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) x
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 90 * (a.n + b.n - both_have)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""

_EXACT_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(t) AS text_sha256 FROM d"""

_PHRASE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d) x),
grams AS (SELECT lang, ws[i : i + m - 1] AS g FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) y) z),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g),
n AS (SELECT lang, sum(a) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(g) > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 : len(c.g)]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, g[i : i + m - 1] AS g, max(a) AS longest FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) y WHERE m < len(g)) z GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ USING (lang, g) WHERE longest IS NULL OR 100 * longest < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

_TRIE_SQL = r"""
WITH t AS (SELECT c, g, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS k FROM (SELECT conv_id AS c, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
  left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS g FROM conversations WHERE conv_id IS NOT NULL) x),
codes AS (SELECT DISTINCT c, list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT))) AS bytes FROM t),
crc AS (SELECT c, xor(list_reduce(bytes, lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) AS v FROM codes),
h AS (SELECT crc.c, CAST(v % 4 AS BIGINT) AS h, crc.c - crc.c % 20 AS base FROM crc),
sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
r AS (SELECT h.c, t.k AS d, t.g, t.w FROM h JOIN t ON t.c = h.base AND t.k <= h.h
  UNION ALL SELECT h.c, least(h.h, coalesce(sizes.n, 0)) + t.k - h.h, t.g, t.w FROM h JOIN t ON t.c = h.c AND t.k > h.h LEFT JOIN sizes ON sizes.c = h.base),
cn AS (SELECT c, d, w, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM r UNION ALL SELECT c, 0, 0, '' FROM h),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n, any_value(w) AS w FROM cn GROUP BY d, p),
up AS (SELECT node.*, a.p AS pp FROM node LEFT JOIN cn a ON a.c = node.conv_id AND a.d = node.d - 1),
kids AS (SELECT d - 1 AS d, pp AS p, count(*) AS n_children FROM up WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT a.d, a.p, sum((y.n - 1) * y.w) AS saved, count(*) FILTER (WHERE kids.p IS NULL) AS leaves FROM node y LEFT JOIN kids USING (d, p) JOIN cn a ON a.c = y.conv_id AND a.d <= y.d GROUP BY 1, 2),
ends AS (SELECT d, p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM cn GROUP BY c) x JOIN cn USING (c, d) GROUP BY d, p)
SELECT up.conv_id, up.d AS depth, above.conv_id AS parent_conv_id, up.n AS n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM up JOIN below USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN ends USING (d, p) LEFT JOIN node above ON above.d = up.d - 1 AND above.p = up.pp"""

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": _RULES_SQL, "op7_jaccard_join": _JACCARD_SQL, "op11_phrase_mining": _PHRASE_SQL, "op12_exact_dedup": _EXACT_SQL, "op13_prefix_trie": _TRIE_SQL}
