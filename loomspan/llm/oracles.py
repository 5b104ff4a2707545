"""DuckDB SQL of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import decontam, hostrules, urlrep

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, ws[k : k + least(10, len(ws)) - 1] AS g FROM iw, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS r(k) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (SELECT doc_id, k, n, ws[k : k + n - 1] AS g FROM w, lengths, unnest(range(1, len(ws) - n + 2)) AS r(k)),
hits AS (SELECT DISTINCT doc_id, k, n, item FROM places JOIN windows USING (g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS r(p) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY 1),
places1 AS (SELECT doc_id, k AS p, ws[k] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(k)),
often AS (SELECT word, count(*) AS c FROM places1 GROUP BY 1),
ranked AS (SELECT item, g, g[o] AS word, row_number() OVER (PARTITION BY item, g ORDER BY coalesce(c, 0), o) AS r FROM windows, unnest(range(1, len(g) + 1)) AS r(o) LEFT JOIN often ON word = g[o]),
near AS (SELECT DISTINCT doc_id, item FROM (SELECT * FROM ranked WHERE r = 1) JOIN places1 USING (word) JOIN w USING (doc_id) WHERE list_has_all(ws[greatest(1, p - {reach}) : p + {reach}], g)),
others AS (SELECT doc_id, count(*) AS n_near_items FROM (SELECT doc_id, item FROM near EXCEPT SELECT doc_id, item FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN others USING (doc_id)
""".format(letters=LETTERS, reach=decontam.REACH)

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS r(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN pairs ON y = a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) m ON m.x = d.doc_id
"""

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
places AS (SELECT doc_id, k, array_to_string(ws[k : k + 34], ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) AS r(k)),
twice AS (SELECT g FROM places GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, k FROM places JOIN twice USING (g)), unnest(range(k, k + 35)) AS r(p) GROUP BY 1),
kept AS (SELECT w.doc_id, ws, CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p))), lambda p: ws[p]) END AS ks FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(ks) AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""

HOST_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
places AS (SELECT doc_id, k, array_to_string(ws[k : k + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(k)),
twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM places) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(k, k + 5)) AS r(p) GROUP BY 1),
counts AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM w LEFT JOIN again USING (doc_id)),
judged AS (SELECT *, n_words < {hostrules.LEAST_WORDS} OR 100 * n_repeat_words > {hostrules.MOST_REPEATED} * n_words AS base_failed,
  100 * n_symbols > {hostrules.MOST_SYMBOLS} * word_chars OR 100 * n_dup_lines > {hostrules.MOST_DUPLICATE_LINES} * n_lines AS soft FROM counts),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS f FROM judged GROUP BY 1),
m AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1 / n) AS i FROM hosts),
k AS (SELECT m, greatest(2.0, least(1e4, m * (1 - m) / greatest(v - m * (1 - m) * i, 1e-6) - 1)) AS k FROM m),
rated AS (SELECT source, (f + m * k) / (n + k) AS r, n + k AS nk FROM hosts, k),
verdicts AS (SELECT source, r - {hostrules.Z} * sqrt(r * (1 - r) / (nk + 1)) <= {hostrules.LIMIT} AS ok FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


def _rules() -> tuple[str, str]:
    """CASE expressions of the longest rule that fits, and of its verdict."""
    cases = []
    for what, host, path in sorted(urlrep.RULES, key=lambda r: -len(r[1] + r[2])):
        test = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases.append((test, host + path, what))
    name = " ".join(f"WHEN {t} THEN '{n}'" for t, n, _ in cases)
    verdict = " ".join(f"WHEN {t} THEN '{v}'" for t, _, v in cases)
    return f"CASE {name} END", f"CASE {verdict} END"


NAME, VERDICT = _rules()
TWO_LEVEL = ", ".join(f"'{x}'" for x in urlrep.two_level())
STRENGTH = "greatest(2.0, least(1e4, avg({m} * (1 - {m})) / greatest(avg((bad / n - {m}) * (bad / n - {m}) - {m} * (1 - {m}) / n), 1e-6) - 1))"

URL_REPUTATION = rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {LETTERS}) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
known AS (SELECT doc_id, max(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels GROUP BY 1),
o AS (SELECT host, bad FROM p LEFT JOIN known ON doc_id = TRY_CAST(regexp_extract(path, '/(\d{{1,18}})(?:\D|$)', 1) AS BIGINT)),
names AS (SELECT host, bad, regexp_replace(host, ':\d*$', '') AS name, string_split(regexp_replace(host, ':\d*$', ''), '.') AS ls FROM o),
kinds AS (SELECT host, bad, name, ls, regexp_matches(name, '{urlrep.ADDRESS}') AS address, array_to_string(ls[-2:], '.') IN ({TWO_LEVEL}) AS two FROM names),
h AS (SELECT host, CASE WHEN address THEN name WHEN two THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS domain,
      CASE WHEN address THEN '[]' WHEN two THEN array_to_string(ls[-2:], '.') ELSE ls[-1] END AS suffix, count(bad) AS n, count(*) FILTER (bad) AS bad FROM kinds GROUP BY ALL),
t AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
ks AS (SELECT coalesce({STRENGTH.format(m="m")}, 2.0) AS k FROM s, t WHERE n > 0),
rs AS (SELECT suffix, (bad + k * m) / (n + k) AS r FROM s, t, ks),
kd AS (SELECT coalesce({STRENGTH.format(m="r")}, 2.0) AS k FROM d JOIN rs USING (suffix) WHERE n > 0),
rd AS (SELECT domain, (bad + k * r) / (n + k) AS r FROM d JOIN rs USING (suffix), kd),
kh AS (SELECT coalesce({STRENGTH.format(m="r")}, 2.0) AS k FROM h JOIN rd USING (domain) WHERE n > 0),
ds AS (SELECT d.domain, d.n, d.bad, s.n - d.n + k AS sw, (s.bad - d.bad + k * m) / (s.n - d.n + k) AS sr FROM d JOIN s USING (suffix), t, ks),
hd AS (SELECT host, h.n, h.bad, ds.n - h.n + least(kd.k, sw) AS dw, (ds.bad - h.bad + least(kd.k, sw) * sr) / (ds.n - h.n + least(kd.k, sw)) AS dr FROM h JOIN ds USING (domain), kd),
rated AS (SELECT host, (bad + least(k, dw) * dr) / (n + least(k, dw)) AS r, n + least(k, dw) AS rw FROM hd, kh),
blocked AS (SELECT host FROM rated WHERE r - {urlrep.Z} * sqrt(r * (1 - r) / (rw + 1)) > {urlrep.LIMIT})
SELECT page_id, host, path, {NAME} AS rule, coalesce({VERDICT}, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""

ORACLES = {
    "op3_decontamination": DECONTAMINATION,
    "op4_jaccard_join": JACCARD,
    "op5_substring_dedup": SUBSTRING,
    "op9_host_rules": HOST_RULES,
    "op10_url_reputation": URL_REPUTATION,
}
