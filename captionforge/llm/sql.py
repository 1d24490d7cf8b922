"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from captionforge.llm import fingerprints, quality, secrets

_W = r"[^\x20\x09-\x0D]+"
_R = quality.Rules()


def _rest(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length(regexp_replace(t, '{quoted}', '', 'g'))"


def _js(p: str, q: str) -> str:
    half = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda s: CASE WHEN s[1] > 0 THEN s[1] * log2(2 * s[1] / (s[1] + s[2])) ELSE 0 END))"
    return f"round(sqrt(greatest(0, ({half(p, q)} + {half(q, p)}) / 2)), 6)"


_CLASSES = "".join(f", {_rest(p)} AS c_{n}" for n, p in quality.CLASSES)
_SHARES = ", ".join(f"c_{n}" for n, _ in quality.CLASSES)
_LOWER = "word_chars - (" + " + ".join(f"c_{n}" for n, _ in quality.CLASSES) + ")"
_SUMS = ", ".join(f"sum(hist[{k}])" for k in range(1, len(quality.CLASSES) + 3))

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
m AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls{_CLASSES} FROM d),
n AS (SELECT *, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
h AS (SELECT *, [{_LOWER}, length(t) - word_chars, {_SHARES}] AS hist FROM n),
pos AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM h),
grams AS (SELECT rid, k, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM pos WINDOW o AS (PARTITION BY rid ORDER BY k)),
twice AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM grams WHERE w3 IS NOT NULL) WHERE c > 1),
cover AS (SELECT rid, count(DISTINCT k + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
langs AS (SELECT lang, sum(n_words) AS n, [{_SUMS}] AS c FROM h GROUP BY lang HAVING sum(n_words) >= {_R.min_language_words}),
counts AS (SELECT lang, w, count(*) AS c FROM pos JOIN h USING (rid) GROUP BY ALL),
top AS (SELECT lang, w, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS k FROM counts QUALIFY k <= {_R.common_words}),
lists AS (SELECT lang, list(w ORDER BY k) AS common, list(c ORDER BY k) AS cc, sum(c) AS s FROM top GROUP BY lang),
ref AS (SELECT r.lang, list_transform(r.c, lambda x: x / list_sum(r.c)::DOUBLE) AS q, l.common,
  list_transform(range(0, {_R.common_words} + 1), lambda k: CASE WHEN k = 0 THEN (r.n - l.s)::DOUBLE ELSE coalesce(l.cc[k], 0)::DOUBLE END / r.n::DOUBLE) AS wq FROM langs r JOIN lists l USING (lang)),
joined AS (SELECT h.*, q, common, wq, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM h LEFT JOIN ref USING (lang) LEFT JOIN cover c USING (rid)),
hits AS (SELECT j.rid, list_position(j.common, p.w) AS k, count(*) AS c FROM joined j JOIN pos p USING (rid) GROUP BY ALL),
seen AS (SELECT rid, map_from_entries(list((coalesce(k, 0), c))) AS s FROM hits GROUP BY rid),
shared AS (SELECT j.*, list_transform(range(0, {_R.common_words} + 1), lambda k: coalesce(s[k], 0)::DOUBLE / greatest(n_words, 1)::DOUBLE) AS wp,
  list_transform(hist, lambda x: x::DOUBLE / greatest(list_sum(hist), 1)::DOUBLE) AS p FROM joined j LEFT JOIN seen USING (rid)),
judged AS (SELECT *, CASE WHEN q IS NOT NULL THEN {_js('p', 'q')} END AS class_distance, CASE WHEN q IS NOT NULL THEN {_js('wp', 'wq')} END AS word_distance, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed FROM shared)
SELECT doc_id, c_symbol AS n_symbols, n_words, word_chars, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (q IS NOT NULL AND n_words >= {_R.min_judged_words} AND (class_distance > {_R.max_class_distance} OR word_distance > {_R.max_word_distance})) AS kept, class_distance, word_distance
FROM judged
"""

_MOD = 1 << 60
_STRONG = ", ".join(f"(sum(('0x' || substr(g, {15 * k + 1}, 15))::BIGINT) % {_MOD})::BIGINT AS a{k}" for k in range(fingerprints.STRONG))
_HEX = " || ".join(f"lpad(lower(to_hex(a{k})), 15, '0')" for k in range(fingerprints.STRONG))


def _near(a: str, b: str, both: str) -> str:
    either = f"({a}.square + {b}.square - coalesce({both}.dot, 0))"
    return f"CASE WHEN {a}.fp = {b}.fp THEN 1.0::DOUBLE WHEN {either} = 0 THEN 0.0::DOUBLE ELSE round(least(1.0, greatest(0.0, coalesce({both}.dot, 0)::DOUBLE / {either}::DOUBLE)), 6) END"


def _dots(other: str, r: str) -> str:
    return f"SELECT nx.r, sum(x.v * y.v) AS dot FROM nx JOIN buckets x ON x.r = nx.r AND x.kind = 'own' JOIN buckets y ON y.r = nx.{r} AND y.kind = '{other}' AND y.bucket = x.bucket GROUP BY nx.r"


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r FROM documents),
nx AS (SELECT d.*, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS after, coalesce(lead(r) OVER (ORDER BY r), 1) AS ra FROM d),
texts AS (SELECT r, 'own' AS kind, t FROM nx UNION ALL SELECT r, 'edited', substr(t, 1, n_chars - n_chars // 2) || substr(after, 1, n_chars // 2) FROM nx),
strong AS (SELECT r, kind, {_STRONG} FROM (SELECT r, kind, sha256(unnest(string_split(t, chr(10)))) AS g FROM texts) GROUP BY r, kind),
parts AS (SELECT r, kind, unnest(list_filter(string_split_regex(t, '[.!?' || chr(10) || ']+'), lambda x: x <> '')) AS s FROM texts),
weak AS (SELECT r, kind, ('0x' || substr(sha256(s), 1, 3))::BIGINT AS lane, count(*) AS n FROM parts GROUP BY ALL),
lanes AS (SELECT r, kind, string_agg(lpad(lower(to_hex(lane)), 3, '0') || lower(to_hex(n)), '.' ORDER BY lane) AS lanes FROM weak GROUP BY r, kind),
buckets AS (SELECT r, kind, lane >> 1 AS bucket, sum(CASE WHEN lane & 1 = 1 THEN n ELSE -n END) AS v FROM weak GROUP BY ALL),
squares AS (SELECT r, kind, sum(v * v) AS square FROM buckets GROUP BY ALL),
fps AS (SELECT r, kind, {_HEX} || ':' || coalesce(lanes, '') AS fp, coalesce(square, 0) AS square FROM strong LEFT JOIN lanes USING (r, kind) LEFT JOIN squares USING (r, kind)),
edits AS ({_dots("edited", "r")}), nexts AS ({_dots("own", "ra")})
SELECT nx.doc_id, nx.n_chars, sha256(e.t) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, {_near("a", "b", "edits")} AS near_edited, {_near("a", "c", "nexts")} AS near_next
FROM nx JOIN texts e ON e.r = nx.r AND e.kind = 'edited' JOIN fps a ON a.r = nx.r AND a.kind = 'own' JOIN fps b ON b.r = nx.r AND b.kind = 'edited' JOIN fps c ON c.r = nx.ra AND c.kind = 'own'
LEFT JOIN edits ON edits.r = nx.r LEFT JOIN nexts ON nexts.r = nx.r
"""


def _spans(kind: int) -> str:
    pattern = secrets.PATTERNS[kind].replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, m, regexp_extract(m, '{pattern}', 1) AS value, (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a
  FROM (SELECT rid, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS k FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))
  WINDOW w AS (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


_NAMES = "['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b"
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source FROM documents),
found AS ({' UNION ALL '.join(_spans(k) for k in range(4))}),
ends AS (SELECT rid, kind, value, a, a + length(m) AS b FROM found
  WHERE kind IN (1, 2) OR (kind = 0 AND length(value) >= {secrets.MIN_ASSIGNED})
     OR (kind = 3 AND regexp_matches(value, '[0-9].*[0-9]') AND regexp_matches(value, '[A-Za-z].*[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT})),
used AS (SELECT e.* FROM ends e WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM ends o WHERE o.rid = e.rid AND o.kind < 3 AND o.a < e.b AND e.a < o.b)),
owners AS (SELECT value, count(*) AS repos, count(DISTINCT source) AS n FROM (SELECT DISTINCT value, source, doc_id FROM used JOIN d USING (rid)) GROUP BY value),
final AS (SELECT u.* FROM used u JOIN owners USING (value) WHERE kind < 3 OR NOT ((n > {secrets.MAX_OWNERS} AND repos >= {secrets.MIN_REPOS}) OR repos > {secrets.MANY_REPOS})),
lists AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({_NAMES}, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg({_NAMES}, ',' ORDER BY a, kind) AS spans FROM final GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (rid)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
grams AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM starts),
again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM grams) WHERE r > 1),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d),
marks AS (SELECT words.*, CASE WHEN again.i IS NULL THEN 0 ELSE 1 END AS f FROM words LEFT JOIN again ON again.doc_id = words.doc_id AND again.i = words.k),
spans AS (SELECT doc_id, w, k, max(f) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS g FROM marks),
left_ AS (SELECT doc_id, count(*) FILTER (g = 1) AS n_removed, string_agg(w, ' ' ORDER BY k) FILTER (g = 0) AS kept FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ ON left_.doc_id = d.doc_id
"""

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '{_W}') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least_ AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN least_ ON least_.doc_id = d.doc_id
"""

ORACLES = {"op3_fingerprints": FINGERPRINTS, "op5_quality_rules": QUALITY, "op7_substring_dedup": SUBSTRINGS, "op9_secrets": SECRETS, "op10_jaccard_join": JACCARD}
