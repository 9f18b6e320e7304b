"""SQL for DuckDB beside the queries that SQL can express. Patterns and steps are the contract's, by plain joins."""

from __future__ import annotations

from clipfleet.llm import quality_rules, secret_scan

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components(nodes: str, edges: str) -> str:
    """Common tables `reach` and `low` (id, component_id) of undirected edges (a, b), for a WITH RECURSIVE."""
    return f"""both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach AS (SELECT id, id AS met FROM {nodes} UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.met = e.a),
low AS (SELECT id, min(met) AS component_id FROM reach GROUP BY id)"""


QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS t(k) GROUP BY r),
base AS (SELECT worded.r, doc_id, host, text, ls, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM worded LEFT JOIN covered ON worded.r = covered.r),
once AS (SELECT doc_id, host, text, any_value(ls) AS ls FROM base GROUP BY doc_id, host, text),
hashed AS (SELECT doc_id, host, text, len(regexp_extract_all(y, '{WORD}')) AS w,
    ('0x' || left(md5(regexp_replace(lower(array_to_string(regexp_extract_all(y, '{WORD}'), ' ')), '[\\x20\\x09-\\x0D]+', ' ', 'g')), 15))::BIGINT AS h
    FROM (SELECT doc_id, host, text, unnest(ls) AS y FROM once)),
whole AS (SELECT doc_id, host, text, list_sort(list(DISTINCT h)) AS hs FROM hashed GROUP BY doc_id, host, text),
line AS (SELECT hashed.*, hs FROM hashed JOIN whole ON hashed.doc_id IS NOT DISTINCT FROM whole.doc_id AND hashed.host = whole.host AND hashed.text = whole.text),
often AS (SELECT host, h FROM line GROUP BY host, h HAVING count(DISTINCT hs) > {quality_rules.MAX_DOCS}),
removed AS (SELECT doc_id, host, text, sum(w)::BIGINT AS n FROM line JOIN often USING (host, h) GROUP BY doc_id, host, text),
judged AS (SELECT base.*, coalesce(n, 0)::BIGINT AS n_removed_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base LEFT JOIN removed
    ON base.doc_id IS NOT DISTINCT FROM removed.doc_id AND base.host = removed.host AND base.text = removed.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
    NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {quality_rules.MIN_LEFT} OR n_words - n_removed_words < {quality_rules.MIN_SHARE}::DOUBLE * n_words)) AS kept
FROM judged
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
t AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
linked AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
{components("s", "linked")}
SELECT s.id AS doc_id, len(s) AS n_shingles, component_id FROM s JOIN low ON s.id = low.id
"""

REPLY_TREES = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS r2, replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS t2 FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(r2) + length(t2) + length('<||>') + length('<|end|>') + 2)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
fit AS (SELECT id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v
    WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
linked AS (SELECT p.id AS a, q.id AS b FROM fit p JOIN fit q ON p.label = q.label AND len(p.x) = len(q.x) AND p.id < q.id WHERE list_dot_product(p.x, q.x) >= 0.93 * p.norm * q.norm),
degree AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM linked UNION ALL SELECT b FROM linked) GROUP BY id),
{components("v", "linked")}
SELECT v.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.id = component_id AS kept FROM v JOIN low ON v.id = low.id LEFT JOIN degree ON v.id = degree.id
"""


def _found(kind: int, pattern: str, group: int, keep: str) -> str:
    """(r, k, a, z, value): the matches of a pattern with their places, from the text's pieces between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT r, owner, {kind} AS k, a, a + length(m) AS z, value FROM (SELECT r, owner, m[i] AS m, g[i] AS value,
    (list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, owner, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, regexp_split_to_array(text, '{p}') AS between FROM d))) WHERE {keep}"""


_NAMES = f"[{', '.join(repr(k) for k in secret_scan.KINDS)}]"
SECRET_SCAN = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS owner, coalesce(text, '') AS text FROM documents),
base AS ({_found(0, r'''(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 1, "length(value) >= 6")}
UNION ALL {_found(1, "AKIA[A-Z0-9]+", 0, "length(value) >= 20")}
UNION ALL {_found(2, "[0-9a-f]+", 0, "length(value) >= 24")}),
long AS ({_found(3, "[A-Za-z0-9+/_-]+", 0, "length(value) >= 20")}),
classed AS (SELECT *, list_transform(string_split(value, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN 1 WHEN c BETWEEN 'A' AND 'Z' THEN 2 WHEN c BETWEEN 'a' AND 'z' THEN 3 ELSE 0 END) AS cs FROM long),
other AS (SELECT * EXCLUDE (cs) FROM classed long WHERE length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 4 AND (length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4
        OR 10 * len(list_filter(range(1, len(cs)), lambda i: cs[i] > 0 AND cs[i + 1] > 0 AND cs[i] <> cs[i + 1])) >= 3 * (len(cs) - 1))
    AND list_aggregate(string_split(value, ''), 'entropy') >= 3.0 AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = long.r AND base.a < long.z AND long.a < base.z)),
every AS (FROM base UNION ALL FROM other),
owners AS (SELECT value, count(DISTINCT every.owner) AS n_owners, least(count(DISTINCT coalesce(doc_id::VARCHAR, 'null')), count(DISTINCT text)) AS n_repos FROM every JOIN d USING (r) GROUP BY value),
told AS (SELECT r, k, a, z, n_owners, n_repos, n_owners >= {secret_scan.EXAMPLE_OWNERS} OR n_repos >= {secret_scan.EXAMPLE_REPOS} AS example, ({_NAMES})[k + 1] || ':' || a || ':' || z AS s FROM every JOIN owners USING (value)),
per AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(s, ',' ORDER BY a, k, z) FILTER (k < 3) AS b, string_agg(s, ',' ORDER BY a, k, z) FILTER (k < 3 OR NOT example) AS spans, count(*) FILTER (example AND k < 3) AS n_examples, max(n_owners) AS n_owners, max(n_repos) AS n_repos FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_examples, 0) AS n_examples, coalesce(n_owners, 0) AS n_owners, coalesce(n_repos, 0) AS n_repos FROM d LEFT JOIN per USING (r)
"""



def crc32(bytes_: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    step = "list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda x, y: {step}), 4294967295)"


def bytes_of(text: str) -> str:
    return f"list_transform(range(0, CAST(length(hex(encode({text}))) AS BIGINT) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"


# one step for each row; a state of the roles is (cost, letters, text) of its cheapest path: e empty, s, u, a. At most one
# inserted turn stands before a row on a cheapest path (two lead back, or to what deleting a system row gives for less).
_PUT = lambda q, role: f"row({q}.c + 3, {q}.s || 'I', {q}.o || chr(10) || '{role}:')"
_ROW = lambda q, cost, letter, role: f"row({q}.c + {cost}, {q}.s || '{letter}', {q}.o || {role})"
_LEAST = lambda *options: f"list_min([{', '.join(options)}])"
_IF = lambda test, x: f"CASE WHEN {test} THEN {x} END"
_GONE = lambda q: _ROW(q, 4, "D", "''")
_KEPT = lambda q, role: _IF(f"NOT go AND ini = '{role}'", _ROW(q, "late", "K", "chr(10) || role || ':' || text"))
_REROLED = lambda q, role: _IF("NOT go", _ROW(q, "3 + late", "R", f"chr(10) || '{role}:' || text"))
_PATH = "STRUCT(c BIGINT, s VARCHAR, o VARCHAR)"

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (SELECT *, {crc32(bytes_of("k"))} % 20 AS d FROM raw),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM dealt, range(2) AS t(n) WHERE d <> 0 AND (n = 0 OR d = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM placed),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault FROM seen),
code AS (SELECT conv_id, i, role, text, left(role, 1) AS ini, fault IN ('blank', 'duplicate') AS go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM faulty),
path AS (SELECT conv_id, 0::BIGINT AS i, row(0, '', '')::{_PATH} AS e, row(1000000, '', '')::{_PATH} AS s, row(1000000, '', '')::{_PATH} AS u, row(1000000, '', '')::{_PATH} AS a FROM (SELECT DISTINCT conv_id FROM code)
  UNION ALL SELECT conv_id, i, {_GONE("e")}::{_PATH}, {_LEAST(_GONE("s"), _KEPT("e", "s"))}::{_PATH},
    {_LEAST(_GONE("u2"), *[f(q, x) for q in ("e", "s", "a2") for f, x in ((_KEPT, "u"), (_REROLED, "user"))])}::{_PATH},
    {_LEAST(_GONE("a2"), _KEPT("u2", "a"), _REROLED("u2", "assistant"))}::{_PATH}
  FROM (SELECT p.conv_id, c.i, e, s, c.ini, c.go, c.late, c.role, c.text, {_LEAST("u", _PUT("e", "user"), _PUT("s", "user"), _PUT("a", "user"))}::{_PATH} AS u2, {_LEAST("a", _PUT("u", "assistant"))}::{_PATH} AS a2
    FROM path p JOIN code c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1) x),
best AS (SELECT conv_id, {_LEAST("e", "a", _PUT("u", "assistant"))}::{_PATH} AS b FROM path p WHERE NOT EXISTS (SELECT 1 FROM code c WHERE c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1)),
told AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.s, '') AS audit, sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM raw) r LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM r.conv_id
"""

IMPORTANCE_RESAMPLING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS x FROM d),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
hashed AS (SELECT x, {crc32(bytes_of("x"))} % 10000 AS b FROM (SELECT x FROM words UNION SELECT x FROM wanted)),
s AS (SELECT b, count(*)::DOUBLE AS n FROM words JOIN hashed USING (x) GROUP BY b),
t AS (SELECT b, count(*)::DOUBLE AS n FROM wanted JOIN hashed USING (x) GROUP BY b),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1) * (sums.s + 10000) / ((s.n + 1) * (sums.t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b), sums),
weight AS (SELECT d.r, any_value(d.doc_id) AS doc_id, any_value(len(w)) AS n, coalesce(sum(g), 0)::BIGINT AS weight FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN hashed USING (x) LEFT JOIN gain USING (b) GROUP BY d.r),
scored AS (SELECT r, doc_id, n, weight, weight + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weight),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS m FROM scored WHERE n >= 20)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN k <= m * 10 // 100 THEN k END AS rank FROM scored LEFT JOIN placed USING (r)
"""

ORACLE_SQL = {"op2_quality_rules": QUALITY_RULES, "op3_ngram_join": NGRAM_JOIN, "op4_reply_trees": REPLY_TREES, "op5_embedding_dedup": EMBEDDING_DEDUP, "op10_secret_scan": SECRET_SCAN, "op11_conversation_repair": CONVERSATION_REPAIR, "op12_importance_resampling": IMPORTANCE_RESAMPLING}
