"""Timeline tables derived from the given tables, in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split()

_GAP = "CASE WHEN {end} THEN 900 WHEN word LIKE '%,' THEN 400 WHEN (idx * 7 + clip_id) % 29 = 0 THEN 700 ELSE 60 END"
_TIMED = "SELECT *, 120 + 40 * length(word) AS dur_ms, {gap} AS gap_ms FROM ({source}) t"
_WORDS = """SELECT clip_id, CAST(idx AS BIGINT) AS idx, word,
  CAST(coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + dur_ms AS BIGINT) AS end_ms,
  {norm} AS norm FROM ({timed}) g"""
# `$` also matches before a last line end, which only the words that end in one need a pattern for
_ENDS = r"(endswith(word, '.') OR endswith(word, '!') OR endswith(word, '?') OR ((endswith(word, '\u0085') OR endswith(word, '\u2028') OR endswith(word, '\u2029')) AND word rlike '[.!?]$'))"
_SPARK_TIMED = _TIMED.format(gap=_GAP.format(end=_ENDS), source=r"SELECT clip_id, CAST(idx AS BIGINT) AS idx, word FROM (SELECT doc_id AS clip_id, posexplode(filter(split(text, '[ \\n\\t\\r]+'), x -> x <> '')) AS (idx, word) FROM whole_texts) t")
# [^a-z0-9'] as the ranges that it is, as in normalize_token
_SPARK_WORDS = _WORDS.format(norm=r"""CASE WHEN word rlike "^[a-z0-9']*$" THEN word ELSE regexp_replace(lower(word), "[\\x00-&(-/:-`\\x7b-\\uDBFF\\uDFFF]+", '') END""", timed=_SPARK_TIMED)
_DUCK_WORDS = _WORDS.format(norm="regexp_replace(lower(word), '[^a-z0-9'']+', '', 'g')", timed=_TIMED.format(gap=_GAP.format(end="regexp_matches(word, '[.!?]$')"), source=r"SELECT clip_id, unnest(range(len(a))) AS idx, unnest(a) AS word FROM (SELECT doc_id AS clip_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS a FROM documents) d"))

_BOTH = {
    "durations": "SELECT clip_id, CAST(max(end_ms) + clip_id % 4 * 500 AS BIGINT) AS duration_ms FROM words GROUP BY clip_id",
    "clips": """SELECT o_orderkey AS clip_id,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 1920 WHEN 1 THEN 3840 WHEN 2 THEN 1080 WHEN 3 THEN 1280 ELSE 2560 END AS BIGINT) AS src_w,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 2160 WHEN 2 THEN 1920 WHEN 3 THEN 720 ELSE 1080 END AS BIGINT) AS src_h,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'full-portrait' WHEN '2-HIGH' THEN 'wide-portrait' WHEN '3-MEDIUM' THEN 'square' WHEN '5-LOW' THEN 'widescreen' ELSE 'portrait' END AS aspect
FROM orders""",
    "subject_track": """SELECT clip_id, n * 200 AS t_ms, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CAST(conf AS BIGINT) AS conf,
  CAST(CASE WHEN conf = 1 THEN cx - 80 END AS BIGINT) AS bx0, CAST(CASE WHEN conf = 1 THEN cy - 100 END AS BIGINT) AS by0,
  CAST(CASE WHEN conf = 1 THEN cx + 80 END AS BIGINT) AS bx1, CAST(CASE WHEN conf = 1 THEN cy + 100 END AS BIGINT) AS by1
FROM (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS n,
        100 + (event_id * 37) % 1720 AS cx, 120 + (event_id * 53) % 840 AS cy, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS conf
      FROM events) e""",
    "detections": """SELECT l_orderkey AS clip_id, CAST(l_linenumber - l_linenumber % 2 AS BIGINT) AS frame_idx, CAST(l_linenumber AS BIGINT) AS ord,
  CAST(l_partkey % 1600 AS BIGINT) AS x, CAST(l_suppkey % 800 AS BIGINT) AS y, CAST(40 + l_partkey % 200 AS BIGINT) AS w, CAST(40 + (l_partkey * 7) % 200 AS BIGINT) AS h
FROM lineitem""",
    "qc_elements": """SELECT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS ord,
  CASE l_linenumber % 4 WHEN 0 THEN 'logo' WHEN 1 THEN 'caption' WHEN 2 THEN 'face' ELSE 'overlay' END AS kind,
  CAST((l_partkey * 13) % 900 AS BIGINT) AS x0, CAST((l_suppkey * 97 + l_linenumber * 211) % 1600 AS BIGINT) AS y0,
  CAST((l_partkey * 13) % 900 + 60 + l_partkey % 120 AS BIGINT) AS x1, CAST((l_suppkey * 97 + l_linenumber * 211) % 1600 + 60 + l_suppkey % 200 AS BIGINT) AS y1,
  CAST(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE (l_partkey % 10) * 500 END AS BIGINT) AS t_ms,
  CAST(CASE WHEN l_linenumber % 4 IN (0, 2) THEN NULL ELSE (l_partkey % 10) * 500 + 1500 END AS BIGINT) AS t_end_ms
FROM lineitem""",
    "overlays": """SELECT CAST(p_partkey % 200 AS BIGINT) AS clip_id, CAST(p_partkey AS BIGINT) AS i,
  CASE p_size % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'card' END AS kind,
  CAST((p_partkey * 1700) % 60000 AS BIGINT) AS start_ms, CAST((p_partkey * 1700) % 60000 + (p_size % 9 - 1) * 400 AS BIGINT) AS end_ms,
  CASE p_size % 4 WHEN 0 THEN 'full-bleed' WHEN 1 THEN 'bottom-half' ELSE 'pip-rect' END AS placement,
  CASE WHEN p_size % 5 = 0 THEN 'fade' ELSE 'cut' END AS transition, CAST(CASE WHEN p_size % 5 = 0 THEN 300 ELSE 0 END AS BIGINT) AS fade_ms,
  CAST((p_partkey * 31) % 1300 - 100 AS BIGINT) AS rx, CAST((p_partkey * 17) % 2200 - 100 AS BIGINT) AS ry, CAST(50 + p_size * 8 AS BIGINT) AS rw, CAST(40 + p_size * 6 AS BIGINT) AS rh
FROM part""",
    "target_history": """SELECT o_custkey AS project_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq,
  CASE o_orderkey % 3 WHEN 0 THEN 'full-portrait' WHEN 1 THEN 'full-portrait' ELSE 'square' END AS aspect,
  CASE o_orderstatus WHEN 'F' THEN 'auto' WHEN 'O' THEN '1080p' ELSE '4k' END AS resolution
FROM orders""",
    "silence_log": """SELECT clip_id, CAST(n * 2 + k AS BIGINT) AS line_no,
  concat(CASE k WHEN 0 THEN '[silencedetect] silence_start: ' ELSE '[silencedetect] silence_end: ' END,
    CAST(CAST((ms - ms % 1000) / 1000 AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(ms % 1000 AS VARCHAR(20)), 3, '0')) AS line
FROM (SELECT clip_id, idx AS n, 0 AS k, end_ms AS ms FROM g WHERE nxt - end_ms > 600
      UNION ALL SELECT clip_id, idx AS n, 1 AS k, nxt AS ms FROM g WHERE nxt - end_ms > 600) u WHERE (clip_id + n * 2 + k) % 17 <> 0""",
    "g": "SELECT clip_id, idx, end_ms, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY idx) AS nxt FROM words",
    "style_layers": """SELECT CAST(c_custkey AS BIGINT) AS clip_id, CAST(1 AS BIGINT) AS priority, 'max_chars' AS k, CAST(24 AS VARCHAR(20)) AS v FROM customer
UNION ALL SELECT c_custkey, 2, 'max_chars', CAST(20 + c_nationkey AS VARCHAR(20)) FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT c_custkey, 3, 'max_chars', CAST(12 + c_custkey % 20 AS VARCHAR(20)) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 2, 'karaoke', 'true' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 3, 'not_a_key', 'x' FROM customer WHERE c_custkey % 7 = 0""",
}
_SPARK = {
    "words": _SPARK_WORDS,
    # words end later and later, so the last end is the sum of all without the last gap: no order of rows is needed
    "durations": f"SELECT clip_id, CAST(sum(dur_ms + gap_ms) - max_by(gap_ms, idx) + clip_id % 4 * 500 AS BIGINT) AS duration_ms FROM ({_SPARK_TIMED}) g GROUP BY clip_id",
    # both lines of a pause come from the one row of it, so words are formed once
    "silence_log": """SELECT clip_id, CAST(n * 2 + k AS BIGINT) AS line_no,
  concat(CASE k WHEN 0 THEN '[silencedetect] silence_start: ' ELSE '[silencedetect] silence_end: ' END,
    CAST(CAST((ms - ms % 1000) / 1000 AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(ms % 1000 AS VARCHAR(20)), 3, '0')) AS line
FROM (SELECT clip_id, idx AS n, posexplode(array(end_ms, nxt)) AS (k, ms) FROM g WHERE nxt - end_ms > 600) u WHERE (clip_id + n * 2 + k) % 17 <> 0""",
    "pages_parsed": r"""SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  transform(filter(split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>'), (x, i) -> i > 0), x -> btrim(regexp_replace(regexp_replace(x, '<[^>]*>', ' '), '[ \\n\\t\\r]+', ' '))) AS paragraphs FROM pages""",
    "window_queries": "SELECT item_id AS query_id, text AS phrase FROM benchmark",
    "mask_runs": "SELECT CAST(s_suppkey AS BIGINT) AS mask_id, CAST(y AS BIGINT) AS y, CAST(4 + s_suppkey % 3 * 2 AS BIGINT) AS x0, CAST(CASE WHEN y >= 40 THEN 45 - s_suppkey % 5 ELSE 60 END AS BIGINT) AS x1 FROM supplier LATERAL VIEW explode(sequence(2, 61)) t AS y",
}
_DUCK = {
    "words": _DUCK_WORDS,
    "pages_parsed": r"""SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  list_transform(string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')[2:], lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \n\t\r]+', ' ', 'g'))) AS paragraphs FROM pages""",
    "window_queries": "SELECT item_id AS query_id, text AS phrase FROM benchmark",
    "mask_runs": "SELECT CAST(s_suppkey AS BIGINT) AS mask_id, CAST(y AS BIGINT) AS y, CAST(4 + s_suppkey % 3 * 2 AS BIGINT) AS x0, CAST(CASE WHEN y >= 40 THEN 45 - s_suppkey % 5 ELSE 60 END AS BIGINT) AS x1 FROM supplier, unnest(range(2, 62)) t(y)",
}
#: Steps that several others read: computed once, so that no join order multiplies their work.
_SHARED = {"words", "labelled", "pieces", "clusters", "q_tokens", "starts", "exacts", "cluster_hits", "spans_", "smoothed", "safe_rects", "zone_rows"}
_ORDER = ["words", "durations", "g", "silence_log", "clips", "subject_track", "detections", "qc_elements", "overlays", "target_history", "style_layers", "pages_parsed", "window_queries", "mask_runs"]


def text_parts(spark: SparkSession, sf_dir: str) -> int:
    """The number of partitions that whole texts, and so words, lie in by clip."""
    return 16 * fixture(spark, sf_dir, "documents").select("doc_id", "text").rdd.getNumPartitions()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table (or a given one) as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "whole_texts":
        # whole texts meet their clip's task before they become words, so no word is shuffled for a window by clip; more
        # tasks than read them, as words take many times the room: a task's words should be sorted within its memory
        docs = fixture(spark, sf_dir, "documents").select("doc_id", "text")
        return docs.repartition(text_parts(spark, sf_dir), F.col("doc_id"))
    text = _SPARK.get(name) or _BOTH[name]
    used = [t for t in [*TABLES, "whole_texts", *_ORDER] if t != name and re.search(rf"\b(?:FROM|from|JOIN|join) {t}\b", text)]
    text = re.sub(r"\b(FROM|from|JOIN|join) (" + "|".join(used) + r")\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: fixture(spark, sf_dir, t) for t in used})


def with_sql(body: str, steps: dict[str, str] | None = None, recursive: bool = False) -> str:
    """body as DuckDB SQL: the derived tables, then `steps`, stand before it as common table expressions."""
    all_steps = {n: _DUCK.get(n) or _BOTH[n] for n in _ORDER} | (steps or {})
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for n in all_steps:
            if n not in need and re.search(rf"\b{n}\b", text) and all_steps[n] is not text:
                need.add(n)
                todo.append(all_steps[n])
    once = lambda n: "MATERIALIZED " * (n in _SHARED)
    return (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS {once(n)}({all_steps[n]})" for n in all_steps if n in need) + "\n" if need else "") + body
