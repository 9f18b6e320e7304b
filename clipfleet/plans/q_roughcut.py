"""Queries of the rough cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipfleet.functions.dims import FILLERS, STOP_WORDS
from clipfleet.functions.exprs import normalize_token, term_key
from clipfleet.operators import roughcut as R
from clipfleet.plans.base import Tables, query
from clipfleet.plans.fixtures import text_parts
from clipfleet.sources.scratch import stored

_IN = lambda words: ", ".join(f"'{w}'" for w in words)


def pads_sql(lead: int = 60, tail: int = 150) -> str:
    return f"""SELECT clip_id, n, a_ms, greatest(a_ms, b_ms) AS b_ms, d AS duration_ms FROM (SELECT clip_id, n, d,
  greatest(start_ms - {lead}, coalesce(lag(end_ms) OVER w, 0), 0) AS a_ms, least(end_ms + {tail}, coalesce(lead(start_ms) OVER w, d), d) AS b_ms
  FROM (SELECT r.*, greatest(duration_ms, max(end_ms) OVER (PARTITION BY r.clip_id)) AS d FROM runs r JOIN durations USING (clip_id)) z WINDOW w AS (PARTITION BY clip_id ORDER BY n)) p"""


STEPS = {
    "labelled": f"""SELECT *, CASE WHEN norm IN ({_IN(FILLERS)}) THEN 'filler' WHEN norm <> '' AND norm = lead(norm) OVER w AND lead(start_ms) OVER w - end_ms <= 500 THEN 'false-start' END AS label FROM words WINDOW w AS (PARTITION BY clip_id ORDER BY idx)""",
    "blocks": "SELECT *, sum(CASE WHEN label IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY idx) AS block FROM labelled",
    "opens": "SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY clip_id, block ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 600 THEN 1 ELSE 0 END AS o FROM blocks WHERE label IS NULL",
    "run_of": "SELECT *, sum(o) OVER (PARTITION BY clip_id, block ORDER BY idx) AS run FROM opens",
    "runs": "SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY min(idx)) AS n, arg_min(start_ms, idx) AS start_ms, max(end_ms) AS end_ms FROM run_of GROUP BY clip_id, block, run",
    "pads": pads_sql(),
    "wide_pads": pads_sql(200, 300),
}


def _pieces(pads: str) -> str:
    return f"""SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY n, k) - 1 AS i, s AS start_ms, e AS end_ms, keep FROM (
  SELECT clip_id, n, 0 AS k, lag(b_ms, 1, 0) OVER (PARTITION BY clip_id ORDER BY n) AS s, a_ms AS e, false AS keep FROM {pads}
  UNION ALL SELECT clip_id, n, 1, a_ms, b_ms, true FROM {pads}
  UNION ALL SELECT clip_id, max(n), 2, max(b_ms), max(duration_ms), false FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC) AS back FROM {pads}) t WHERE back = 1 GROUP BY clip_id
  UNION ALL SELECT clip_id, 1, 0, 0, duration_ms, true FROM durations WHERE clip_id NOT IN (SELECT clip_id FROM {pads})) u WHERE e > s"""


STEPS |= {
    "pieces": _pieces("pads"),
    "wide_pieces": _pieces("wide_pads"),
    "buckets": "SELECT clip_id, i, keep, start_ms, end_ms, unnest(range(start_ms // 10000, end_ms // 10000 + 1)) AS b FROM pieces",
    "texts": "SELECT p.clip_id, p.i, string_agg(word, ' ' ORDER BY idx) AS text FROM buckets p JOIN words w ON p.clip_id = w.clip_id AND p.b = (w.start_ms + w.end_ms) // 20000 AND 2 * p.start_ms <= w.start_ms + w.end_ms AND w.start_ms + w.end_ms < 2 * p.end_ms GROUP BY p.clip_id, p.i",
    "marks": "SELECT p.clip_id, p.i, max(CASE WHEN label = 'filler' THEN 2 ELSE 1 END) AS rank FROM buckets p JOIN (SELECT *, unnest(range(start_ms // 10000, end_ms // 10000 + 1)) AS b FROM labelled WHERE label IS NOT NULL) m ON p.clip_id = m.clip_id AND p.b = m.b AND m.start_ms < p.end_ms AND m.end_ms > p.start_ms WHERE NOT keep GROUP BY p.clip_id, p.i",
    "reasoned": "SELECT p.*, CASE WHEN keep THEN '' WHEN rank = 2 THEN 'filler' WHEN rank = 1 THEN 'false-start' ELSE 'silence' END AS reason FROM pieces p LEFT JOIN marks USING (clip_id, i)",
    "segments": "SELECT p.*, coalesce(text, '') AS text FROM reasoned p LEFT JOIN texts USING (clip_id, i)",
    "events_": r"SELECT clip_id, line_no, contains(line, 'silence_start:') AS opens, CAST(round_even(CAST(regexp_extract(line, 'silence_(?:start|end):\s*(-?[0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) * 1000, 0) AS BIGINT) AS ms FROM silence_log",
    "paired": "SELECT clip_id, line_no, ms, opens, lag(opens) OVER w AS was, lag(ms) OVER w AS prev, lead(opens) OVER w IS NULL AS last FROM events_ WINDOW w AS (PARTITION BY clip_id ORDER BY line_no)",
    "silences": "SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY line_no) AS n, CASE WHEN opens THEN ms ELSE prev END AS start_ms, CASE WHEN opens THEN NULL ELSE ms END AS end_ms FROM paired WHERE (NOT opens AND was) OR (opens AND last)",
    "held": "SELECT clip_id, duration_ms, least(greatest(start_ms, 0), duration_ms) AS s, least(greatest(coalesce(end_ms, duration_ms), 0), duration_ms) AS e FROM silences JOIN durations USING (clip_id)",
    "regions": """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY s) AS n, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms FROM (
  SELECT clip_id, coalesce(max(e) OVER (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, s AS e FROM held
  UNION ALL SELECT d.clip_id, coalesce(max(h.e), 0), max(d.duration_ms) FROM durations d LEFT JOIN held h ON d.clip_id = h.clip_id GROUP BY d.clip_id) u WHERE e - s >= 100""",
    "q_tokens": r"SELECT query_id, unnest(range(len(q))) AS pos, unnest(q) AS norm, len(q) AS m, len(list_filter(q, lambda x: x NOT IN (" + _IN(STOP_WORDS) + r"))) = 0 AS all_stop FROM (SELECT query_id, list_filter(list_transform(regexp_split_to_array(phrase, '\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9'']+', '', 'g')), lambda x: x <> '') AS q FROM window_queries) t",
    "starts": "SELECT query_id, clip_id, w.idx AS i, m FROM (SELECT *, lead(norm) OVER v AS n1, lead(norm, 2) OVER v AS n2 FROM words WINDOW v AS (PARTITION BY clip_id ORDER BY idx)) w JOIN (SELECT query_id, any_value(m) AS m, max(norm) FILTER (pos = 0) AS q0, max(norm) FILTER (pos = 1) AS q1, max(norm) FILTER (pos = 2) AS q2 FROM q_tokens GROUP BY query_id) q ON norm = q0 AND (q1 IS NULL OR n1 = q1) AND (q2 IS NULL OR n2 = q2)",
    "exacts": "SELECT query_id, clip_id, min(i) AS i, min(i) + max(m) - 1 AS j FROM (SELECT s.query_id, s.clip_id, s.i, s.m FROM starts s JOIN q_tokens q ON q.query_id = s.query_id JOIN words w ON w.clip_id = s.clip_id AND w.idx = s.i + q.pos AND w.norm = q.norm GROUP BY ALL HAVING count(*) = s.m) e GROUP BY query_id, clip_id",
    "clusters": "SELECT *, sum(o) OVER (PARTITION BY clip_id ORDER BY idx) AS cluster FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY clip_id ORDER BY idx) > 600 THEN 1 ELSE 0 END AS o FROM words) t",
    "cluster_hits": f"SELECT query_id, clip_id, cluster, count(DISTINCT norm) AS d, min(idx) AS i, max(idx) AS j FROM clusters JOIN (SELECT DISTINCT query_id, norm FROM q_tokens WHERE all_stop OR norm NOT IN ({_IN(STOP_WORDS)})) k USING (norm) GROUP BY query_id, clip_id, cluster",
    "spans_": "SELECT query_id, clip_id, i, j, true AS exact FROM exacts UNION ALL SELECT query_id, clip_id, i, j, false FROM (SELECT *, row_number() OVER (PARTITION BY query_id, clip_id ORDER BY d DESC, cluster) AS r FROM cluster_hits ANTI JOIN exacts USING (query_id, clip_id)) h WHERE r = 1",
    "span_times": """SELECT query_id, s.clip_id, exact, lo, hi, greatest(lo, a.start_ms - 100) AS s, least(hi, b.end_ms + 100) AS e FROM spans_ s JOIN words a ON a.clip_id = s.clip_id AND a.idx = s.i JOIN words b ON b.clip_id = s.clip_id AND b.idx = s.j
  JOIN (SELECT clip_id, arg_min(start_ms, idx) AS lo, arg_max(end_ms, idx) AS hi FROM words GROUP BY clip_id) x ON x.clip_id = s.clip_id""",
    "grown": "SELECT *, greatest(lo, s - (1500 - (e - s)) // 2) AS s1 FROM span_times WHERE e - s < 1500",
}


def whole_cut(t: Tables):
    """The rough cut of all clips. Lengths of clips are few beside words, and dealt to where words lie once stored."""
    return R.rough_cut(t.words, stored(t.durations, "durations"), parts=text_parts(t.spark, t.sf_dir))


@query("SELECT clip_id, idx, norm, rtrim(ltrim(lower(trim(word, ' ')), '.,!?;:\"'')(][' ), '.,!?;:\"'')([]') AS term FROM words")
def token_forms(t: Tables):
    return t.words.select("clip_id", "idx", normalize_token(F.col("word")).alias("norm"), term_key(F.col("word")).alias("term"))


@query("SELECT clip_id, idx, label FROM labelled", STEPS)
def label_words(t: Tables):
    return R.label_words(t.words).select("clip_id", "idx", "label")


@query("SELECT clip_id, n, start_ms, end_ms FROM runs", STEPS)
def keep_runs(t: Tables):
    return R.keep_runs(R.label_words(t.words))


@query("SELECT clip_id, n, a_ms, b_ms FROM pads", STEPS)
def pad_runs(t: Tables):
    return R.pad_runs(R.keep_runs(R.label_words(t.words)), t.durations).select("clip_id", "n", "a_ms", "b_ms")


@query("SELECT clip_id, i, start_ms, end_ms, keep, reason, text FROM segments", STEPS)
def rough_cut(t: Tables):
    return whole_cut(t)


@query("SELECT clip_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start_ms, duration_ms AS end_ms, true AS keep, '' AS reason, coalesce(string_agg(word, ' ' ORDER BY idx), '') AS text FROM durations LEFT JOIN words USING (clip_id) GROUP BY clip_id, duration_ms", STEPS)
def rough_cut_untrimmed(t: Tables):
    return R.rough_cut(t.words, t.durations, trim=False)


@query("SELECT clip_id, i, start_ms, end_ms, coalesce(start_ms < lag(end_ms) OVER (PARTITION BY clip_id ORDER BY i), false) AS overlaps_prev FROM wide_pieces WHERE keep", STEPS)
def overlapping_keeps(t: Tables):
    pads = R.pad_runs(R.keep_runs(R.label_words(t.words)), t.durations, 200, 300)
    return R.overlap_flags(R.cut_pieces(pads, t.durations)).drop("keep")


@query("""SELECT clip_id, n, CASE WHEN lag(b_ms) OVER w > a_ms THEN (lag(e) OVER w + s) // 2 ELSE a_ms END AS a_ms, CASE WHEN lead(a_ms) OVER w < b_ms THEN (e + lead(s) OVER w) // 2 ELSE b_ms END AS b_ms
FROM (SELECT p.*, r.start_ms AS s, r.end_ms AS e FROM wide_pads p JOIN runs r USING (clip_id, n)) x WINDOW w AS (PARTITION BY clip_id ORDER BY n)""", STEPS)
def strict_pads(t: Tables):
    return R.pad_runs(R.keep_runs(R.label_words(t.words)), t.durations, 200, 300, strict=True).drop("duration_ms")


@query("""SELECT clip_id, CAST(coalesce(sum(CASE WHEN keep THEN end_ms - start_ms END), 0) AS BIGINT) AS kept_ms, max(end_ms) AS source_ms, count(*) AS n_segments, CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) AS n_keep,
  CAST(coalesce(sum(CASE WHEN reason = 'filler' THEN end_ms - start_ms END), 0) AS BIGINT) AS filler_ms, CAST(coalesce(sum(CASE WHEN reason = 'false-start' THEN end_ms - start_ms END), 0) AS BIGINT) AS false_start_ms, CAST(coalesce(sum(CASE WHEN reason = 'silence' THEN end_ms - start_ms END), 0) AS BIGINT) AS silence_ms FROM reasoned GROUP BY clip_id""", STEPS)
def cut_stats(t: Tables):
    return R.cut_stats(R.decisions(t.words, t.durations))


@query("SELECT clip_id, i, start_ms, end_ms, reason, text FROM segments WHERE keep", STEPS)
def kept_segments(t: Tables):
    return R.kept(whole_cut(t)).drop("keep")


@query("SELECT clip_id, n, start_ms, end_ms FROM silences", STEPS)
def read_silence_log(t: Tables):
    return R.read_silence_log(t.silence_log)


@query("SELECT clip_id, n, start_ms, end_ms FROM regions", STEPS)
def speech_regions(t: Tables):
    return R.speech_regions(R.read_silence_log(t.silence_log), t.durations, 100)


@query("SELECT clip_id, n - 1 AS idx, concat('[speech ', n, ']') AS word, start_ms, end_ms, concat('speech', n) AS norm, 'und' AS language FROM regions", STEPS)
def silence_transcript(t: Tables):
    return R.silence_transcript(R.speech_regions(R.read_silence_log(t.silence_log), t.durations, 100))


@query("SELECT w.clip_id, w.start_ms AS t_ms, o.i, o.kind FROM words w JOIN overlays o ON w.clip_id = o.clip_id AND o.start_ms <= w.start_ms AND w.start_ms < o.end_ms")
def active_at(t: Tables):
    probes = t.words.select("clip_id", F.col("start_ms").alias("t_ms"))
    return R.active_at(t.overlays, probes).select("clip_id", "t_ms", "i", "kind")


@query("""SELECT query_id, clip_id, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, exact FROM span_times WHERE e - s >= 1500
UNION ALL SELECT query_id, clip_id, CAST(greatest(lo, least(hi, s1 + 1500) - 1500) AS BIGINT), CAST(least(hi, s1 + 1500) AS BIGINT), exact FROM grown""", STEPS)
def propose_windows(t: Tables):
    return R.propose_windows(t.words, t.window_queries, 100, 100, 1500)
