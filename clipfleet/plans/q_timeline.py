"""Queries of captions and cut time."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipfleet.functions.dims import BREAK_WORDS
from clipfleet.functions.exprs import to_frames
from clipfleet.operators import captions as C
from clipfleet.operators import roughcut as R
from clipfleet.operators import timeline as L
from clipfleet.plans.base import Tables, query
from clipfleet.plans.fixtures import text_parts
from clipfleet.plans.q_roughcut import STEPS as CUT
from clipfleet.sources.scratch import stored

FPS = 30
_frames = lambda x: f"CAST(round_even({x} * {FPS} / 1000.0, 0) AS BIGINT)"
# a source time in the cut: spans of the clip as rows c (first span whose end is not before it)
_cut = lambda ms, clip: f"""(SELECT CAST(CASE WHEN count(*) = 0 THEN 0 WHEN count(*) FILTER (WHERE {ms} * {FPS} <= out_f * 1000) = 0 THEN max(offset_f + out_f - in_f)
  ELSE arg_min(CASE WHEN {ms} * {FPS} < in_f * 1000 THEN offset_f ELSE CAST(round_even(((offset_f - in_f) * 1000 + {ms} * {FPS}) / 1000.0, 0) AS BIGINT) END, n) FILTER (WHERE {ms} * {FPS} <= out_f * 1000) END AS BIGINT) FROM base c WHERE c.clip_id = {clip})"""  # noqa: E731
_over = lambda s, e, clip: f"EXISTS (SELECT 1 FROM base c WHERE c.clip_id = {clip} AND least({e} * {FPS}, out_f * 1000) > greatest({s} * {FPS}, in_f * 1000))"

STEPS = CUT | {
    "numbered": "SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS n, start_ms, end_ms FROM pieces WHERE keep",
    "framed": f"SELECT clip_id, n, {_frames('start_ms')} AS in_f, {_frames('end_ms')} AS out_f FROM numbered",
    "base": "SELECT *, CAST(coalesce(sum(out_f - in_f) OVER (PARTITION BY clip_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_f FROM framed WHERE out_f > in_f",
    "ends_": r"""SELECT *, CASE WHEN regexp_matches(trim(word), '[.!?]+[")\]]?$') OR coalesce(lead(start_ms) OVER (PARTITION BY clip_id ORDER BY idx) - end_ms >= 600, false) THEN 1 ELSE 0 END AS ends FROM words""",
    "spans": "SELECT *, CAST(coalesce(sum(ends) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span FROM ends_",
    # plain cues for what follows: three words of a span each
    "in_span": "SELECT *, row_number() OVER (PARTITION BY clip_id, span ORDER BY idx) - 1 AS k FROM spans",
    "triples": "SELECT clip_id, dense_rank() OVER (PARTITION BY clip_id ORDER BY span, k // 3) - 1 AS i, idx, word, start_ms, end_ms FROM in_span",
    "cues": "SELECT clip_id, i, arg_min(start_ms, idx) AS start_ms, arg_max(end_ms, idx) AS end_ms, string_agg(word, ' ' ORDER BY idx) AS line, count(*) AS n_words, min(idx) AS first FROM triples GROUP BY clip_id, i",
    "moved": f"SELECT clip_id, i, {_cut('start_ms', 'q.clip_id')} AS start_f, {_cut('end_ms', 'q.clip_id')} AS end_f, line, (SELECT count(*) FROM triples w WHERE w.clip_id = q.clip_id AND w.i = q.i AND NOT {_over('w.start_ms', 'w.end_ms', 'w.clip_id')}) AS outside FROM cues q WHERE {_over('start_ms', 'end_ms', 'q.clip_id')}",
    "chunk_rows": f"""SELECT clip_id, span, k + 1 AS i, length(word) AS chars, norm IN ({', '.join(repr(b) for b in BREAK_WORDS)}) AS brk, regexp_matches(word, '[,;:]$') AS comma, max(k + 1) OVER (PARTITION BY clip_id, span) AS total, idx FROM in_span""",
}


def three_word_cues(t: Tables, clips=None):
    """Cues of up to three words within spans: a plain chunking that SQL can state too. Of all clips, or of those in
    clips; the join goes down to the texts, so words of other clips are not formed."""
    return C.even_cues(t.words if clips is None else t.words.join(clips.select("clip_id").distinct(), "clip_id", "left_semi"))


def cues_in_place(t: Tables):
    """The same cues of all clips, where words lie by clip: for what groups them by clip."""
    return C.even_cues_in_place(t.words)


def parts_of(t: Tables) -> int:
    """The number of partitions that words lie in."""
    return text_parts(t.spark, t.sf_dir)


def base_cut_of(t: Tables, clips=None):
    """The base cut of all clips, or of those in clips. Lengths of clips, which two steps read, are computed once."""
    words, durations = t.words, t.durations
    if clips is not None:
        # the join goes down to the texts, so words of other clips are not formed
        only = clips.select("clip_id").distinct()
        words, durations = words.join(only, "clip_id", "left_semi"), durations.join(only, "clip_id", "left_semi")
    durations = stored(durations, "durations")
    pads = R.pad_runs(R.keep_runs(R.label_words(words)), durations)
    return L.base_cut(R.cut_pieces(pads, durations), FPS)


def stored_base_cut(t: Tables, clips=None):
    """The base cut for queries that read it several times: spans are few beside words."""
    return stored(base_cut_of(t, clips), "base")


@query(f"SELECT clip_id, idx, {_frames('start_ms')} AS start_f, {_frames('end_ms')} AS end_f FROM words")
def quantize_to_frames(t: Tables):
    return t.words.select("clip_id", "idx", to_frames(F.col("start_ms"), FPS).alias("start_f"), to_frames(F.col("end_ms"), FPS).alias("end_f"))


@query("SELECT clip_id, n, in_f, out_f, offset_f FROM base", STEPS)
def base_cut(t: Tables):
    return base_cut_of(t)


@query("SELECT d.clip_id, CASE WHEN max(out_f) IS NULL THEN 'no kept segments' ELSE 'ok' END AS status, coalesce(max(offset_f + out_f - in_f), 0) AS total_f FROM durations d LEFT JOIN base b ON b.clip_id = d.clip_id GROUP BY d.clip_id", STEPS)
def cut_status(t: Tables):
    return L.cut_status(t.durations, base_cut_of(t))


@query("SELECT clip_id, n, in_f AS src_start_f, out_f AS src_end_f, offset_f AS cut_start_f, offset_f + out_f - in_f AS cut_end_f FROM base", STEPS)
def kept_spans(t: Tables):
    return L.kept_spans(base_cut_of(t)).select("clip_id", F.inline("spans")).select("clip_id", "n", F.col("in_f").alias("src_start_f"), F.col("out_f").alias("src_end_f"), F.col("offset_f").alias("cut_start_f"), (F.col("offset_f") + F.col("out_f") - F.col("in_f")).alias("cut_end_f"))


@query(f"SELECT clip_id, idx, {_cut('start_ms', 'w.clip_id')} AS cut_f, {_over('start_ms', 'end_ms', 'w.clip_id')} AS kept FROM words w", STEPS)
def source_to_cut(t: Tables):
    rows = L.to_cut(t.words.select("clip_id", "idx", "start_ms", "end_ms"), stored_base_cut(t), FPS, "idx", parts_of(t))
    return rows.select("clip_id", "idx", F.col("start_f").alias("cut_f"), "kept")


@query("SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_f, end_f, i) - 1 AS i, start_f, end_f, line, outside = 0 AS timed FROM moved WHERE end_f - start_f >= 1", STEPS)
def remap_cues(t: Tables):
    return L.remap_cues(cues_in_place(t), stored_base_cut(t), FPS, parts_of(t)).select("clip_id", "i", "start_f", "end_f", F.array_join("words", " ").alias("line"), F.col("word_times").isNotNull().alias("timed"))


@query(f"""SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_f, end_f, i) - 1 AS i, kind, placement, start_f, end_f, CASE WHEN fade_f > 0 THEN 'fade' ELSE 'cut' END AS transition, fade_f FROM (
  SELECT *, CAST(CASE WHEN transition = 'fade' THEN least({_frames('fade_ms')}, (end_f - start_f) // 2) ELSE 0 END AS BIGINT) AS fade_f FROM (
    SELECT *, {_cut('start_ms', 'o.clip_id')} AS start_f, {_cut('end_ms', 'o.clip_id')} AS end_f FROM overlays o WHERE end_ms > start_ms AND {_over('start_ms', 'end_ms', 'o.clip_id')}) m WHERE end_f - start_f >= 1) f""", STEPS)
def remap_overlays(t: Tables):
    return L.remap_overlays(t.overlays, stored_base_cut(t, t.overlays), FPS)


@query("""SELECT clip_id, track, n AS item, offset_f AS start_f, offset_f + out_f - in_f AS end_f, in_f, out_f, true AS enabled FROM base, (VALUES ('V1'), ('A1'), ('A2')) AS v(track)
UNION ALL SELECT clip_id, 'V2', 0, 0, total_f, 0, total_f, true FROM (SELECT clip_id, max(offset_f + out_f - in_f) AS total_f FROM base GROUP BY clip_id) x WHERE clip_id IN (SELECT clip_id FROM moved WHERE end_f - start_f >= 1)
UNION ALL SELECT clip_id, 'V3', 0, 0, max(offset_f + out_f - in_f), 0, max(offset_f + out_f - in_f), false FROM base GROUP BY clip_id""", STEPS)
def timeline_events(t: Tables):
    base = stored_base_cut(t)
    return L.timeline_events(base, L.shown(three_word_cues(t), base, FPS), guide=True)


@query("SELECT clip_id, idx, span FROM spans", STEPS)
def caption_spans(t: Tables):
    return C.caption_spans(t.words).select("clip_id", "idx", "span")


@query("SELECT clip_id, idx, idx AS cue FROM words")
def single_word_cues(t: Tables):
    return C.chunk_words(t.words, 1, 1).select("clip_id", "idx", "cue")


@query("SELECT clip_id, i, start_ms, end_ms, line, n_words FROM cues", STEPS)
def words_to_cues(t: Tables):
    return three_word_cues(t).select("clip_id", "i", "start_ms", "end_ms", F.array_join("words", " ").alias("line"), F.size("words").cast("long").alias("n_words"))


#: One state for each prefix length i of a span: costs and cuts of the last four prefixes, which is as far as a cue reaches.
CHUNK_STATES = """  SELECT clip_id, span, 0 AS i, total, [CAST(0 AS DOUBLE)] AS costs, [CAST([] AS BIGINT[])] AS cuts, CAST([] AS BIGINT[]) AS chars, CAST([] AS BOOLEAN[]) AS brks, CAST([] AS BOOLEAN[]) AS commas FROM (SELECT DISTINCT clip_id, span, total FROM chunk_rows) z
  UNION ALL
  SELECT clip_id, span, i, total, list_concat(costs, [best.c])[-4:], list_concat(cuts, [best.p])[-4:], chars[-4:], brks[-5:], commas[-5:] FROM (
    SELECT *, list_reduce(options, lambda a, b: CASE WHEN b.c < a.c THEN b ELSE a END) AS best FROM (
      SELECT clip_id, span, i, total, costs, cuts, chars, brks, commas, list_filter(list_transform(range(1, least(4, i) + 1), lambda s: CASE WHEN s = 1 OR list_sum(chars[-s:]) + s - 1 <= 24 THEN struct_pack(
          c := costs[-s] + 2 + (s - 3) * (s - 3) + CASE WHEN s < 2 THEN 3 * (2 - s) ELSE 0 END + CASE WHEN s < i THEN CASE WHEN brks[-s] THEN -1.5 ELSE 0 END + CASE WHEN brks[-s - 1] THEN 2 ELSE 0 END - CASE WHEN commas[-s - 1] THEN 1 ELSE 0 END ELSE 0 END,
          p := list_append(cuts[-s], i - s)) END), lambda x: x IS NOT NULL) AS options
      FROM (SELECT d.clip_id, d.span, d.i + 1 AS i, d.total, d.costs, d.cuts, list_append(d.chars, r.chars) AS chars, list_append(d.brks, r.brk) AS brks, list_append(d.commas, r.comma) AS commas
            FROM dp d JOIN chunk_rows r ON r.clip_id = d.clip_id AND r.span = d.span AND r.i = d.i + 1) step) opts) b"""


@query("""SELECT r.clip_id, r.idx, r.i = 1 OR list_contains(cuts[-1], r.i - 1) AS starts FROM dp JOIN chunk_rows r ON r.clip_id = dp.clip_id AND r.span = dp.span WHERE dp.i = dp.total""", STEPS | {"dp": CHUNK_STATES}, recursive=True)
def chunk_words(t: Tables):
    return C.chunk_words(t.words).select("clip_id", "idx", "starts")


_TERMS = ("of", "the", "ration")


@query(f"SELECT clip_id, i, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE hit), '') AS emphasis FROM (SELECT clip_id, i, row_number() OVER (PARTITION BY clip_id, i ORDER BY idx) - 1 AS pos, lower(trim(trim(word, ' '), '.,!?;:\"'')([]')) IN ({', '.join(repr(x) for x in _TERMS)}) AS hit FROM triples) p GROUP BY clip_id, i", STEPS)
def emphasis(t: Tables):
    terms = t.documents.select(F.col("doc_id").alias("clip_id"), F.array(*map(F.lit, _TERMS)).alias("terms")).distinct()
    return C.emphasise(three_word_cues(t), terms).select("clip_id", "i", F.array_join(F.transform("emphasis", lambda x: x.cast("string")), ",").alias("emphasis"))


_FIXES = [("of the", "OF-THE"), ("the", "THE"), ("for", "4")]


def _fix_sql(text: str, key: str, right: str) -> str:
    """key as a whole word, its ends spelled out; chr(1) marks a match, so that one that shares a blank with it is found
    by the second pass."""
    one = rf"'(^|[^\p{{L}}\p{{Nd}}_]){key}($|[^\p{{L}}\p{{Nd}}_])', concat('\1', chr(1), '\2'), 'gi'"
    return f"replace(regexp_replace(regexp_replace({text}, {one}), {one}), chr(1), '{right}')"


@query(f"SELECT doc_id AS clip_id, {_fix_sql(_fix_sql(_fix_sql('text', r'of[\s\x0B]+the', 'OF-THE'), 'the', 'THE'), 'for', '4')} AS text FROM documents")
def fix_text(t: Tables):
    return t.documents.select(F.col("doc_id").alias("clip_id"), C.fix_text(F.col("text"), _FIXES).alias("text"))


# keys without overlap: the pair pass comes first, the single words after it
@query(r"""SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY idx) - 1 AS idx, CASE WHEN pair THEN 'OF-THE' WHEN norm = 'the' THEN 'THE' WHEN norm = 'for' THEN '4' ELSE word END AS word, start_ms, CASE WHEN pair THEN nxt_end ELSE end_ms END AS end_ms FROM (
  SELECT *, norm = 'of' AND coalesce(lead(norm) OVER w, '') = 'the' AS pair, norm = 'the' AND coalesce(lag(norm) OVER w, '') = 'of' AS eaten, lead(end_ms) OVER w AS nxt_end FROM words WINDOW w AS (PARTITION BY clip_id ORDER BY idx)) t WHERE NOT eaten""")
def apply_glossary(t: Tables):
    return C.apply_glossary(t.words, _FIXES).drop("norm")


@query("""SELECT identity, row_number() OVER (PARTITION BY identity ORDER BY p, o, wrong) - 1 AS ord, wrong, "right" FROM (
  SELECT identity, wrong, arg_max("right", priority * 1000000 + ord) AS "right", min(priority) AS p, arg_min(ord, priority * 1000000 + ord) AS o FROM (
    SELECT c_nationkey AS identity, 1 AS priority, c_custkey AS ord, c_mktsegment AS wrong, lower(c_mktsegment) AS "right" FROM customer UNION ALL SELECT c_nationkey, 2, c_custkey, c_mktsegment, c_name FROM customer WHERE c_custkey % 3 = 0) l GROUP BY identity, wrong) g""")
def merge_glossary_fixes(t: Tables):
    c = t.customer.select(F.col("c_nationkey").cast("long").alias("identity"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("wrong"), "c_name")
    layers = c.select("identity", F.lit(1).alias("priority"), "ord", "wrong", F.lower("wrong").alias("right")).unionByName(c.filter("ord % 3 = 0").select("identity", F.lit(2).alias("priority"), "ord", "wrong", F.col("c_name").alias("right")))
    return C.merge_fixes(layers)


@query("SELECT identity, row_number() OVER (PARTITION BY identity ORDER BY o, term) - 1 AS ord, term FROM (SELECT c_nationkey AS identity, c_mktsegment AS term, min(c_custkey) AS o FROM customer GROUP BY 1, 2) t")
def merge_glossary_terms(t: Tables):
    return C.merge_terms(t.customer.select(F.col("c_nationkey").cast("long").alias("identity"), F.lit(1).alias("priority"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("term")))


_srt = lambda x: f"concat(lpad(CAST({x} // 3600000 AS VARCHAR), 2, '0'), ':', lpad(CAST({x} // 60000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({x} // 1000 % 60 AS VARCHAR), 2, '0'), ',', lpad(CAST({x} % 1000 AS VARCHAR), 3, '0'))"


@query(f"SELECT clip_id, string_agg(concat(n, chr(10), {_srt('start_ms')}, ' --> ', {_srt('end_ms')}, chr(10), line, chr(10)), chr(10) ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms, i) AS n FROM cues) c GROUP BY clip_id", STEPS)
def write_srt(t: Tables):
    return C.srt(three_word_cues(t))


@query(f"SELECT clip_id, i, {_frames('start_ms')} AS from_f, greatest(1, {_frames('end_ms')} - {_frames('start_ms')}) AS dur_f, line AS text FROM cues", STEPS)
def caption_props(t: Tables):
    # engines differ on the capital of some letters, so the texts stay as they are
    return C.caption_props(three_word_cues(t), FPS, upper=False).select("clip_id", "i", "from_f", "dur_f", "text")


@query(f"SELECT clip_id, i, string_agg(concat(f, '+', greatest(1, {_frames('e')} - c - f)), ' ' ORDER BY idx) AS windows FROM (SELECT t.clip_id, t.i, t.idx, t.end_ms AS e, {_frames('q.start_ms')} AS c, greatest(0, {_frames('t.start_ms')} - {_frames('q.start_ms')}) AS f FROM triples t JOIN cues q ON q.clip_id = t.clip_id AND q.i = t.i) w GROUP BY clip_id, i", STEPS)
def word_windows(t: Tables):
    return C.caption_props(three_word_cues(t), FPS).select("clip_id", "i", F.array_join(F.transform("windows", lambda w: F.concat(w["from"].cast("string"), F.lit("+"), w["dur"].cast("string"))), " ").alias("windows"))


@query("""SELECT DISTINCT clip_id, i, (start_ms + end_ms) // 2 AS t_ms FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY clip_id) AS c FROM cues) q, range(5) r(j)
WHERE (c = 1 AND k = 0) OR (c > 1 AND j < least(5, c) AND k = CAST(round_even(j * (c - 1) / (least(5, c) - 1.0), 0) AS BIGINT))""", STEPS)
def preview_samples(t: Tables):
    return C.preview_samples(three_word_cues(t), 5)


_timed = f"SELECT clip_id, i, string_agg(concat(f, '+', greatest(1, {_frames('e')} - c - f)), ' ' ORDER BY idx) AS windows FROM (SELECT t.clip_id, t.i, t.idx, t.end_ms AS e, {_frames('q.start_ms')} AS c, greatest(0, {_frames('t.start_ms')} - {_frames('q.start_ms')}) AS f FROM triples t JOIN cues q ON q.clip_id = t.clip_id AND q.i = t.i) w GROUP BY clip_id, i"


@query(f"SELECT q.clip_id, count(*) AS n_cues, 100 AS safe_x, string_agg(concat_ws('|', q.i, {_frames('start_ms')}, greatest(1, {_frames('end_ms')} - {_frames('start_ms')}), line, n_words, windows, CASE WHEN q.i % 3 = 0 THEN q.i + 7 ELSE -1 END), chr(10) ORDER BY q.i) AS told FROM cues q JOIN timed_ w ON w.clip_id = q.clip_id AND w.i = q.i GROUP BY q.clip_id", STEPS | {"timed_": _timed})
def props_documents(t: Tables):
    cues = cues_in_place(t)
    long = lambda x: F.lit(x).cast("long")
    # boxes of cues come as a table, like those that dodge something
    own = stored(cues.filter("i % 3 = 0").select("clip_id", "i", (F.col("i") + 7).alias("x"), long(1).alias("y"), long(2).alias("w"), long(3).alias("h")), "boxes")
    safe = t.durations.select("clip_id", long(100).alias("x"), long(1).alias("y"), long(2).alias("w"), long(3).alias("h"))
    docs = C.props_documents(C.caption_props(cues, FPS, upper=False), safe, own, parts_of(t))
    d = F.from_json("doc", "safeBox struct<x:bigint>, cues array<struct<i:bigint,`from`:bigint,durationInFrames:bigint,text:string,words:array<string>,wordTimings:array<struct<`from`:bigint,durationInFrames:bigint>>,box:struct<x:bigint>>>")
    times = lambda q: F.array_join(F.transform(q["wordTimings"], lambda w: F.concat_ws("+", w["from"], w["durationInFrames"])), " ")
    told = F.transform(d["cues"], lambda q: F.concat_ws("|", q["i"], q["from"], q["durationInFrames"], q["text"], F.size(q["words"]), times(q), F.coalesce(q["box"]["x"], F.lit(-1))))
    return docs.select("clip_id", F.size(d["cues"]).cast("long").alias("n_cues"), d["safeBox"]["x"].alias("safe_x"), F.array_join(told, "\n").alias("told"))
