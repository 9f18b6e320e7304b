"""Joins, scans and zones in the forms that large inputs need, against brute force on small ones."""

from __future__ import annotations

import math
import random

import pytest

from clipfleet.operators import intervals, qc, roughcut, timeline, tracks, zones


def test_intervals_of_any_length_meet_once(spark):
    rng, day = random.Random(1), 86_400_000
    draw = lambda n: [(k % 3, k, a := rng.randrange(day), a + rng.choice([-5, 0, 1, 500, 8191, 8192, 60_000, 5_000_000, day])) for k in range(n)]
    left, right = draw(150), draw(150)
    a = spark.createDataFrame(left, "clip_id long, a long, ls long, le long")
    b = spark.createDataFrame(right, "clip_id long, b long, rs long, re long")
    got = sorted((r.a, r.b) for r in intervals.join_intervals(a, b, "ls", "le", "rs", "re").collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert intervals.nodes(a, "ls", "le").groupBy("a").count().filter("count > 2").count() == 0  # also those of a day


def test_long_clips_are_scanned_by_ranges(spark):
    rng = random.Random(2)
    marks = [(c, t, f"m{t}") for c in (1, 2) for t in rng.sample(range(0, 50_000, 7), 60)]
    points = [(c, rng.randrange(-10, 60_000)) for c in (1, 2, 3) for _ in range(200)]
    p, m = spark.createDataFrame(points, "clip_id long, t long"), spark.createDataFrame(marks, "clip_id long, at long, name string")
    got = sorted((r.clip_id, r.t, r.mark.name if r.mark else "") for r in intervals.as_of(p, m, "t", "at", width=900).collect())
    last = lambda c, t: max(((a, n) for x, a, n in marks if x == c and a <= t), default=(0, ""))[1]
    assert got == sorted((c, t, last(c, t)) for c, t in points)


def test_cut_time_does_not_depend_on_the_ranges(spark):
    rng, rows = random.Random(3), []
    for clip in (1, 2):
        at = 0
        for k in range(80):
            end = at + rng.choice([10, 400, 3000])
            rows.append((clip, k, at, end + rng.choice([0, 0, 300]), rng.random() < 0.6))
            at = end
    base = timeline.base_cut(spark.createDataFrame(rows, "clip_id long, i long, start_ms long, end_ms long, keep boolean"), 30)
    times = spark.createDataFrame([(c, rng.randrange(0, 200_000)) for c in (1, 2, 3) for _ in range(300)], "clip_id long, ms long")
    one, many = (sorted(map(str, timeline.in_cut(times, base, 30, width).collect())) for width in (10**9, 700))
    assert one == many


@pytest.mark.parametrize("seed", [4, 5])
def test_zones_of_overlapping_bands(spark, seed):
    rng = random.Random(seed)
    rect = lambda: (a := rng.randrange(30), b := rng.randrange(30), a + rng.choice([0, 1, 9, 20]), b + rng.choice([0, 1, 9, 20]))
    bands = [(z, *rect()) for z in ("a", "b") for _ in range(7)]
    bands += bands[:2]
    notches = [("a", *rect()), ("b", *rect())]
    elements = [(k, rng.choice("abc"), *rect()) for k in range(200)]
    names = "x0 long, y0 long, x1 long, y1 long"
    b, n = spark.createDataFrame(bands, f"zone string, {names}"), spark.createDataFrame(notches, f"zone string, {names}")
    e = spark.createDataFrame(elements, f"k long, zone string, {names}")
    cells = {z: {(x, y) for q, x0, y0, x1, y1 in bands if q == z for x in range(x0, x1) for y in range(y0, y1)} for z in "abc"}
    told = {r.k: (r.danger_ppm, r.hits_notch) for r in qc.danger(e, b, n).collect()}
    clear = {r.k: r.clear for r in zones.zone_clears(e, b, ["k"]).collect()}
    inside = sorted(r.k for r in zones.zone_contains(e.selectExpr("k", "zone", "x0 x", "y0 y"), b).collect())
    assert zones.zone_slabs(b).selectExpr("sum((sx1 - sx0) * (sy1 - sy0)) AS a").first().a == len(cells["a"]) + len(cells["b"])
    assert inside == [k for k, z, x, y, *_ in elements if (x, y) in cells[z]]
    for k, z, x0, y0, x1, y1 in elements:
        own = {(x, y) for x in range(x0, x1) for y in range(y0, y1)}
        hit = any(q == z and max(x0, a) < min(x1, c) and max(y0, d) < min(y1, f) for q, a, d, c, f in notches)
        assert told[k] == ((1_000_000 - len(own & cells[z]) * 1_000_000 // len(own), hit) if own else (0, False))
        assert clear[k] == all(any(q == z and b0 <= y < b1 and a0 <= x0 and x1 <= a1 for q, a0, b0, a1, b1 in bands) for y in range(y0, y1))


def plain_smooth(values, keep, limit):
    out = [float(x) for x in values]
    for order in (range(1, len(out)), range(len(out) - 2, -1, -1)):
        for i in order:
            j = i - order.step
            out[i] = keep * out[j] + (1 - keep) * out[i]
    for order in (range(1, len(out)), range(len(out) - 2, -1, -1)):
        for i in order:
            j = i - order.step
            out[i] = min(max(out[i], out[j] - limit), out[j] + limit)
    return out


def plain_keys(t, v, tolerance):
    keep, todo = {0, len(t) - 1}, [(0, len(t) - 1)]
    while todo:
        a, b = todo.pop()
        gaps = [(abs(v[i] - (v[a] + (v[b] - v[a]) * (t[i] - t[a]) / (t[b] - t[a]))), -i) for i in range(a + 1, b)]
        if gaps and max(gaps)[0] > tolerance:
            k = -max(gaps)[1]
            keep.add(k)
            todo += [(a, k), (k, b)]
    return keep


@pytest.mark.parametrize("chunk", [7, 64])
def test_tracks_are_smoothed_and_split_alike_in_chunks(spark, chunk):
    rng, rows, want = random.Random(chunk), [], {}
    for clip, n in enumerate((1, 2, 7, 300, 90)):
        for axis in "xy":
            at, raw = 500.0, []
            for _ in range(n):
                at = rng.choice([at, at + rng.uniform(-30, 30), rng.uniform(0, 1920)])
                raw.append(at)
            rows += [(clip, axis, g, g * 1000 / 15, x, 1920) for g, x in enumerate(raw)]
            v = plain_smooth(raw, math.exp(-1 / 15 / 0.6), 0.12 * 1920 / 15)
            want[clip, axis] = v, plain_keys([g * 1000 / 15 for g in range(n)], v, 3.0)
    df = spark.createDataFrame(rows, "clip_id long, axis string, g long, t_ms double, raw double, side long")
    got = {}
    for r in tracks.simplify(tracks.smooth(df, chunk=chunk)).orderBy("g").collect():
        got.setdefault((r.clip_id, r.axis), []).append((r.v, r.key))
    for k, (v, keys) in want.items():
        assert [x for x, _ in got[k]] == pytest.approx(v, abs=1e-9)
        assert {i for i, (_, key) in enumerate(got[k]) if key} == keys
        steps = [abs(b - a) for a, b in zip(v, v[1:], strict=False)]
        assert max(steps, default=0) <= 15.36 + 1e-9


def test_phrases_are_found_from_their_rarest_token(spark):
    w = spark.createDataFrame([(c, k, x) for c, text in enumerate(["a b c d e b c d a b x c d e", "e d c b a"]) for k, x in enumerate(text.split())], "clip_id long, idx long, norm string")
    phrases = ["a b c d e", "b c d", "c d", "e", "a b", "d e b c", "zz a", "b x c d e", "c d a", ""]
    q = roughcut.query_tokens(spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string"))
    got = sorted(map(tuple, roughcut.exact_places(w, q).collect()))
    want = []
    for n, p in enumerate(phrases):
        for c, text in enumerate(["a b c d e b c d a b x c d e", "e d c b a"]):
            t, m = text.split(), len(p.split())
            i = next((i for i in range(len(t) - m + 1) if m and t[i : i + m] == p.split()), None)
            if i is not None:
                want.append((n, c, i, i + m - 1))
    assert got == sorted(want)


@pytest.mark.parametrize("strip", [1, 4, 256])
def test_components_by_strips(spark, strip):
    rng, rows = random.Random(strip), []
    cells = {m: {(x, y) for x in range(14) for y in range(40) if rng.random() < 0.62} for m in range(3)}
    # a spiral: one component that turns round itself
    cells[3] = {(x, y) for k in range(0, 20, 4) for x in range(k, 40 - k) for y in range(k, 40 - k) if (x in (k, 39 - k) or y in (k, 39 - k)) and (x, y) != (k, k + 1)} | {(k + i, k + 2) for k in range(0, 16, 4) for i in (1, 2, 3)}
    for m, own in cells.items():
        for x, y in own:
            if (x - 1, y) not in own:
                end = x
                while (end, y) in own:
                    end += 1
                rows.append((m, y, x, end))
    got = {(r.mask_id, r.y, r.x0): r.lab for r in zones.component_labels(spark.createDataFrame(rows, "mask_id long, y long, x0 long, x1 long"), strip, fan=2).collect()}
    assert len(got) == len(rows)
    for m, own in cells.items():
        seen, parts = set(), {}
        for c in sorted(own):
            todo = [c] if c not in seen else []
            while todo:
                x, y = todo.pop()
                if (x, y) in own and (x, y) not in seen:
                    seen.add((x, y))
                    parts[x, y] = c
                    todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        pairs = {(parts[x, y], got[m, y, x]) for q, y, x, _ in rows if q == m}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_scratch_tables_go_with_their_block(spark, sf_dir):
    import glob

    from clipfleet.plans import registry
    from clipfleet.sources.scratch import rounds, scratch_root, stored

    folder = scratch_root(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    with rounds(spark):
        for name in ("main_component", "smooth_tracks"):
            assert registry.QUERIES[name](spark, sf_dir).count()
        assert set(glob.glob(f"{folder}/*")) > before
    assert set(glob.glob(f"{folder}/*")) == before
    with pytest.raises(ZeroDivisionError), rounds(spark):
        stored(spark.range(3), "gone")
        raise ZeroDivisionError
    assert set(glob.glob(f"{folder}/*")) == before
