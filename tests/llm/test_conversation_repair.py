"""Repair of conversations against an exhaustive search, cut into chunks of any size, and its edge cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clipfleet.llm import conversation_repair as R
from clipfleet.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, chunk string, at string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, letters, repaired turns) by trying every sequence of edits, cheapest and least first."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, letters, i, roles, out = heapq.heappop(todo)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, list(out)
        if (cost, letters) in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add((cost, letters))
        for role in ("user", "assistant"):
            if len(letters) < 2 * len(rows) + 4:
                heapq.heappush(todo, (cost + 3, letters + "I", i, roles + role[0], (*out, f"{role}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(todo, (cost + 4, letters + "D", i + 1, roles, out))
        if fault not in ("blank", "duplicate"):
            late = 3 * (fault == "truncated")
            heapq.heappush(todo, (cost + late, letters + "K", i + 1, roles + (role[:1] or "?"), (*out, f"{role}:{text}")))
            for new in ("user", "assistant"):
                heapq.heappush(todo, (cost + 3 + late, letters + "R", i + 1, roles + new[0], (*out, f"{new}:{text}")))
    return None


def judged(turns):
    """The rows of one conversation with faults, and what its report says; turns are (turn, role, text)."""
    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    rows, seen, count = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        last = WORD.findall(text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
        if fault:
            count[fault] += 1
    at = [t for t, _, _ in turns if t is not None]
    count["gaps"] = max(at) - min(at) + 1 - len(set(at)) if at else 0
    count["illegal"] = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return rows, count


def draw(rng, n, conv):
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None], ["a.", "b?", "c!  \n", "d", "e", "", "  \t", None, ".", "f…"]
    return [(conv, rng.choice([None, k, k, k, k + 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"text {rng.randint(0, 99)}.", "k", "c", "a") for k in range(n)]


@pytest.mark.parametrize("chunk", [2, 1024])
def test_repairs_match_exhaustive_search(spark, chunk):
    rng = random.Random(chunk)
    rows = [r for conv in [None, *range(60)] for r in draw(rng, rng.choice([0, 1, 2, 4, 7]), conv)]
    fixed, report, edits = R.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk)
    letters, turns = {}, {}
    for r in sorted(edits.collect(), key=lambda r: (r.key, r.chunk)):
        letters[r.key] = letters.get(r.key, "") + r.letters
    for r in sorted(fixed.collect(), key=lambda r: (r.key, r.chunk, r.pos)):
        turns.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    shas = {r.key: r.sha256 for r in R.digests(fixed).collect()}
    told = {r.key: r.asDict() for r in report.collect()}
    want = {}
    for conv, turn, role, text, *_ in rows:
        want.setdefault("" if conv is None else f"={conv}", []).append((turn, role, text))
    assert set(told) == set(want) == set(letters)
    for key, given in want.items():
        found, count = judged(given)
        cost, path, out = cheapest(found)
        assert (told[key]["cost"], letters[key], turns.get(key, [])) == (cost, path, out), found
        assert {k: told[key][k] for k in count} == count
        assert shas.get(key, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_the_table_of_costs(seed):
    rng = random.Random(seed)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUAX012") for _ in range(rng.randint(0, 40)))
        goal = tuple(rng.choice([0, 2, 5, 9, R.NEVER]) for _ in range(4))
        table = R.transfer(codes, False)
        for q in range(4):
            got = R.search(codes, q, goal, False)
            least = min(table[4 * q + p] + goal[p] for p in range(4))
            assert (got[0] if got else R.NEVER) == min(least, R.NEVER)


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant"]), rng.choice(["yes.", f"turn {k}.", f"cut {k}", ""]), "k", "c", "a") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = []
    for chunk in (64, 100_000):
        fixed, report, edits = R.repair(df, chunk)
        assert (edits.count() > 1) == (chunk == 64)
        out.append((report.first().cost, "".join(r.letters for r in edits.orderBy("chunk").collect()), R.digests(fixed).first().sha256))
    assert out[0] == out[1]


def test_repair_of_nothing(spark):
    fixed, report, edits = R.repair(spark.createDataFrame([], SCHEMA))
    assert fixed.count() == report.count() == edits.count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three") for c in [None, *range(40)] for t in (None, 0, 1)]
    got = list((("" if r.conv_id is None else r.conv_id), r.turn or -1, r.role, r.text) for r in R.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.turn != 0)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k and t != 0:
            want += [("" if c is None else c, t or -1, "user" if k == 4 else role, "" if k == 1 else "One Two Three" if k == 2 else text)] * (2 if k == 3 else 1)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_query_keeps_every_conversation(spark, sf_dir):
    got = QUERIES["op11_conversation_repair"](spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    assert got.select("conv_id").exceptAll(ids).count() == 0 and got.count() == ids.count()
    assert got.filter(F.col("audit").rlike("^K*$") != (F.col("cost") == 0)).filter("truncated = 0").count() == 0
