"""Repair of conversations: the cheapest edits after which roles alternate.

Every row gets a code natively: what its role begins with (s, u, a or something else) and its first fault: blank, said
before (duplicate), or truncated. A repaired conversation reads `(s?(ua)+)?` in role initials. Edits are Delete, Insert
(an empty turn), Keep and Rerole; the cheapest sequence is found by iterative-deepening A*: depth-first search in ASCII
order of the edits' initials under a growing bound on the cost, where a table keeps for each failed state (row, state of
the roles) what its failure proved it to cost at least. The first accepting path is the answer, so ties go to the least
string.

A conversation is cut into chunks of CHUNK turns, each searched in a task of its own. Between chunks only the state of
the roles passes (empty, after s, after u, after a). A chunk's table of least costs from state to state says, composed
from the last chunk backward, what each end state of a chunk still costs; the searches take that as their goal, from
every state, and one pass forward over the chunks picks the searches that join. These two passes stream one small row a
chunk. Long conversations are put in order by range partitioning, so no task holds one whole; first occurrences of a
text are found by a grouped minimum. Texts never leave the JVM for the search.

Null roles and texts are one space (so such a text is blank; such a role, or an empty one, can't be kept). Null turns come
first. Rows of one turn stand by role, then text. A null conversation is one of its own. Repeated rows are duplicates. Very long texts are taken
whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.llm.common import BLANKS, stored

CHUNK = 1024
# fixed values: costs of the edits and of a truncated turn that stays
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: States of the roles so far: empty, after s, after u, after a.
EMPTY, SYSTEM, USER, REPLY = range(4)
NEVER = 1 << 40
#: Codes: the role's initial for a sound turn, its capital for a truncated one, a digit for one that must go.
MUST_GO = {"s": "0", "u": "1", "a": "2", "x": "3"}
INITIAL = {c: r for r, d in MUST_GO.items() for c in (r, r.upper(), d)}


def _next(state: int) -> int:
    """The state after the turn of a user or assistant that may follow."""
    return REPLY if state == USER else USER


def _kept(code: str, state: int) -> int | None:
    """The state after keeping a turn, None if it can't stand there."""
    role = code.lower()
    if role == "s":
        return SYSTEM if state == EMPTY else None
    return _next(state) if role == ("a" if state == USER else "u") else None


def moves(code: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, turns taken, state after) of the edits before or on a turn, in ASCII order; None stands for the end."""
    put = ("I", INSERT, 0, _next(state))
    if code is None:
        return [put]
    if code.isdigit():
        return [("D", DELETE, 1, state), put]
    stays = TRUNCATED if code.isupper() else 0
    out = [("D", DELETE, 1, state), put]
    after = _kept(code, state)
    if after is not None:
        out.append(("K", stays, 1, after))
    return [*out, ("R", REROLE + stays, 1, _next(state))]


def _at_least(code: str) -> int:
    if code.isdigit():
        return DELETE
    return min(DELETE, (TRUNCATED if code.isupper() else 0) + (REROLE if code in "xX" else 0))


@lru_cache(maxsize=65536)
def search(codes: str, state: int, goal: tuple[int, ...], last: bool) -> tuple[int, str, int] | None:
    """(cost, letters, state after) of the cheapest edits of a chunk, entered in a state; goal is what each end state
    costs from there on. After the last chunk turns may still be inserted."""
    n = len(codes)
    rest = [0 if last else min(goal)]
    for c in reversed(codes):
        rest.append(rest[-1] + _at_least(c))
    rest.reverse()
    failed: dict[tuple[int, int], int] = {}
    bound, most = rest[0], DELETE * n + 2 * INSERT + max([g for g in goal if g < NEVER], default=0)
    while bound <= most:  # all turns deleted and two inserted reach every end that can be reached
        path: list[str] = []
        # frames: place, state, cost so far, number of the next edit, and what the rest was seen to cost at least
        frames = [[0, state, 0, 0, goal[state] if not n else NEVER]]
        while frames:
            frame = frames[-1]
            i, q, spent, k, _ = frame
            if i == n and spent + goal[q] <= bound:
                return spent + goal[q], "".join(path), q
            edits = moves(codes[i] if i < n else None, q) if i < n or last else []
            if k == len(edits):
                frames.pop()
                failed[i, q] = max(failed.get((i, q), rest[i]), frame[4])
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], spent - frames[-1][2] + failed[i, q])
                continue
            frame[3] += 1
            letter, cost, took, to = edits[k]
            need = cost + failed.get((i + took, to), rest[i + took])
            back = len(frames) > 1 and frames[-2][:2] == [i + took, to]  # two inserted turns lead back
            if spent + need > bound or back:
                frame[4] = min(frame[4], need)
            else:
                path.append(letter)
                frames.append([i + took, to, spent + cost, 0, goal[to] if i + took == n else NEVER])
        bound = max(bound + 1, failed[0, state])
    return None


def transfer(codes: str, last: bool) -> list[int]:
    """Least cost of a chunk from each state (4) to each state (4), by rows."""
    out = []
    for start in range(4):
        now = [0 if q == start else NEVER for q in range(4)]
        for code in [*codes, *([None] * last)]:
            for _ in range(2):  # turns inserted before, two at most
                for q in range(4):
                    now[_next(q)] = min(now[_next(q)], now[q] + INSERT)
            if code is None:
                continue
            new = [NEVER] * 4
            for q in range(4):
                for _, cost, took, to in moves(code, q):
                    if took:
                        new[to] = min(new[to], now[q] + cost)
            now = new
        out += now
    return out


def plan(codes: str, state: int, letters: str) -> list[tuple[int, str | None]]:
    """(place of the row, new role) of the turns that a path leaves; an inserted one has place -1, a kept one no role."""
    out, i = [], 0
    for x in letters:
        role = "assistant" if state == USER else "user"
        if x == "I":
            out.append((-1, role))
        elif x != "D":
            out.append((i, role if x == "R" else None))
        state = state if x == "D" else _kept(codes[i], state) if x == "K" else _next(state)
        i += x != "I"
    return out


# --- the conversations in Spark ------------------------------------------------------------------


def coded(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, conv_id, chunk, at, turn, role, text, fault, code): turns in order of `at` within a key and chunk."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select(key.alias("key"), "conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    long = stored(rows.groupBy("key").count().filter(F.col("count") > chunk).select("key"), "long")
    order = ["turn", "role", "text"]
    same = Window.partitionBy("key", "role", "text").orderBy("turn")
    short = rows.join(long, "key", "left_anti").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("long"))
    short = short.withColumn("chunk", F.lit(0).cast("long")).withColumn("again", F.row_number().over(same) > 1)
    # long ones: order by range, rows numbered where they then lie
    far = rows.join(long, "key", "left_semi").withColumn("__deal", F.monotonically_increasing_id())
    far = far.repartitionByRange("key", *order, "__deal").sortWithinPartitions("key", *order, "__deal").drop("__deal").withColumn("at", F.monotonically_increasing_id())
    far = stored(far, "ordered")
    first = far.groupBy("key", "role", "text").agg(F.min("at").alias("at")).select("key", "at", F.lit(False).alias("again"))
    far = far.join(first, ["key", "at"], "left").withColumn("again", F.coalesce("again", F.lit(True))).withColumn("chunk", F.expr(f"at div {chunk}"))
    every = short.unionByName(far.select(*short.columns))
    fault = F.when(~F.col("text").rlike(f"[^{BLANKS}]"), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"), "truncated")
    start = F.left("role", F.lit(1))
    start = F.when(start.isin("s", "u", "a"), start).otherwise("x")
    go = F.element_at(F.create_map(*[F.lit(x) for pair in MUST_GO.items() for x in pair]), start)
    code = F.when(F.col("fault").isin("blank", "duplicate"), go).when(F.col("fault") == "truncated", F.upper(start)).otherwise(start)
    return every.withColumn("fault", fault).withColumn("code", code).drop("again")


def _streamed(rows: DataFrame, late_first: bool, step, kind: str) -> DataFrame:
    """step(row, state) -> (value, state) over each key's chunks, last chunk first or first chunk first; the state is None
    where a key begins. One row at a time, so memory does not grow with a conversation."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            got = []
            for r in b.to_pylist():
                if r["key"] != key:
                    key, state = r["key"], None
                value, state = step(r, state)
                got.append(value)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} | v for r, v in zip(b.to_pylist(), got, strict=True)], schema)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + kind
    schema = _arrow(rows.sparkSession, kinds)
    return rows.repartition("key").sortWithinPartitions("key", F.desc("chunk") if late_first else F.asc("chunk")).mapInArrow(run, kinds)


def _arrow(spark, kinds: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], kinds).schema)


_FOUND = "array<struct<letters:string,after:int,plan:array<struct<place:int,role:string>>>>"


def solve(rows: DataFrame) -> DataFrame:
    """(key, chunk, ats, cost, illegal, letters, plan) of each chunk of coded rows, in one stored table: cost is the
    conversation's, in its first chunk (else null); ats are the numbers of the chunk's rows, which the plan's places mean."""
    one = F.array_sort(F.collect_list(F.struct("at", "code")))
    chunks = rows.groupBy("key", "chunk").agg(one.alias("x")).select("key", "chunk", F.col("x.at").alias("ats"), F.array_join("x.code", "").alias("codes"))
    w = Window.partitionBy("key").orderBy("chunk")
    chunks = chunks.withColumn("last", F.lead("chunk").over(w).isNull()).withColumn("before", F.lag(F.right("codes", F.lit(1))).over(w))

    @F.pandas_udf("array<bigint>")
    def table(codes: pd.Series, last: pd.Series, alone: pd.Series) -> pd.Series:
        return pd.Series([[] if one else transfer(c, z) for c, z, one in zip(codes, last, alone, strict=True)])

    @F.pandas_udf("bigint")
    def illegal(codes: pd.Series, before: pd.Series) -> pd.Series:
        # neighbours that are not su, ua or au
        roles = [[INITIAL[c] for c in (b or "") + x] for x, b in zip(codes, before, strict=True)]
        return pd.Series([sum(a + b not in ("su", "ua", "au") for a, b in pairwise(r)) for r in roles], dtype="int64")

    @F.pandas_udf(_FOUND)
    def searched(codes: pd.Series, goal: pd.Series, last: pd.Series, alone: pd.Series) -> pd.Series:
        out = []
        for c, g, z, one in zip(codes, goal, last, alone, strict=True):
            found = [search(c, q, tuple(int(v) for v in g), bool(z)) if q == EMPTY or not one else None for q in range(4)]
            out.append([{"letters": f[1], "after": f[2], "plan": [{"place": p, "role": r} for p, r in plan(c, q, f[1])]} if f else None for q, f in enumerate(found)])
        return pd.Series(out)

    def backward(r: dict, ahead: list[int] | None) -> tuple[dict, list[int] | None]:
        goal = ahead or [0, NEVER, NEVER, 0]
        m = r["table"]
        return {"goal": goal}, [min(min(NEVER, m[4 * q + p] + goal[p]) for p in range(4)) for q in range(4)] if m else None

    def forward(r: dict, state: int | None) -> tuple[dict, int]:
        q = EMPTY if state is None else state
        found = r["found"][q]
        return {"letters": found["letters"], "plan": found["plan"], "first": state is None}, found["after"]

    alone = F.col("last") & F.col("before").isNull()  # a conversation of one chunk, which is the rule
    told = chunks.withColumn("alone", alone).withColumn("table", table("codes", "last", "alone")).withColumn("illegal", illegal("codes", "before")).drop("before")
    told = _streamed(told, True, backward, "goal array<bigint>").drop("table").withColumn("found", searched("codes", "goal", "last", "alone"))
    told = _streamed(told.drop("goal", "last", "alone"), False, forward, "letters string, plan array<struct<place:int,role:string>>, first boolean")
    return stored(told.select("key", "chunk", "ats", "codes", "illegal", "letters", "plan"), "solved")


def repair(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repaired turns, a report and the edits of conversations (conv_id, turn, role, text; others are ignored).

    Turns: (key, chunk, pos, role, text) in order of chunk and pos. Report: (key, gaps, blank, duplicate, truncated,
    illegal, cost). Edits: (key, chunk, letters), whose letters in order of chunk are the edits' initials. key is `=` and
    conv_id, or empty for the null conversation.
    """
    rows = stored(coded(turns, chunk), "coded")
    solved = solve(rows)
    out = solved.select("key", "chunk", "ats", F.posexplode("plan").alias("pos", "p"))
    out = out.select("key", "chunk", "pos", F.when(F.col("p.place") >= 0, F.get("ats", F.col("p.place"))).alias("at"), F.col("p.role").alias("new"))
    said = rows.select("key", "chunk", "at", "role", "text")
    fixed = out.join(said, ["key", "chunk", "at"], "left").select("key", "chunk", "pos", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    faults = rows.groupBy("key").agg(gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    price = F.create_map(*[F.lit(x) for p in (("D", DELETE), ("I", INSERT), ("K", 0), ("R", REROLE)) for x in p])
    edits = F.aggregate(F.split("letters", ""), F.lit(0), lambda s, x: s + F.coalesce(F.element_at(price, x), F.lit(0)))
    stay = F.size(F.filter("plan", lambda p: (p["place"] >= 0) & F.substring("codes", p["place"] + 1, F.lit(1)).rlike("[A-Z]")))
    sums = solved.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum(edits + TRUNCATED * stay).cast("long").alias("cost"))
    return fixed, faults.join(sums, "key"), solved.select("key", "chunk", "letters")


# --- damage for the query ------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """Turns damaged by crc32(`conv_id:turn`) % 20 (nulls are one space): 0 drops a row, 1 empties its text, 2 takes its
    `[.!?]` away, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = turns.filter(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(k == 3, 2).otherwise(1).alias("__times"))
    return rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__k", "__times")


def digests(fixed: DataFrame) -> DataFrame:
    """(key, sha256): the digest of each conversation's repaired `role:text`, joined by newlines, over the ordered stream."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["key", "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "sha256"])

    return fixed.repartition("key").sortWithinPartitions("key", "chunk", "pos").select("key", "role", "text").mapInArrow(run, "key string, sha256 string")
