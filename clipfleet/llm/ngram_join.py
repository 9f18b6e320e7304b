"""Exact Jaccard self-join of documents on word n-grams, by prefix filters under several global token orders.

Method
 1. Each document becomes a sorted set of 64-bit shingle hashes. Documents with equal sets form a class; its smallest
    id stands for it.
 2. Three global token orders. A: the tokens of a part of the hash space first (a fifth for t = 0.9), by their exact document
    frequency, then the others by hash. B and C: by two other hashes. Two sets with Jaccard >= t share a token among their first
    n - ceil(t n) + 1 tokens under *every* order. For A only that part of the tokens is counted and shuffled; tokens of
    one document come first and match nothing, so a document whose prefix is full of them has no partner and is done.
 3. Tokens of the A prefix that two or more classes share make candidates; they must share B and C prefix tokens too
    (intersection of the filters) and fit in length before their whole sets are compared.
 4. Groups never expand into all pairs. Every posting list compares its members with one pivot p, and components merge.
    Two members whose labels still differ cannot both have the pivot's; one that has not, x, is farther from p than a
    link allows, |x ^ p| > c (|x| + |p|) with c = (1 - t) / (1 + t), and a link of x and y needs
    |x ^ y| <= c (|x| + |y|), so their differences from p share more than (|y ^ p| + c (|p| - |y|)) / 2 tokens: over
    about half of y's. Hence x and y meet on one of the rarest |y ^ p| - that many tokens of y's difference. Tokens that
    stand before the first common one in either difference belong to x ^ y, so together they are c (|x| + |y|) or
    fewer: only so many of a difference's rarest tokens are posted, few as they are beside a long difference. These
    lists (one for all tokens that the same members hold) are treated like the first ones: where the pairs are SMALL a member or fewer, they are compared
    directly; another takes the member nearest to the pivot as its own pivot, and so on until no list holds two labels. A list
    lacks its group's pivot, so it is smaller; lists of the same members, or of one group with the same most listed member, are one. Each pass costs its postings only, and
    no link is lost.

Long-lived results are written to the shared folder; the graph part uses `common.connected_components`.

Null or blank texts have no shingles and link with nothing. Rows with a null id get n_shingles and a null component.
Rows that share an id count as one document in the graph. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.llm.common import connected_components, id_filter, join_hot, passes, rounds, salted, stored

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SMALL = 8


def _counted(percent: int) -> int:
    """Tokens below it are counted for order A: twice the share of tokens in a prefix, so that a prefix is mostly found
    among tokens of one document."""
    return min((1 << 64) - 1, (1 << 64) * 2 * (100 - percent) // 100)


def _late(percent: int):
    """Whether the signed token t is not below _counted(percent) as an unsigned number."""
    c = _counted(percent)
    return F.expr(f"t < 0 OR t >= {c}" if c < 1 << 63 else f"t < 0 AND t >= {c - (1 << 64)}")



class _Words(dict):
    """64-bit hashes of words, kept in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z in lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    if len(_WORDS) > 700_000:
        _WORDS.clear()
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - width + 1
    h = w[:n] * _M1
    for k in range(1, width):
        h ^= h >> np.uint64(31)
        h += w[k : n + k]
        h *= _M2 if k % 2 else _M3
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, sig) of each row; sig is a 128-bit hash of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig = [], []
            for t in b.column(1):
                s = shingles(t.as_py(), width)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.record_batch({"doc_id": b.column(0), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, sig binary")


def _tokens(docs: DataFrame, keep: tuple[int, np.ndarray], width: int, percent: int) -> DataFrame:
    """(id, n, p, tokens) of documents that pass the filter: the counted tokens, or the first p if those are fewer."""
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 512):
                out = {"id": [], "n": [], "p": [], "tokens": []}
                for i in lo + np.flatnonzero(passes(ids[lo : lo + 512], *shared.value)):
                    s = shingles(b.column(1)[int(i)].as_py(), width)
                    if len(s):
                        p = _prefix_length(len(s), percent)
                        for k, v in (("id", int(ids[i])), ("n", len(s)), ("p", p), ("tokens", s[: max(p, int(np.searchsorted(s, np.uint64(_counted(percent)))))].view(np.int64))):
                            out[k].append(v)
                yield pa.record_batch({"id": pa.array(out["id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "p": pa.array(out["p"], pa.int64()), "tokens": pa.array(out["tokens"], pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "id long, n long, p long, tokens array<long>")


def _sets(docs: DataFrame, keep: tuple[int, np.ndarray], width: int, percent: int) -> DataFrame:
    """(id, b, c, items): prefixes under orders B and C, as 32-bit values (which only adds candidates), and the set."""
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 256):
                some = lo + np.flatnonzero(passes(ids[lo : lo + 256], *shared.value))
                sets = [shingles(batch.column(1)[int(i)].as_py(), width) for i in some]
                first = lambda m: pa.array([(np.sort(s * m)[: _prefix_length(len(s), percent)] >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets], pa.list_(pa.int32()))  # noqa: E731, B023
                yield pa.record_batch({"id": pa.array(ids[some], pa.int64()), "b": first(_M2), "c": first(_M3), "items": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "id long, b array<int>, c array<int>, items array<long>")


def _postings(tokens: DataFrame, percent: int) -> DataFrame:
    """(t, id, n, k): prefix tokens under order A that two or more documents have in their prefixes."""
    each = tokens.select(F.explode("tokens").alias("t"), "id")
    df = each.groupBy("t").agg(F.count("*").alias("k")).filter("k > 1")
    total = tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0
    met = join_hot(each, df, "t", "k", int(total), "inner", keep=True).groupBy("id").agg(F.collect_list(F.struct(_late(percent).alias("late"), "k", "t")).alias("met"))
    own = met.join(tokens.select("id", "n", "p", F.size("tokens").alias("e")), "id")
    need = F.col("p") - (F.col("e") - F.size("met"))  # what tokens of one document leave of the prefix
    first = own.filter(need > 0).select("id", "n", F.explode(F.slice(F.sort_array("met"), 1, need.cast("int"))).alias("x")).select("x.t", "id", "n")
    first = stored(first, "prefixes")
    return join_hot(first, first.groupBy("t").agg(F.count("*").alias("k")).filter("k > 1"), "t", "k", first.count(), "inner", keep=True)


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; sets link when 100 |A and B| >= percent |A or B|."""
    with rounds(docs.sparkSession):
        return stored(_components(docs, percent, width, id_col, text_col), "near", outlives=True)


def _components(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    info = stored(_signatures(docs, width), "shingles")
    classes = stored(info.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    named = docs.filter("doc_id IS NOT NULL")
    keep, dense = id_filter(classes, "rep")
    tokens = _tokens(named, keep, width, percent)
    if dense:  # many others pass the bits then
        tokens = tokens.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    tokens = stored(tokens, "tokens")

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    jaccard = lambda x, y: F.size(F.array_intersect(x, y)) * (100 + percent) >= percent * (F.size(x) + F.size(y))
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()

    now = stored(_postings(tokens, percent), "postings")
    score = now.groupBy("id").agg(F.sum("k").alias("score"))
    now = now.drop("k").join(score, "id")
    near = score.select("id")
    sets = stored(_sets(named, id_filter(near, "id")[0], width, percent).join(near, "id", "left_semi"), "sets")
    now = stored(now, "lists")
    pivot = now.groupBy("t").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"), F.col("n").alias("pn"))).alias("p"), F.count("*").alias("k")).select("t", (-F.col("p.minus")).alias("pid"), "p.pn", "k")
    met = stored(join_hot(now, pivot, "t", "k", now.count(), "inner").filter("id != pid").select("t", "id", "n", "pid", "pn"), "met")
    labels = connected_components(_verified(ordered(met.filter(fits(F.col("n"), F.col("pn"))), "id", "pid"), sets, jaccard))
    left = _labelled(met, labels, "id", "lab")
    mixed = left.groupBy("t").agg(F.min("lab").alias("l0"), F.max("lab").alias("l1"), F.count("*").alias("k")).filter("l0 < l1").select("t", "k")
    left = stored(join_hot(left, mixed, "t", "k", left.count(), "inner", keep=True), "left")
    few = left.filter(F.col("k") <= SMALL).select("t", "id", "n", "lab")
    other = few.select("t", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("lab").alias("lab2"))
    pairs = stored(ordered(few.join(other, "t").filter((F.col("id") < F.col("id2")) & (F.col("lab") != F.col("lab2")) & fits(F.col("n"), F.col("n2"))), "id", "id2"), "pairs")
    groups = stored(left.filter(F.col("k") > SMALL).select(F.col("pid").alias("gid"), "pid", "pn", "id", "n").distinct(), "groups")
    labels = _merged(labels, _verified(pairs, sets, jaccard))
    while True:
        groups, pivots = salted(_labelled(groups, labels, "id", "lab"), _labelled(groups.select("pid").distinct(), labels, "pid", "plab"), "pid", "id")
        groups = stored(groups.join(pivots, ["pid", "salt"]), "groups")
        mixed = groups.filter("lab != plab").select("gid").distinct()
        groups = stored(groups.join(mixed, "gid", "left_semi"), "groups")
        if groups.isEmpty():
            break
        lists = _by_difference(groups, sets, percent)
        few = lists.filter("few")
        one = few.filter("far").select("gid", "t", "id", "n", "lab", "over")
        two = few.filter("first").select("gid", "t", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("lab").alias("lab2"), F.col("over").alias("over2"))
        pairs = ordered(one.join(two, ["gid", "t"]).filter((F.col("over") + F.col("over2") <= 0) & (F.col("id") != F.col("id2")) & (F.col("lab") != F.col("lab2")) & fits(F.col("n"), F.col("n2"))), "id", "id2")
        groups = stored(_next_groups(lists.filter("NOT few")), "groups")
        to_pivot = ordered(groups.filter((F.col("lab") != F.col("plab")) & fits(F.col("n"), F.col("pn"))), "id", "pid")
        pairs = stored(pairs.union(to_pivot).distinct(), "pairs")
        labels = _merged(labels, _verified(pairs, sets, jaccard))
        groups = groups.select("gid", "pid", "pn", "id", "n")
    # one row for each class; a class with a large share of all rows is not sent to one task
    named_classes = classes.select("sig", "copies", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("sig", "copies", F.coalesce("component", "rep").alias("component"))
    found = join_hot(info, named_classes, "sig", "copies", info.count())
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the component of `key`, which is its own one without links."""
    return rows.join(labels.select(F.col("id").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, component) after further edges (a, b); components are merged as wholes."""
    e = _labelled(_labelled(edges, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = connected_components(e)
    if roots.isEmpty():
        return labels
    old = labels.join(roots.select(F.col("id").alias("component"), F.col("component").alias("new")), "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    return stored(old.union(roots.join(labels, "id", "left_anti").select("id", "component")), "labels")


def _verified(pairs: DataFrame, sets: DataFrame, jaccard) -> DataFrame:
    """Pairs (x, y) that pass the filters of orders B and C and then the comparison of their whole sets, as (a, b)."""
    side = lambda df, k: df.select(*[F.col(c).alias(c + k) for c in df.columns])
    o, s = sets.select("id", "b", "c"), sets.select("id", "items")
    both = pairs.join(side(o, "1"), F.col("x") == F.col("id1")).join(side(o, "2"), (F.col("y") == F.col("id2")) & F.arrays_overlap("b1", "b2") & F.arrays_overlap("c1", "c2"))
    both = both.select("x", "y").join(side(s, "1"), F.col("x") == F.col("id1")).join(side(s, "2"), (F.col("y") == F.col("id2")) & jaccard(F.col("items1"), F.col("items2")))
    return both.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _by_difference(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(gid, t, id, n, lab, d, far, at, first, over, few): members of groups on tokens of their differences from
    the pivot, in lists where a member of another label than the pivot's (far) can meet one that looks for partners there (first).
    groups: gid, pid, pn, id, n, lab, plab. d is a difference's length, `at` the place in it of a class of tokens, t; few says
    that far and first members make SMALL pairs a member or fewer."""
    mine, pivots = sets.select("id", "items"), sets.select(F.col("id").alias("pid"), F.col("items").alias("pitems"))
    groups, pivots = salted(groups.drop("salt"), pivots, "pid", "id")
    diff = groups.join(mine, "id").join(pivots, ["pid", "salt"]).withColumn("diff", F.concat(F.array_except("items", "pitems"), F.array_except("pitems", "items"))).drop("items", "pitems")
    d = F.size("diff")
    least_shared = F.floor(((100 + percent) * d + (100 - percent) * (F.col("pn") - F.col("n"))) / (2.0 * (100 + percent))) + 1  # more than that many
    diff = stored(diff.select("gid", "id", "n", "lab", d.alias("d"), (F.col("lab") != F.col("plab")).alias("far"), (d - least_shared + 1).alias("need"), "diff"), "differences")
    each = diff.select("gid", "id", F.explode("diff").alias("token"))
    # tokens that the same members hold are one class t: they stand together in every order, and members meet its least token only
    holders = F.sum(F.xxhash64("id").cast("decimal(20,0)")).cast("string")
    df = each.groupBy("gid", "token").agg(F.count("*").alias("k"), F.xxhash64(holders).alias("t")).filter("k > 1")
    classes = df.groupBy("gid", "k", "t").agg(F.min("token").alias("token"), F.count("*").alias("size"))
    # tokens of one member come first in its order and match nothing
    own = Window.partitionBy("gid", "id")
    before = F.sum("size").over(own.orderBy("k", "t").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    met = each.join(classes, ["gid", "token"]).select("gid", "id", "t", (before - F.sum("size").over(own)).alias("place"))
    rows = met.join(diff.drop("diff"), ["gid", "id"]).withColumn("at", (F.col("d") + F.col("place")).cast("int")).filter(percent * F.col("at") <= (100 - percent) * F.col("n"))
    rows = rows.select("gid", "t", "id", "n", "lab", "d", "far", "at", (F.col("at") < F.col("need")).alias("first"))
    rows = stored(rows.filter("far OR first"), "shared")
    # what stands before a first common token belongs to one of the two only: over(x) + over(y) <= 0 for a link
    rows = rows.withColumn("over", (100 + percent) * F.col("at") - (100 - percent) * F.col("n"))
    least = lambda c: F.min(F.when(F.col(c), F.col("over")))
    low = rows.groupBy("gid", "t").agg(least("far").alias("f"), least("first").alias("p")).filter("f + p <= 0")
    rows = rows.join(low, ["gid", "t"]).filter("(far AND over + p <= 0) OR (first AND over + f <= 0)").drop("f", "p")
    n_of = lambda c: F.sum(F.expr(c).cast("long"))
    kept = rows.groupBy("gid", "t").agg(F.count("*").alias("k"), n_of("far").alias("f"), n_of("first").alias("p"), n_of("over <= 0").alias("low"), F.min("lab").alias("l0"), F.max("lab").alias("l1")).filter("f > 0 AND p > 0 AND l0 < l1")
    few = (F.col("f") * F.col("p") <= SMALL * F.col("k")) | (F.col("low") <= SMALL)
    return stored(rows.join(kept.select("gid", "t", few.alias("few")), ["gid", "t"]), "meetings")


def _next_groups(lists: DataFrame) -> DataFrame:
    """(gid, pid, pn, plab, id, n, lab): the lists as groups of their own, each about its member nearest to the old pivot.

    Lists of one group that share the member which is on most of the group's lists are one group: where lists lie within
    one another, as those of ever shorter copies do, a member would else be on as many lists as others are shorter."""
    most = lists.groupBy("gid", "id").agg(F.count("*").alias("on"))
    hubs = lists.join(most, ["gid", "id"]).groupBy("gid", "t").agg(F.max(F.struct("on", (-F.col("id")).alias("minus"))).alias("h")).select("gid", "t", F.col("h.minus").alias("hub"))
    rows = stored(lists.join(hubs, ["gid", "t"]).select("gid", "hub", "id", "n", "lab", "d").distinct(), "unions")
    heads = rows.groupBy("gid", "hub").agg(F.min(F.struct("d", "n", "id", "lab")).alias("p"), F.count("*").alias("k"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).cast("string").alias("members"))
    heads = heads.groupBy("k", "members").agg(F.min(F.struct("p", "gid", "hub")).alias("h"))  # groups of the same members are one
    heads = heads.select("h.gid", "h.hub", F.xxhash64("k", "members").alias("next"), F.col("h.p.id").alias("pid"), F.col("h.p.n").alias("pn"), F.col("h.p.lab").alias("plab"))
    rows = rows.join(heads, ["gid", "hub"]).filter("id != pid")
    return rows.select(F.col("next").alias("gid"), "pid", "pn", "plab", "id", "n", "lab")


def keep_one(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """The rows of docs without near copies: of each component the smallest id stays.

    Rows that have no id, or no words, all stay, and so do rows that repeat the id that stays.
    """
    found = jaccard_components(docs, percent, width).filter("n_shingles > 0 AND doc_id IS NOT NULL")
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
