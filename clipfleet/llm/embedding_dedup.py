"""Near-duplicate vectors by an inverted multi-index.

Index: each half of a unit vector has a codebook of its own (k-means on a sample of at most SAMPLE vectors, chosen by
hash; the bound is a parameter), and the product grid has codebook^2 cells; codebooks grow with the table. Every vector is indexed in the cell of its
nearest pair of codewords.

Search: for each query and half, codeword i has a lower bound of the distance to any vector of its region, from the
hyperplanes between i and the other codewords. Multi-sequence traversal visits cells (i, j) in ascending order of the
sum of squared bounds. Vectors with cosine >= c are within the squared distance 2 - 2c, so cells beyond it cannot hold
a link, and stopping there finds every link. With target_recall < 1 it stops earlier, where that mean recall over
QUERIES vectors, chosen by hash and compared with all others by brute force, is reached; each vector with links weighs
the same, and where fewer than LEAST_LINKED have any, it stops at the bound.

Blocks: the cells of a label, in order, are dealt to blocks of about the same size; a large cell spans several. The
search runs over parts of a label beside the block ranges of its cells and returns blocks, never cells: each vector
carries one number for each block that it asks. It ends early once no block is left to ask. As links are symmetric, a
query asks only blocks from its own on. Vectors of a cell or label with very many meet its row by broadcast.

Verification: every (asking block, asked block) is one small group in which all cosines are computed in double
precision. A group returns, for each vector, the number of its links and the smallest id that it reaches inside
the group: enough for exact counts and components, and never a row per pair. Equal vectors of a label are one weighted
member.

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, link with
nothing. Vectors of another length than the most frequent one are compared by length in one cell. Rows that share an id
are one vertex in the graph, each with its own count. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.llm.common import connected_components, join_hot, stored

SAMPLE, LEAST_CODEWORDS, CHUNK = 8192, 16, 1024
QUERIES, TARGET, LEAST_SHARE, LEAST_LINKED, BINS = 512, 0.9999, 0.05, 64, 64
GROWTH, BLOCKS, SLAB, PART = 8, 64, 512, 1024


def _units(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for x in column:
        v = None if not x.is_valid or x.values.null_count else np.asarray(x.values, dtype=np.float64)
        if v is not None and len(v) and np.isfinite(v).all():
            top = np.abs(v).max()
            if top > 0:
                v = v / top
                out.append(v / np.sqrt(v @ v))
                continue
        out.append(None)
    return out


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, dim, unit): unit holds doubles as bytes, or is null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _units(b.column(2))
            label = b.column(1).to_pylist()
            u = [x if k is not None else None for x, k in zip(u, label, strict=True)]
            yield pa.record_batch({"id": b.column(0), "label": b.column(1), "dim": pa.array([None if x is None else len(x) for x in u], pa.int32()), "unit": pa.array([None if x is None else x.tobytes() for x in u], pa.binary())})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, "id long, label string, dim int, unit binary").select(F.monotonically_increasing_id().alias("row"), "*")


def codebook(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """k-means centres, from evenly spaced rows of x."""
    k = min(k, len(np.unique(x, axis=0)))
    c = np.unique(x, axis=0)[np.linspace(0, len(np.unique(x, axis=0)) - 1, k).astype(int)]
    for _ in range(steps):
        near = ((x[:, None, :] - c[None]) ** 2).sum(-1).argmin(1) if len(x) * len(c) * x.shape[1] < 1 << 24 else (-2 * x @ c.T + (c**2).sum(1)).argmin(1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(0)
    return c


def codewords_for(vectors: int) -> int:
    """Codewords of each half, so that cells grow with the square root of the number of vectors: a power of two at or
    above its fourth root."""
    return max(LEAST_CODEWORDS, 1 << math.ceil(math.log2(max(vectors, 1)) / 4))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def lower_bounds(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distance from points (squared distances d to the codewords c) to each region."""
    gap = np.sqrt(_distances(c, c))
    np.fill_diagonal(gap, np.inf)
    gap[gap == 0] = np.inf
    out = np.zeros_like(d)
    for other in range(len(c)):
        np.maximum(out, (d - d[:, other : other + 1]) / (2 * gap[:, other])[None], out=out)
    return out**2


def traverse(b1: np.ndarray, b2: np.ndarray, radius2: float) -> Iterator[tuple[int, int]]:
    """Cells in ascending order of b1[i] + b2[j], up to radius2 (multi-sequence traversal)."""
    o1, o2 = np.argsort(b1, kind="stable").tolist(), np.argsort(b2, kind="stable").tolist()
    c1, c2 = b1[o1].tolist(), b2[o2].tolist()
    heap, seen = [(c1[0] + c2[0], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > radius2:
            break
        yield o1[i], o2[j]
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(o1) and n[1] < len(o2) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (c1[n[0]] + c2[n[1]], *n))


def _own_cells(members: DataFrame, books: tuple[np.ndarray, np.ndarray] | None, dim: int) -> DataFrame:
    """members with `cell`, that of their nearest codewords. Cell -dim is that of other lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
            own = -dims.astype(np.int64)
            some = np.flatnonzero(dims == dim)
            if len(some) and books:
                unit = b.column(b.schema.get_field_index("unit"))
                x = np.frombuffer(b"".join(unit[int(i)].as_py() for i in some), dtype=np.float64).reshape(len(some), dim)
                own[some] = _distances(x[:, : dim // 2], books[0]).argmin(1) * len(books[1]) + _distances(x[:, dim // 2 :], books[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], [*b.schema.names, "cell"])

    return members.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", cell long")


def _search(books: tuple[np.ndarray, np.ndarray] | None, dim: int, radius2: float):
    """For a part of a label's members and the block ranges of its cells: members with `blocks`, those of its own and
    later number that hold a cell of the search, and `visited`, the cells seen until the bound or until no block is left."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[["label", "dim", "own", "cls", "id", "weight", "unit"]]
        span = {int(c): range(int(f), int(t) + 1) for c, f, t in zip(right["cell"], right["first"], right["last"], strict=True)}
        end, blocks, visited = max((r.stop for r in span.values()), default=0), [], []
        if key[1] != dim or books is None:
            return left.assign(blocks=[list(range(int(o), end)) for o in left["own"]], visited=1)
        h, k = dim // 2, len(books[1])
        for at in range(0, len(left), SLAB):
            part = left.iloc[at : at + SLAB]
            x = np.frombuffer(b"".join(part["unit"]), dtype=np.float64).reshape(len(part), dim)
            b1, b2 = (lower_bounds(_distances(y, c), c) for y, c in ((x[:, :h], books[0]), (x[:, h:], books[1])))
            for n, own in enumerate(part["own"]):
                own, seen = int(own), 0
                asked = {own}
                for i, j in traverse(b1[n], b2[n], radius2 + 1e-9):
                    seen += 1
                    asked.update(q for q in span.get(i * k + j, ()) if q > own)
                    if len(asked) == end - own:
                        break
                blocks.append(sorted(asked))
                visited.append(seen)
        return left.assign(blocks=blocks, visited=visited)

    return run


def _share(members: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int, threshold: float, target: float) -> float:
    """Share of the bound 2 - 2 * threshold that gives QUERIES vectors the mean recall `target`, by brute force."""
    some = members.filter(F.col("dim") == dim).orderBy(F.xxhash64("unit", "label")).select("label", "unit").limit(QUERIES).collect()
    q = np.frombuffer(b"".join(r.unit for r in some), dtype=np.float64).reshape(-1, dim)
    labels, h, radius2 = np.array([r.label for r in some], dtype=object), dim // 2, 2 - 2 * threshold
    b1, b2 = lower_bounds(_distances(q[:, :h], books[0]), books[0]), lower_bounds(_distances(q[:, h:], books[1]), books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((len(q), BINS + 1), dtype=np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float64).reshape(-1, dim)
            own = np.array(b.column(0).to_pylist(), dtype=object)
            c = q @ x.T
            i, j = np.nonzero((c >= threshold) & (c < 1 - 1e-12) & (labels[:, None] == own[None]))
            if len(i):
                y = x[j]
                cost = b1[i, _distances(y[:, :h], books[0]).argmin(1)] + b2[i, _distances(y[:, h:], books[1]).argmin(1)]
                np.add.at(bins, (i, np.minimum(np.ceil(cost / radius2 * BINS).astype(int), BINS)), 1)
        i, k = np.nonzero(bins)
        yield pa.record_batch({"query": pa.array(i, pa.int32()), "bin": pa.array(k, pa.int32()), "n": pa.array(bins[i, k], pa.int64())})

    found = members.filter(F.col("dim") == dim).select("label", "unit").mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(q), BINS + 1))
    for r in found:
        counts[r.query, r.bin] = r.n
    counts = counts[counts.any(1)]
    if len(counts) < LEAST_LINKED:
        return 1.0
    reach = int(np.searchsorted((np.cumsum(counts, 1) / counts.sum(1)[:, None]).mean(0), target)) + 1
    return float(min(1.0, max(LEAST_SHARE, reach / BINS)))


def _compare(threshold: float):
    none = pd.DataFrame({"cls": [], "n": [], "a": [], "b": []}).astype("int64")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.rename(columns=lambda c: c.removeprefix("in_"))
        if not len(left) or not len(right):
            return none
        m = lambda p: np.frombuffer(b"".join(p["unit"]), dtype=np.float64).reshape(len(p), -1)
        x, y = m(left), m(right).T
        slabs = lambda k: [slice(i, i + SLAB) for i in range(0, k, SLAB)]
        link = np.concatenate([x[s] @ y >= threshold for s in slabs(len(left))])
        link &= left["cls"].to_numpy()[:, None] != right["cls"].to_numpy()[None]
        q, c = link.any(1), link.any(0)
        if not q.any():
            return none
        link, left, right = link[q][:, c], left[q], right[c]
        lq, lc, big = left["id"].to_numpy(), right["id"].to_numpy(), np.iinfo(np.int64).max
        least = lambda links, ids: np.concatenate([np.where(links[s], ids[None], big).min(1) for s in slabs(len(links))])
        summed = lambda links, w: np.concatenate([links[s] @ w for s in slabs(len(links))])
        n = summed(link, right["weight"].to_numpy())
        # a block that asks itself has each pair from both sides
        back = 0 if key[2] == key[3] else summed(link.T, left["weight"].to_numpy())
        while True:
            nq = np.minimum(lq, least(link, lc))
            nc = np.minimum(lc, least(link.T, nq))
            if (nq == lq).all() and (nc == lc).all():
                break
            lq, lc = nq, nc
        one = pd.DataFrame({"cls": left["cls"].to_numpy(), "n": n, "a": left["id"].to_numpy(), "b": lq})
        two = pd.DataFrame({"cls": right["cls"].to_numpy(), "n": back, "a": right["id"].to_numpy(), "b": lc})
        return pd.concat([one, two[(two["n"] > 0) | (two["a"] != two["b"])]])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, codewords: int | None = None, sample: int = SAMPLE, target_recall: float = 1.0, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, visited) of every row; visited counts the cells that its search saw, of
    codewords^2, and is null where a vector links with nothing."""
    rows = stored(unit_vectors(vectors, id_col, vector_col, label_col), "units")
    good = rows.filter("unit IS NOT NULL AND id IS NOT NULL")
    classes = good.groupBy("label", "dim", "unit").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cls"), "*"), "members")
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    books, dim, share = None, 0, 1.0
    if common is not None and common.dim >= 2:
        dim = common.dim
        some = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("unit")).select("unit").limit(sample).collect()
        x = np.frombuffer(b"".join(r.unit for r in some), dtype=np.float64).reshape(-1, dim)
        k = codewords or codewords_for(classes.count())
        books = codebook(x[:, : dim // 2], k), codebook(x[:, dim // 2 :], k)
        if target_recall < 1:
            share = _share(classes, books, dim, threshold, target_recall)
    total = classes.count()
    placed = stored(_own_cells(classes, books, dim), "cells")
    cell, size = ["label", "dim", "cell"], max(chunk, min(GROWTH * chunk, total // BLOCKS))
    before = Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over cells, not vectors
    cells = placed.groupBy(*cell).agg(F.count("*").alias("members")).withColumn("lo", F.coalesce(F.sum("members").over(before), F.lit(0)))
    cells = stored(cells, "spans")
    at = lambda place: F.floor(place / size).cast("int")
    # a part of a label has at least as many vectors as the label has cells, so copies of cells stay below the vectors
    parts = cells.groupBy("label", "dim").agg(F.sum("members").alias("n"), F.count("*").alias("k"))
    parts = stored(parts.select("label", "dim", "n", F.ceil(F.col("n") / F.greatest("k", F.lit(PART))).alias("parts")), "parts")
    placed = join_hot(placed, cells, cell, "members", total, "inner", keep=True).withColumn("own", at(F.col("lo") + F.pmod(F.xxhash64("unit"), F.col("members"))))
    placed = join_hot(placed, parts, ["label", "dim"], "n", total, "inner").withColumn("part", F.pmod(F.xxhash64("cls"), "parts")).drop("parts", "cell", "members", "lo")
    to = cells.select(*cell, at(F.col("lo")).alias("first"), at(F.col("lo") + F.col("members") - 1).alias("last")).join(parts, ["label", "dim"])
    to = to.select(*cell, "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    part, columns = ["label", "dim", "part"], "label string, dim int, own int, cls long, id long, weight long, unit binary"
    placed = placed.groupBy(*part).cogroup(to.groupBy(*part)).applyInPandas(_search(books, dim, share * (2 - 2 * threshold)), columns + ", blocks array<int>, visited long")
    placed = stored(placed, "blocks")
    group = ["label", "dim", "own", "block"]
    member = ["cls", "id", "weight", "unit"]
    ask = placed.withColumn("block", F.explode("blocks")).select(*group, *member)
    base = placed.drop("blocks", "visited").withColumnRenamed("own", "block").join(ask.select(*group).distinct(), ["label", "dim", "block"]).select(*group, *member)
    base = base.select(*[F.col(c).alias(f"in_{c}") for c in base.columns])
    found = ask.groupBy(*group).cogroup(base.groupBy(*[f"in_{c}" for c in group])).applyInPandas(_compare(threshold), "cls long, n long, a long, b long")
    found = stored(found, "links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select("a", "b"))
    per = placed.join(counts, "cls", "left").join(labels, placed["id"] == labels["id"], "left").select("label", "dim", "unit", "visited", placed["id"].alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    on = (rows["label"] == per["label"]) & (rows["dim"] == per["dim"]) & (rows["unit"] == per["unit"]) & rows["id"].isNotNull()
    both = rows.join(per, on, "left").select(rows["id"].alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", rows["id"]).alias("component_id"), "visited")
    return both.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "visited")
