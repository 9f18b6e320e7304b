"""Reply trees as conversations: root-to-leaf paths, ranked by score, formatted with a loss mask. DataFrame functions only.

Paths by iterative self-joins: jump table j maps each node to its 2^j-th ancestor and the sum of scores on the way, and
joined with itself gives table j + 1, so a tree of depth D needs log2(D) joins. A leaf's score is found by walking its
jumps from the longest to the shortest; the best `top` leaves of each tree are expanded the same way, every ancestor
once. All other nodes of unchosen branches are never expanded.

Format: a turn is `<|role|>`, a line feed, the text, `<|end|>`, a line feed. In roles and texts a backslash is doubled
and `<|` and `|>` get one inside, so no text can pass for a control string, and the way back is exact. The mask lists
(start, length) in code points of each assistant text.

A parent that isn't in the tree makes a node a root. Nodes on cycles, and below them, belong to no path. Of rows that
repeat a node the smallest by parent, role and text counts. Null texts and roles are empty; a null tree id is a tree of
its own; rows with a null node id are dropped. Equal scores: the smaller leaf id first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipfleet.llm.common import stored

# fixed values: control strings of the template
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("|\\>"), F.lit("|>")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, rank, place, node, role, text): the chosen paths; place 0 is the root, path the leaf's id.

    nodes: tree, node, parent, role, text, score (null: 0).
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    rows = nodes.filter("node IS NOT NULL").select(key.alias("k"), "tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("k", "node").agg(F.min("tree").alias("tree"), F.min(F.struct(F.coalesce("parent", F.lit(-(1 << 62))).alias("p"), "parent", "role", "text", "score")).alias("r")).select("k", "tree", "node", "r.parent", "r.role", "r.text", "r.score")
    rows = stored(rows, "nodes")
    up = rows.filter("parent IS NOT NULL").select("k", "node", F.col("parent").alias("anc"), F.col("score").alias("way"))
    jumps = [stored(up.join(rows.select("k", F.col("node").alias("anc")), ["k", "anc"], "left_semi"), "jump0")]
    largest = rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    while 1 << (len(jumps) - 1) <= largest and not jumps[-1].isEmpty():
        a, b = jumps[-1], jumps[-1].select("k", F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("way").alias("more"))
        jumps.append(stored(a.join(b, ["k", "anc"]).select("k", "node", F.col("far").alias("anc"), (F.col("way") + F.col("more")).alias("way")), f"jump{len(jumps)}"))
    parents = jumps[0].select("k", F.col("anc").alias("node")).distinct()
    walk = rows.select("k", "node").join(parents, ["k", "node"], "left_anti").select("k", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"), F.lit(0).alias("depth"))
    for j in reversed(range(len(jumps))):
        walk = walk.join(jumps[j], ["k", "node"], "left").select("k", "leaf", F.coalesce("anc", "node").alias("node"), (F.col("total") + F.coalesce("way", F.lit(0.0))).alias("total"), (F.col("depth") + F.when(F.col("anc").isNull(), 0).otherwise(1 << j)).alias("depth"))
    roots = rows.join(jumps[0].select("k", "node"), ["k", "node"], "left_anti").select("k", "node", F.col("score").alias("last"))
    order = Window.partitionBy("k").orderBy(F.desc("total"), "leaf")
    best = walk.join(roots, ["k", "node"]).select("k", "leaf", "depth", (F.col("total") + F.col("last")).alias("total")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    best = stored(best.select("k", "leaf", "rank", "depth"), "leaves")
    path = best.select("k", "leaf", "rank", "depth", F.col("leaf").alias("node"))
    for j in reversed(range(len(jumps))):
        more = path.join(jumps[j], ["k", "node"]).select("k", "leaf", "rank", (F.col("depth") - (1 << j)).alias("depth"), F.col("anc").alias("node"))
        path = stored(path.union(more), f"path{j}")  # the plan would double with each level
    return path.join(rows, ["k", "node"]).select("tree", F.col("leaf").alias("path"), "rank", F.col("depth").alias("place"), "node", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, path, rank, formatted, mask): one conversation for each path, with the loss mask as (start, length)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE + "\n"))
    turn = paths.select(key.alias("k"), "tree", "path", "rank", "place", F.col("role"), head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("k", "path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    turn = turn.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turns = turn.groupBy("k", "path").agg(F.min("tree").alias("tree"), F.min("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("out"), "start", F.length("body").alias("n"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn")))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].cast("int").alias("start"), x["n"].alias("length")))
    return turns.select("tree", "path", "rank", F.array_join("t.out", "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with `turns` (role, text) and `learned` (the texts under the mask), all from the formatted text."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    role = lambda x: F.regexp_extract(x, r"(?s)^<\|(.*?)\|>\n", 1)
    turns = F.transform(parts, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(x.substr(F.length(role(x)) + 6, F.length(x))).alias("text")))
    learned = F.transform("mask", lambda m: unescape(F.col("formatted").substr(m["start"] + 1, m["length"])))
    return formatted.withColumn("turns", turns).withColumn("learned", learned)


def linear_nodes(turns: DataFrame) -> DataFrame:
    """Nodes of conversations given as (conv_id, turn, role, text): each turn replies to the one before.

    Null turns come first; equal turns by role, then text; every row is a node.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
