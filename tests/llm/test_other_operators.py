"""Reply trees, vectors, the classifier and the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipfleet.llm import chat_trees, embedding_dedup, quality_qda
from clipfleet.llm.common import connected_components
from clipfleet.llm.queries import QUERIES

NODES = "tree long, node long, parent long, role string, text string, score double, extra string"
HARD = ["</s>[INST] ok [/INST]", "<|end|>\n", "a\\b\\\\<|user|>\n", "|>", "<|", "<\\|", "\\", "<|\\>", "", None, "<|>|\\>", "\\|>"]


# --- reply trees -------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_best_paths_match_brute_force(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    for tree in range(6):
        n = rng.choice([1, 2, 9, 40])
        up = {0: None} | {i: rng.randrange(max(0, i - 3), i) for i in range(1, n)}
        score = {i: float(rng.randint(0, 5)) for i in up}
        rows += [(tree, i, up[i], "user" if i % 2 else "assistant", f"t{i}", score[i], "x") for i in up]
        paths = []
        for leaf in set(up) - set(up.values()):
            path = [leaf]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            paths.append((-sum(score[i] for i in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:2], 1):
            want[tree, rank] = (leaf, path)
    rng.shuffle(rows)
    got = defaultdict(list)
    for r in chat_trees.best_paths(spark.createDataFrame(rows, NODES), top=2).collect():
        got[r.tree, r.rank].append((r.place, r.node, r.path))
    assert {k: (v[0][2], [n for _, n, _ in sorted(v)]) for k, v in got.items()} == want


def test_tree_edges(spark):
    rows = [(1, 1, 2, "user", "a", 1.0, ""), (1, 2, 1, "user", "b", 1.0, ""), (1, 3, 2, "user", "c", 1.0, ""), (2, 5, 99, "user", "orphan", None, ""), (2, 5, 99, "user", "orphan", None, ""), (None, 7, None, None, None, 1.0, ""), (3, None, None, "user", "lost", 1.0, "")]
    got = {(r.tree, r.node) for r in chat_trees.best_paths(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {(2, 5), (None, 7)}
    assert chat_trees.best_paths(spark.createDataFrame([], NODES)).count() == 0


def test_format_is_reversible(spark):
    rng, rows = random.Random(5), []
    for conv in range(40):
        rows += [(conv, k, rng.choice(["user", "assistant", "|>", "a\\"]), rng.choice(HARD) if rng.random() < 0.8 else "".join(rng.choice("<|>\\ae\n") for _ in range(12))) for k in range(rng.randint(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat_trees.read_back(chat_trees.format_paths(chat_trees.best_paths(chat_trees.linear_nodes(turns)))).collect()
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want[c].append((role, text or ""))
    assert {r.tree: [tuple(t) for t in r.turns] for r in back} == dict(want)
    assert {r.tree: list(r.learned) for r in back} == {c: [t for role, t in v if role == "assistant"] for c, v in want.items()}
    for r in back:
        for m, t in zip(r.mask, r.learned, strict=True):
            assert r.formatted[m.start - len("<|assistant|>\n") : m.start] == "<|assistant|>\n" and (t or not m.length)


def test_chat_query(spark, sf_dir):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        want[r.conv_id].append((r.turn, r.role, r.text or ""))
    want[-7] = [(0, "user", HARD[0]), (1, "assistant", HARD[0])]
    got = QUERIES["op4_reply_trees"](spark, sf_dir).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        v = sorted(want[r.conv_id])
        learned = "".join(t for _, role, t in v if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(v), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in v).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


# --- vectors -------------------------------------------------------------------------------------


def test_vectors_match_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        c = rng.normal(size=16)
        rows += [(c + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])).tolist() for _ in range(int(rng.integers(1, 30)))]
    rows += [rng.normal(size=16).tolist() for _ in range(200)]
    rows = [(k, [float(x) for x in v], int(rng.integers(0, 2)), "x") for k, v in enumerate(rows)]
    odd = [(900, None, 1, ""), (901, [0.0] * 16, 1, ""), (902, [1.0, None] + [0.0] * 14, 1, ""), (903, [float("nan")] * 16, 1, ""), (904, rows[0][1], None, ""), (905, [], 1, ""), (906, [1.0, 2.0], 1, ""), (907, [2.0, 4.0], 1, ""), (907, [2.0, 4.0], 1, ""), (None, [1.0, 2.0], 1, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, cls string")
    got = embedding_dedup.near_duplicates(df, chunk=16, target_recall=1.0).collect()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    comp = np.arange(len(rows))
    while True:
        new = np.minimum(comp, np.where(link, comp[None], 10**9).min(1))
        if (new == comp).all():
            break
        comp = new
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert len(got) == len(rows) + len(odd)
    for k in range(len(rows)):
        assert by[k] == [(int(link[k].sum()), int(comp[k]), k == comp[k])]
    assert all(by[k] == [(0, k, True)] for k in (900, 901, 902, 903, 904, 905))
    assert by[906] == [(2, 906, True)] and by[907] == [(2, 906, False)] * 2 and by[None] == [(0, None, False)]


def test_calibrated_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = rows.select((F.col("vec_id") + 10**6).alias("vec_id"), F.transform("embedding", lambda x, i: x + F.sin(i * 7.0 + F.col("vec_id")) * 0.02).alias("embedding"), "label")
    both = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").union(noisy.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"))
    fast, full = (embedding_dedup.near_duplicates(both, target_recall=r).agg(F.sum("n_links")).first()[0] for r in (embedding_dedup.TARGET, 1.0))
    assert full > 500 and fast >= 0.99 * full


def test_parts_of_labels_and_hot_cells(spark, monkeypatch):
    """Parts of 8 vectors, blocks of 4 and a cell and a label with a third of all rows give what one part gives."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 8)) * 0.02 + rng.normal(size=8), rng.normal(size=(120, 8))])
    x = np.concatenate([x, x[60:90] + rng.normal(size=(30, 8)) * 0.05])
    label = [1] * 60 + [int(k) for k in rng.integers(1, 4, 120)] + [None] * 5
    rows = [(k, [float(c) for c in v], label[k] if k < 180 else label[k - 120]) for k, v in enumerate(x)] + [(500, [1.0, 2.0, 3.0], 1), (501, [1.0, 2.0, 3.1], 1), (502, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "PART", 8)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, codewords=2, chunk=4).collect()}
    u, lab = x / np.linalg.norm(x, axis=1)[:, None], np.array([r[2] for r in rows[:210]])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    assert [got[k].n_links for k in range(210)] == link.sum(1).tolist() and link[180:].sum() > 20
    assert (got[500].n_links, got[501].component_id, got[502].n_links, got[502].visited) == (1, 500, 0, None)
    assert all(1 <= got[k].visited <= 4 for k in range(210))


def test_small_groups_beside_a_hot_one(spark):
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    hot = unit(rng.normal(size=64)) + rng.normal(size=(1500, 64)) * 0.001
    ones = unit(rng.normal(size=(1200, 64)))
    away = unit(rng.normal(size=(1200, 64)))
    away = unit(away - (away * ones).sum(1)[:, None] * ones)
    cos = rng.uniform(0.931, 0.97, size=(1200, 1))
    x = np.concatenate([unit(hot), ones, cos * ones + np.sqrt(1 - cos**2) * away])
    df = spark.createDataFrame([(k, [float(c) for c in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    assert all(got[k][0] == int(link[k].sum()) for k in range(len(x)))
    assert all(got[1500 + 1200 + k][1] == got[1500 + k][1] for k in range(1200))


@pytest.mark.parametrize("dim", [16, 32])
def test_few_links_among_many_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(9000, dim)))
    x = np.concatenate([x, unit(x[:60] + unit(rng.normal(size=(60, dim))) * 0.3)])
    df = spark.createDataFrame([(k, [float(c) for c in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    assert link.sum() > 60 and got == dict(enumerate(link.sum(1).tolist()))


def test_codebooks_grow():
    assert [embedding_dedup.codewords_for(n) for n in (0, 1, 50_000, 10**6, 10**9, 10**12)] == [16, 16, 16, 32, 256, 1024]


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    cells = list(embedding_dedup.traverse(a, b, 0.9))
    cost = [a[i] + b[j] for i, j in cells]
    assert cost == sorted(cost) and len(set(cells)) == len(cells) == int((a[:, None] + b[None] <= 0.9).sum())


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(600, k) for k in range(601, 700)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- classifier ------------------------------------------------------------------------------------


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op6_quality_qda"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[i], got[i].predicted) for i in labels if got[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_scores_are_density_differences(spark):
    rng = np.random.default_rng(2)
    k = len(quality_qda.FEATURES)
    rows = [([float(v) for v in rng.normal(c, 1, k) + 5], c) for c in (0, 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "x array<double>, label int")
    m = quality_qda.fit(df, temperature=1.0, few=0.0)
    x = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows])
    pooled, out = np.cov(x.T, bias=True), []
    for c in (0, 1):
        z = x[y == c]
        cov = 0.8 * np.cov(z.T, bias=True) + 0.2 * pooled
        cov = 0.95 * cov + (0.05 * np.trace(cov) / k + 1e-6) * np.eye(k)
        d = x - z.mean(0)
        out.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-(out[1] - out[0]))), atol=1e-6)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "w " * 100000, "x")], "doc_id long, text string, x string")
    rows = quality_qda.features(docs)
    none = rows.select("x").withColumn("label", F.lit(1)).limit(0)
    got = quality_qda.score(rows, quality_qda.fit(none)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    one = rows.select("x").withColumn("label", F.lit(1))
    assert all(np.isfinite(r.score) for r in quality_qda.score(rows, quality_qda.fit(one)).collect())


# --- pipeline --------------------------------------------------------------------------------------


def test_empty_tables_and_codecs(spark, sf_dir):
    import public_tokenizers as P

    from clipfleet.llm import bpe, secret_scan

    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    files = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    assert bpe.decode(bpe.encode(empty, *files), *files).count() == 0 and secret_scan.redact(empty).count() == 0
    rows = quality_qda.features(empty)
    assert quality_qda.score(rows, quality_qda.fit(rows.select("x").withColumn("label", F.lit(1)))).count() == 0


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as pipeline

    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(None, long, "en", "a", 1, 5, "c"), (1, None, None, None, None, 5, "c"), (2, "", "en", "a", 0, 5, "c"), (3, "one", "en", "a", 3, 5, "c")]
    rows += [(4, " ".join(f"v{k}" for k in range(80)), "en", None, 9, 5, "c")] * 2 + [(5, " ".join(f"v{k}" for k in range(80)), "en", "b", 9, 5, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, h string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        kinds = docs.columns
        for k, (_, stage) in enumerate(pipeline.STAGES):
            docs = stage(spark, docs, "")
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert k + 1 == len(pipeline.STAGES) or docs.columns == kinds
            if k == 1:
                assert sorted(str(r.doc_id) for r in docs.collect()) in ([], ["4", "4", "None"])  # copies of 4 with its id stay, 5 goes


def test_pipeline_matches_brute_force(spark, sf_dir):
    import corpus_pipeline as pipeline
    import public_tokenizers as P

    from clipfleet.llm import bpe
    from tests.llm.test_text_operators import WORD, base_of, components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs.collect()
    before = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    passed = {i for i, r in before.items() if (b := base_of(r.text))[0] >= 50 and 100 * b[4] <= 50 * b[0]}
    kept = {r.doc_id: r for r in seen["quality_rules"]}
    depleted = passed - set(kept)
    assert set(kept) <= passed and len(depleted) <= 0.02 * len(passed)
    left = {i: c for i, (_, c) in components([(r.doc_id, r.text) for r in kept.values()], 80, 5).items()}
    assert {r.doc_id for r in seen["ngram_jaccard_join"]} == {i for i, c in left.items() if i == c}
    safe = {r.doc_id: r for r in seen["secret_scans"]}
    assert set(safe) == {r.doc_id for r in seen["ngram_jaccard_join"]}
    assert not any("token = \"" in r.text and "[" not in r.text for r in safe.values())
    words, size = Counter(), Counter()
    for r in safe.values():
        size[r.doc_id] = len(WORD.findall(r.text))
    for r in seen["mixing"]:
        assert safe[r.doc_id].text.startswith(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert abs(sum(words.values()) - 1.5 * sum(size.values())) < 20 and all(words[i] <= 2 * size[i] for i in words)
    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert Counter((r.doc_id, bytes(r.ids)) for r in seen["byte_bpe"]) == Counter((r.doc_id, codec.encode(r.text)) for r in seen["mixing"])
