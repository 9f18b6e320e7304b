"""Secrets in texts, told apart by who holds them.

The base patterns find assignments, access keys and hexadecimal strings. Beside them, long tokens that look random are
candidates. Each candidate's hash is aggregated over the corpus by distinct owners and distinct repositories: a value of
EXAMPLE_OWNERS owners or more, or in EXAMPLE_REPOS repositories or more, is a widely copied example; any other looks
live. Repositories whose text is the same are mirrors and count as one. Live-looking candidates become spans of kind
`owned`; base spans stay in any case, and say whether their value is an example.

The scan is one pass over the texts with small patterns; distinct owners and repositories are counted before a value
meets its rows again, and values that very many rows hold are joined by broadcast.

Where owners are few and large (the `source` of documents, the repository being the document) three owners are a weak
sign; both limits are parameters.

Null texts are empty. A null owner or repository is one of its own. Repeated rows get their own result. Offsets count
code points. Very long texts are scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfleet.llm.common import join_hot, stored

# fixed values: kinds and patterns of the base
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_NAMES = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.ASCII)
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, by start, then kind."""
    out = []
    if ("=" in text or ":" in text) and _NAMES.search(text.lower()):
        out += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def looks_random(value: str) -> bool:
    """At least 4 letters and 3 bits a character, and either 4 digits or more, or a change between upper case, lower
    case and digits at 3 of 10 places or more, as in random keys with few digits."""
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if letters < 4:
        return False
    if digits < 4:
        classes = [c.isdigit() + 2 * c.isupper() + 4 * c.islower() for c in value]
        if 10 * sum(a != b and a > 0 < b for a, b in zip(classes, classes[1:], strict=False)) < 3 * (len(value) - 1):
            return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 3.0


def other_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    out = []
    for m in _LONG.finditer(text):
        if looks_random(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(row, doc_id, owner, repo, text_hash, spans) of each row; spans hold base ones and candidates with hashed values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(4):
                t = x.as_py() or ""
                base = base_spans(t)
                found.append([dict(zip(("start", "kind", "end", "value"), s, strict=True)) for s in base + other_candidates(t, base)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(found, pa.list_(SPAN))], names=["doc_id", "owner", "repo", "text_hash", "found"])

    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), own(owner_col).alias("owner"), own(repo_col).alias("repo"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, owner string, repo string, text_hash long, found array<struct<start int, kind int, end int, value string>>")
    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", "text_hash", spans.alias("spans"))


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_spans) of every candidate value in the corpus."""
    each = rows.select("owner", "repo", "text_hash", F.explode("spans.hash").alias("hash"))
    each = each.groupBy("hash", "owner", "repo", "text_hash").agg(F.count("*").alias("n"))  # a value's rows meet only after this
    distinct = F.least(F.count_distinct("repo"), F.count_distinct("text_hash"))
    return each.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), distinct.alias("n_repos"), F.sum("n").alias("n_spans"))


def find_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, base, spans, n_examples, n_owners, n_repos) of each row; base and spans are arrays of (start,
    kind, end, example). n_owners and n_repos are the most owners and the most repositories that any value of the row has,
    suppressed examples among them; 0 for a row without values.

    A value with `example_owners` owners or `example_repos` repositories is an example; candidates below both limits are
    added to the spans.
    """
    rows = stored(scan(docs, id_col, text_col, owner_col, repo_col), "secrets")
    each = rows.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    owners = stored(ownership(rows), "owners")
    total = int(owners.agg(F.sum("n_spans")).first()[0] or 0)
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    per = join_hot(each, owners, "hash", "n_spans", total).withColumn("example", example)
    told = F.when((F.col("kind") < 3) | ~F.col("example"), F.struct("start", "kind", "end", "example"))  # lists leave nulls out
    per = per.groupBy("row").agg(F.sort_array(F.collect_list(told)).alias("all"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"))
    both = rows.join(per, "row", "left")
    spans = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean>>"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", "text_hash", F.filter(spans, lambda s: s["kind"] < 3).alias("base"), spans.alias("spans"), F.size(F.filter(spans, lambda s: s["example"])).cast("long").alias("n_examples"), count("n_owners"), count("n_repos"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """docs with every found secret in `text` replaced: `[credential]`, or `[example-credential]` for copied examples."""
    found = find_secrets(docs, example_owners, example_repos).filter(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("__spans"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__spans")
    both = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__hash"]), "left").select(docs["*"], "__spans")
    # pieces of the text between the spans (overlaps merge), joined by the marks; only rows with spans do the work
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark = F.when(x["example"], F.lit("[example-credential]")).otherwise(F.lit("[credential]"))
        new = x["start"] >= s["at"]
        text = F.when(new, F.concat(s["out"], F.expr("text").substr(s["at"] + 1, x["start"] - s["at"]), mark)).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), text.alias("out"))

    cut = F.aggregate("__spans", state, step, lambda s: F.concat(s["out"], F.expr("text").substr(s["at"] + 1, F.length("text"))))
    out = both.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
