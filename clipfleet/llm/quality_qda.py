"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text are transformed (logarithms, square roots) so that they are closer to normal. Each class
has a mean and a covariance; rates of short texts are drawn towards the corpus mean, by `few` words' worth; the covariance is drawn towards the pooled one and that towards a multiple of the identity.
The score is the logistic of the difference of the two Mahalanobis log-densities plus the log prior, divided by a
temperature; Cholesky factors are computed once and sent with the model.

Fitting sums first and second moments by class in Spark, over every labelled row that may be used; nothing is sampled.
Labels other than 0 and 1 are ignored; a class without rows takes the pooled moments and equal priors.

Null and empty texts have all-zero counts and get a score as any other. Repeated rows are scored each; repeated labels
count each. Extra columns are ignored. An empty table gives an empty result; without labelled rows all scores are finite.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_STOPS = re.compile(r"[.!?]")
FEATURES = ("length", "word_length", "word_length_spread", "symbols", "upper", "digits", "shouts", "distinct_words", "distinct_windows", "repeats", "bars", "sentence", "lines_again", "top_word")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = max(1, len(text) - text.count(" "))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n)
    distinct = set(words)
    windows = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0  # noqa: B905
    again = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    lines = [x for x in text.split("\n") if x.strip()]
    at = np.unique(np.fromiter((hash(w) for w in words), dtype=np.int64, count=n), return_counts=True)[1].max()
    return [
        np.log1p(n),
        np.log1p(sizes.mean()),
        np.log1p(sizes.std()),
        np.sqrt(len(_SYMBOLS.findall(text)) / n),
        np.sqrt(len(_UPPER.findall(text)) / chars),
        np.sqrt(len(_DIGIT.findall(text)) / chars),
        np.sqrt(text.count("!") / n),
        (len(distinct) - 1) / n if n > 1 else 0.5,
        windows,
        np.sqrt(again / n),
        np.sqrt(words.count("|") / n),
        np.log1p(n / (1 + len(_STOPS.findall(text)))),
        1 - len(set(lines)) / max(1, len(lines)),
        np.sqrt(at / n),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of each row; x holds the statistics as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "x": pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def settled(x: np.ndarray, centre: np.ndarray, few: float) -> np.ndarray:
    """x with all but the length drawn towards the centre: a text of n words keeps n / (n + few) of its distance."""
    n = np.expm1(x[:, :1])
    keep = n / (n + few)
    return np.hstack([x[:, :1], centre[1:] + (x[:, 1:] - centre[1:]) * keep])


@dataclass
class Model:
    centre: np.ndarray  # mean of all labelled rows
    few: float
    means: np.ndarray  # class, feature
    factors: np.ndarray  # class, lower Cholesky factor of the covariance
    log_dets: np.ndarray
    log_prior: float  # of class 1 over class 0
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of class 1 for each row of x."""
        d, x = [], settled(x, self.centre, self.few)
        for c in (0, 1):
            z = np.linalg.solve(self.factors[c], (x - self.means[c]).T)
            d.append(-0.5 * ((z**2).sum(0) + self.log_dets[c]))
        return 1 / (1 + np.exp(-np.clip((d[1] - d[0] + self.log_prior) / self.temperature, -60, 60)))


def fit(labelled: DataFrame, shrink: float = 0.2, ridge: float = 0.05, temperature: float = 4.0, few: float = 30.0) -> Model:
    """Model of (x, label) rows with label 0 or 1: class covariances (1 - shrink) own + shrink pooled, and of that
    (1 - ridge) + ridge * mean variance * identity."""
    k = len(FEATURES)
    used = labelled.filter("label IN (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    centre = np.zeros(k)
    for r in used.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect():  # k rows
        centre[r.i] = r.v

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + k + k * k))
        for b in batches:
            if b.num_rows:
                x = settled(np.array(b.column(0).to_pylist()).reshape(-1, k), centre, few)
                y = b.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    z = x[y == c]
                    total[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.record_batch({"label": pa.array([0, 1], pa.int32()), "m": pa.array(list(total), pa.list_(pa.float64()))})

    sums = used.mapInArrow(moments, "label int, m array<double>")
    sums = sums.select("label", F.posexplode("m").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 (1 + k + k^2) rows
    m = np.zeros((2, 1 + k + k * k))
    for r in sums:
        m[r.label, r.i] = r.v
    n, all_m = m[:, 0], m.sum(0)

    def of(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = max(row[0], 1.0)
        mean = row[1 : k + 1] / count
        return mean, row[k + 1 :].reshape(k, k) / count - np.outer(mean, mean)

    _, pooled = of(all_m)
    means, factors, dets = [], [], []
    for c in (0, 1):
        mean, cov = of(m[c] if n[c] else all_m)
        cov = (1 - shrink) * cov + shrink * pooled
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / k + 1e-6) * np.eye(k)
        low = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(low)
        dets.append(2 * np.log(np.diag(low)).sum())
    prior = float(np.log(n[1] / n[0])) if n.all() else 0.0
    return Model(centre, few, np.array(means), np.array(factors), np.array(dets), prior, temperature)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows (doc_id, x) as (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(model.score(x), pa.float64())})

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
