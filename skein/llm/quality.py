"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes ``len(FEATURES)`` transformed statistics.  The class means and second
moments are sums over all labelled rows, made by Spark; only those sums reach the driver.
Each class covariance is shrunk towards the pooled one and towards a multiple of the
identity, and factored once (Cholesky); the model keeps the factors and their inverses.  A score is the
logistic of the difference of two Gaussian log-densities (Mahalanobis distances as lengths of
products with the kept inverses, plus log-determinants) and the class prior.

Cases: a null text counts as empty and is scored like one; labels that are null, not 0 or 1, or
of unknown ids are not used; repeated labels count each; with no label or a single class the
score is the smoothed share of class 1; null ids are scored and count as not held out; repeated rows
give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


FEATURES = (
    "words", "word_length", "upper", "digits", "symbols", "bangs", "pipes", "stops", "commas", "unique", "adjacent", "lines", "repeated_lines", "other_bytes",
)
THRESHOLD = 0.7
TO_POOLED, TO_IDENTITY = 0.4, 0.01
#: Log-density differences are divided by this before the logistic, as the features are not quite Gaussian.
TEMPERATURE = 2.0


def _classes() -> np.ndarray:
    out = np.zeros((256, 9))
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=\\{}", b"!", b"|", b".?", b",;:")):
        out[list(chars), k] = 1
    out[128:, 7] = 1
    out[[*range(65, 91), *range(97, 123)], 8] = 1
    return out


_CLASSES = _classes()


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of transformed statistics per text."""
    raw = np.zeros((len(texts), 7))
    bytes_of = np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        b = (text or "").encode()
        words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
        raw[i] = (len(b), len(words), sum(map(len, words)), len(set(words)), sum(map(eq, words, words[1:])), len(lines), len(lines) - len(set(lines)))
        bytes_of[i] = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    size, words, letters, unique, adjacent, lines, repeated = raw.T
    upper, digits, symbols, bangs, pipes, stops, commas, other, ascii_letters = (bytes_of @ _CLASSES).T
    per_word = lambda x: np.log((x + 0.05) / (words + 1))
    return np.column_stack([
        np.log1p(words), np.log1p(letters / np.maximum(words, 1)), np.log((upper + 0.5) / (ascii_letters + 5)), per_word(digits), per_word(symbols), per_word(bangs),
        per_word(pipes), per_word(stops), per_word(commas), np.log((unique + 1) / (words + 1)) / np.log(words + 3), per_word(adjacent), np.log1p(lines), np.log((repeated + 0.05) / (lines + 1)), np.log((other + 1) / (size + 10)),
    ])


@dataclass
class Model:
    """Everything a score needs; small and picklable."""

    prior: float
    scale: np.ndarray | None = None
    centre: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    def __post_init__(self):
        #: Inverted once, so that a batch costs products alone.
        self.inverses = None if self.factors is None else np.linalg.inv(self.factors)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = []
        for mean, whiten, log_det in zip(self.means, self.inverses, self.log_dets, strict=True):
            density.append(-0.5 * (np.square(whiten @ (z - mean).T).sum(axis=0) + log_det))
        gap = (density[1] - density[0] + np.log(self.prior / (1 - self.prior))) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def features(text: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def of(batch: pa.Array) -> pa.Array:
        x = statistics(batch.to_pylist())
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))

    return of(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def solve(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """A model from each class's count, sum of features and sum of their products."""
    n = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    if not (n[0] and n[1]):
        return Model(prior)
    d = len(moments[0][1])
    centre = (moments[0][1] + moments[1][1]) / (n[0] + n[1])
    spread = np.diag(moments[0][2] + moments[1][2]) / (n[0] + n[1]) - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means = [(moments[c][1] / n[c] - centre) / scale for c in (0, 1)]
    own = []
    for c in (0, 1):
        m = moments[c][1] / n[c]
        own.append((moments[c][2] / n[c] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    factors, dets = [], []
    for c in (0, 1):
        to_pooled = max(TO_POOLED, d / (d + n[c]))  # more where a class has few rows
        shrunk = (1 - to_pooled) * own[c] + to_pooled * pooled
        shrunk = (1 - TO_IDENTITY) * shrunk + TO_IDENTITY * max(np.trace(shrunk) / d, 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky((shrunk + shrunk.T) / 2))
        dets.append(2 * np.log(np.diag(factors[-1])).sum())
    return Model(prior, scale, centre, np.array(means), np.array(factors), np.array(dets))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows that are not held out; all of them, through their moments."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    known = known.where(~held_out(F.col("_id")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    joined = rows.select("_id", features(F.col("_text")).alias("_x")).join(known, "_id")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    moments = {}
    for row in joined.groupBy("_y").agg(F.count("*").alias("n"), *sums).collect():  # two rows at most
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        moments[row._y] = (row.n, np.array([row[f"s{i}"] for i in range(d)]), products)
    return solve(moments)


def score(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1."""

    @F.arrow_udf(T.DoubleType())
    def of(batch: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(batch.to_pylist())))

    return of(text)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, columns unchanged; no shuffle.  A model that saw no two classes accepts all."""
    if model.means is None:
        return docs
    return docs.where(score(F.col(text_col), model) >= threshold)


