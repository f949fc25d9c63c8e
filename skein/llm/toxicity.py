"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity has ``GRADES`` ordered grades.  Labels only say toxic or not, so the grade of a labelled
toxic text is graded by its evidence: how many of its words are typical of toxic texts (0: not
toxic, 1: up to one such word, 2: up to four, 3: more).  The features of a text are words and word
starts of 4 to 7 letters, as log(1 + count).  One weight vector is shared by all thresholds:
P(grade > k) = logistic(w x - t_k) with t_0 < t_1 < t_2, fitted by penalised maximum likelihood, so
the expected severity is the sum of the three.

The model is fitted on a bounded sample, at most ``max_rows`` labelled rows chosen by the hash of their
id.  Texts stay on the executors: Spark counts the features of the sampled texts and picks the best
``max_features``, then the driver gets each text's counts of those alone and its grade, so neither its rows
nor their bytes grow with the texts.  Scoring covers every word of every text.

Cases: a null text counts as empty (no features, lowest severity); null or unknown labels are not
used; copies of a sampled text with one label count once, and where repeated ids bring more than
``2 * max_rows`` different texts, those of the least digests are used; with no toxic label all texts have severity 0; null ids are scored; repeated rows give
a row each; an empty table gives no rows; other columns are not read by :func:`grade`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import bounded_sample, drop_scratch, partitions, scratch, text_key

GRADES = 4
MAX_ROWS = 6_000
MAX_FEATURES = 1_500
STARTS = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: A text is toxic if P(grade > 0) reaches this.
THRESHOLD = 0.5
#: Words of a text that are counted at once, whatever its length.
PIECE = 1 << 20
#: A feature must occur in this share of the toxic sample texts, and in two of them.
LEAST_SHARE = 0.01
#: A feature is typical if it occurs in more than this many times as many toxic texts as clean ones.
TYPICAL = 9


def word_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    lower = (text or "").lower()
    at = 0
    while at < len(lower):
        end = at + PIECE
        while end < len(lower) and lower[end].isalpha():  # never cut a word
            end += 1
        counts.update(WORD.findall(lower[at:end]))
        at = end
    return counts


def parts(word: str) -> set[str]:
    """A word's features: itself, marked as whole, and its starts."""
    return {f"{word}$", *(word[:n] for n in STARTS if len(word) >= n)}


def _features(counts: Counter, among, heads: set[str]) -> Counter:
    """How often each feature of ``among`` occurs; ``heads`` are their first letters."""
    out: Counter = Counter()
    for word, n in counts.items():
        if word[:4] in heads:
            for f in parts(word):
                if f in among:
                    out[f] += n
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.array([20.0, 21.0, 22.0]))

    def __post_init__(self):
        self.heads = {f.rstrip("$")[:4] for f in self.weights}

    def margin(self, text: str | None) -> float:
        counts = _features(word_counts(text), self.weights, self.heads)
        return sum(self.weights[f] * np.log1p(n) for f, n in counts.items())

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text (row) and k (column)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - margins[:, None], -500, 500)))


def fit_cumulative(row: np.ndarray, col: np.ndarray, value: np.ndarray, d: int, grade: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean log-likelihood with an L2 penalty on the weights.

    ``row``, ``col`` and ``value`` are the non-zero features.
    """
    n, k = len(grade), GRADES - 1
    w = np.zeros(d)
    share = np.array([((grade > j).sum() + 0.5) / (n + 1) for j in range(k)])
    start = -np.log(share / (1 - share))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    state = [np.zeros(d + k), np.zeros(d + k)]
    for step in range(1, steps + 1):
        edges = np.concatenate([[-np.inf], _ordered(raw), [np.inf]])
        s = np.bincount(row, value * w[col], minlength=n)
        hi = 1 / (1 + np.exp(-np.clip(edges[grade + 1] - s, -50, 50)))
        lo = 1 / (1 + np.exp(-np.clip(edges[grade] - s, -50, 50)))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        to_s = dhi - dlo  # of the loss -log p
        to_t = np.array([(-dhi * (grade == j) + dlo * (grade == j + 1)).sum() for j in range(k)])
        to_raw = np.concatenate([[to_t.sum()], [to_t[j + 1 :].sum() * np.exp(raw[j + 1]) for j in range(k - 1)]])
        g = np.concatenate([np.bincount(col, value * to_s[row], minlength=d) + l2 * w, to_raw]) / n
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, raw = w - move[:d], raw - move[d:]
    return w, _ordered(raw)


def _ordered(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def feature_sets(text: Column) -> Column:
    """The distinct features of each text."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def of(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        sets = [pa.array([sorted({f for word in word_counts(t.as_py()) for f in parts(word)})], kind) for t in batch]
        return pa.concat_arrays(sets) if sets else pa.array([], kind)

    return of(text)


def evidence(text: Column, names: list[str], typical: set[str]) -> Column:
    """Struct of the positions in ``names`` of each text's features, their counts, and how many words have a ``typical`` one."""
    index = {f: j for j, f in enumerate(names)}
    heads = {f.rstrip("$")[:4] for f in names}
    out = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("typical", T.LongType())])

    @F.arrow_udf(out)
    def of(batch: pa.Array) -> pa.Array:
        at, counted, hits = [], [], []
        for t in batch:
            counts = word_counts(t.as_py())
            found = _features(counts, index, heads)
            at.append([index[f] for f in found])
            counted.append(list(found.values()))
            hits.append(sum(n for w, n in counts.items() if w[:4] in heads and parts(w) & typical))
        columns = [pa.array(at, pa.list_(pa.int32())), pa.array(counted, pa.list_(pa.int64())), pa.array(hits, pa.int64())]
        return pa.StructArray.from_arrays(columns, names=["at", "n", "typical"])

    return of(text)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(_y, _text, _key), written: the different sampled texts of each label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    chosen = F.broadcast(bounded_sample(known, "_id", max_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").select("_y", "_text", text_key(F.col("_text")).alias("_key"))
    return scratch(rows.dropDuplicates(["_key", "_y"]).repartition(partitions(docs.sparkSession)), "toxicity")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, l2: float = 0.2, steps: int = 500) -> Model:
    """Pick features by their gain over the labels, grade the toxic texts, fit weights and thresholds."""
    written = _sample(docs, labels, id_col, text_col, label_col, max_rows)
    texts = written
    if texts.count() > 2 * max_rows:
        texts = texts.join(F.broadcast(texts.select("_key", "_y").orderBy("_key", "_y").limit(2 * max_rows)), ["_key", "_y"], "left_semi")
    sizes = {r._y: r["count"] for r in texts.groupBy("_y").count().collect()}  # two rows at most
    if len(sizes) < 2:
        drop_scratch(written)
        return Model()
    found = texts.select("_y", F.explode(feature_sets(F.col("_text"))).alias("f")).groupBy("f").agg(F.sum("_y").alias("toxic"), F.sum(1 - F.col("_y")).alias("clean"))
    lift = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    able = found.where(F.col("toxic") >= max(2, int(sizes[1] * LEAST_SHARE))).withColumn("lift", lift).where(F.col("lift") > math.log(4))
    best = able.orderBy((F.col("toxic") * F.col("lift")).desc(), "f").limit(max_features).collect()
    if not best:
        drop_scratch(written)
        return Model()
    names = [r.f for r in best]
    seen = texts.select("_key", "_y", evidence(F.col("_text"), names, {r.f for r in best if r.toxic > TYPICAL * r.clean}).alias("_e")).select("_key", "_y", "_e.*").collect()
    drop_scratch(written)
    seen.sort(key=lambda r: (bytes(r._key), r._y))
    row = np.repeat(np.arange(len(seen)), [len(r.at) for r in seen])
    col = np.array([j for r in seen for j in r.at], int)
    value = np.log1p(np.array([n for r in seen for n in r.n], float))
    graded = np.array([0 if not r._y else 1 if r.typical <= 1 else 2 if r.typical <= 4 else 3 for r in seen])
    w, t = fit_cumulative(row, col, value, len(names), graded, l2, steps)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, t)


def severity(text: Column, model: Model) -> Column:
    """Struct of expected severity, most likely grade and P(grade > 0)."""
    out = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType())])

    @F.arrow_udf(out)
    def of(batch: pa.Array) -> pa.Array:
        above = model.above(np.array([model.margin(t) for t in batch.to_pylist()], float))
        edges = np.column_stack([np.ones(len(above)), above, np.zeros(len(above))])
        grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(grade), pa.array(above[:, 0])], names=["severity", "grade", "p_toxic"])

    return of(text)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) per row."""
    scored = docs.select(F.col(id_col).alias("doc_id"), severity(F.col(text_col), model).alias("_s"))
    return scored.select("doc_id", "_s.severity", "_s.grade", "_s.p_toxic", (F.col("_s.p_toxic") >= threshold).alias("toxic"))


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, columns unchanged; no shuffle."""
    return docs.where(severity(F.col(text_col), model)["p_toxic"] < threshold)
