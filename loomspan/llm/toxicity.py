"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 (clean), 1 and 2 are ordered; P(grade > k) = sigmoid(w.x - cut_k) with one weight vector for all
thresholds.  Features are sparse: words, and their first letters, that the labelled documents tie to toxicity.  The
result is the expected severity, P(grade > 0) + P(grade > 1).

Grades come from the labels alone: toxic is 1, toxic and of low quality 2.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import batch_of, doc_columns, keep_rows, map_arrow

WORDS = re.compile(r"[^\W\d_]+")
#: Besides whole words, the first so many letters of longer ones are features: inflected words share them.
PREFIXES = (4, 5, 6)
KEEP_WORDS = 300_000


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class SeverityModel:
    weights: dict[str, float]
    cuts: tuple[float, float]

    def __post_init__(self):
        self.known: dict[str, tuple[str, ...]] = {}

    def counts(self, text: str) -> Counter:
        """Features of the model in a text."""
        found: Counter = Counter()
        get = self.known.get
        for w in WORDS.findall(text.lower()):
            if (own := get(w)) is None:
                if len(self.known) > KEEP_WORDS:
                    self.known.clear()
                own = self.known[w] = tuple(f for f in features_of(w) if f in self.weights)
            if own:
                found.update(own)
        return found

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([sum(self.weights[f] * np.log1p(n) for f, n in sorted(self.counts(t).items())) for t in texts], float)
        return tuple(1 / (1 + np.exp(-np.clip(x - c, -60, 60))) for c in self.cuts)  # grade > 0, grade > 1


def fit_ordinal(x: np.ndarray, grades: np.ndarray, *, l2: float = 3e-5, steps: int = 500, rate: float = 0.3) -> tuple[np.ndarray, tuple[float, float]]:
    """Proportional odds by full-batch Adam: shared weights, and two ordered cuts (the second is the first plus exp(gap))."""
    n, d = x.shape
    w, cut, gap = np.zeros(d), 1.0, 0.5
    m, v = np.zeros(d + 2), np.zeros(d + 2)
    for t in range(1, steps + 1):
        z = x @ w
        cuts = np.array([cut, cut + np.exp(gap)])
        p = 1 / (1 + np.exp(-np.clip(z - cuts[:, None], -60, 60)))
        # likelihood of a grade is the difference of neighbouring cumulative probabilities
        like = np.where(grades == 0, 1 - p[0], np.where(grades == 1, p[0] - p[1], p[1])).clip(1e-9)
        s = p * (1 - p)
        dz = np.where(grades == 0, -s[0], np.where(grades == 1, s[0] - s[1], s[1])) / like
        d0 = np.where(grades == 0, s[0], np.where(grades == 1, -s[0], 0)) / like
        d1 = np.where(grades == 1, s[1], np.where(grades == 2, -s[1], 0)) / like
        g = -np.concatenate([x.T @ dz / n - l2 * w, [(d0 + d1).mean(), d1.mean() * np.exp(gap)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, cut, gap = w - step[:d], cut - step[d], gap - step[d + 1]
    return w, (float(cut), float(cut + np.exp(gap)))


def fit_texts(texts: list[str], grades: list[int], *, max_features: int = 400, min_docs: int = 5) -> SeverityModel:
    """Fit on texts with grades 0, 1 and 2."""
    grades = np.array(grades, np.int64)
    y = grades > 0
    if not len(y) or y.all() or not y.any():
        level = 8.0 if not y.any() else -8.0  # one class only: all are as the labels say, or clean without labels
        return SeverityModel({}, (level, level + 1))
    seen = [Counter(f for w in WORDS.findall(t.lower()) for f in features_of(w)) for t in texts]
    bad, good = Counter(), Counter()
    for own, t in zip(seen, y, strict=True):
        (bad if t else good).update(own.keys())
    n1, n0 = int(y.sum()), int((~y).sum())
    tied = {}
    for f, k in bad.items():
        p1, p0 = (k + 0.5) / (n1 + 1), (good.get(f, 0) + 0.5) / (n0 + 1)
        if k >= min_docs and p1 > 5 * p0:
            tied[f] = k * np.log(p1 / p0)
    chosen = sorted(sorted(tied, key=lambda f: (-tied[f], f))[:max_features])
    place = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(seen), len(chosen)))
    for i, own in enumerate(seen):
        for f in own.keys() & place.keys():
            x[i, place[f]] = np.log1p(own[f])
    w, cuts = fit_ordinal(x, grades)
    return SeverityModel({f: float(w[i]) for f, i in place.items()}, cuts)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 5000, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", quality_col: str = "quality") -> SeverityModel:
    """Fit on at most max_labelled labelled documents, those with the smallest hash of the id.

    A toxic document has grade 2 if its quality is labelled 0, else grade 1 (all of them where labels have no quality).
    Rows with a null id, text or toxic label don't count; of an id with several labels the greatest grade counts, of an
    id with several texts the first in order.  The driver receives at most max_labelled texts.
    """
    low = (F.col(quality_col) == 0) if quality_col in labels.columns else F.lit(False)
    toxic = F.col(toxic_col).cast("int")
    grade = F.when(toxic.isNull(), None).when(toxic < 1, 0).when(low, 2).otherwise(1)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    found = rows.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("grade").alias("grade")).toPandas().sort_values("doc_id")
    return fit_texts(found.text.tolist(), found.grade.tolist())


THRESHOLD = 0.3


def _is_toxic(texts: list[str], mild: np.ndarray, threshold: float) -> np.ndarray:
    return (mild > threshold) & np.array([bool(t) for t in texts], bool)


def without_toxic(docs: DataFrame, model: SeverityModel, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text severity() doesn't call toxic, with all of their columns."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def make():
        own = SeverityModel(*held.value)
        return lambda ids, texts: (~_is_toxic(texts, own.scores(texts)[0], threshold)).tolist()

    return keep_rows(docs, make, id_col=id_col, text_col=text_col)


def severity(docs: DataFrame, model: SeverityModel, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grade every whole text: doc_id, p_mild (grade > 0), p_severe (grade > 1), severity (expected, 0 to 2), toxic (p_mild over threshold).

    Null and empty texts have no features: they get the model's base severity and are never toxic.  Repeated rows
    give repeated results, an empty table an empty one; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))
    schema = pa.schema([("doc_id", pa.int64()), ("p_mild", pa.float64()), ("p_severe", pa.float64()), ("severity", pa.float64()), ("toxic", pa.bool_())])

    def make():
        own = SeverityModel(*held.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            mild, severe = own.scores(texts)
            return batch_of(schema, batch.column(0), mild, severe, mild + severe, _is_toxic(texts, mild, threshold))

        return step

    return map_arrow(doc_columns(docs, id_col=id_col, text_col=text_col), make, "doc_id long, p_mild double, p_severe double, severity double, toxic boolean")
