"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Words (their logarithmic counts, scaled to unit length) are hashed to `buckets` features; structure statistics (how the text is cased,
punctuated, spaced and repeated) and metadata (the n_chars column, where there is one) are cut into soft steps, so that a pair of steps,
or of a step and a word, can interact. Spark ML fits the machine to a bounded sample of the labelled rows: at most `per_class` of each
class, those with the least hash of their id. The fitted numbers, (buckets + statistics) * (rank + 1) of them whatever the input's size,
are broadcast, and a score takes time linear in a text's features: the sum over pairs is half of the squared sum less the sum of squares
of the factors.

Defined results: null text is an empty text and gets a score like others; a null n_chars is a feature of its own. Null labels and labels
of unknown documents are ignored; of repeated labels one counts, the greatest. Without labels of both classes every score is the share
of label 1 (0 without any). Rows that repeat are scored each; a null doc_id is kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import add_columns, stage

_WORD = re.compile(r"[^\W\d_]+")
#: Each statistic is compared with these steps; features fall off over half a step's distance.
_STEPS = {
    "log_chars": (2, 4, 5, 6, 7, 8, 9, 10),
    "log_words": (1, 2, 3, 4, 5, 6, 7, 8),
    "word_length": (2, 3.5, 5, 6.5, 8, 10),
    "distinct_words": (0.1, 0.3, 0.5, 0.65, 0.8, 0.95),
    "upper": (0.0, 0.03, 0.1, 0.3, 0.6, 0.9),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "marks": (0.0, 0.02, 0.05, 0.1, 0.2, 0.4),
    "spaces": (0.05, 0.12, 0.17, 0.22, 0.3),
    "distinct_lines": (0.1, 0.3, 0.5, 0.75, 0.9, 1.0),
    "log_line": (1, 2.5, 4, 5, 6, 7),
    "top_word": (0.02, 0.05, 0.1, 0.2, 0.4),
    "stated_chars": (2, 4, 5, 6, 7, 8, 9, 10),
}
#: Each step has a feature, and each statistic one for its absence.
STATISTICS = sum(len(x) + 1 for x in _STEPS.values())


def statistics(text: str, words: Counter, stated: int | None) -> dict[str, float | None]:
    n, total, lines = max(1, len(text)), max(1, sum(words.values())), text.split("\n")
    upper, digits, spaces = (sum(map(text.count, x)) for x in (_UPPER, "0123456789", " \n\t"))
    letters = sum(len(w) * c for w, c in words.items())
    return {
        "log_chars": np.log1p(len(text)),
        "log_words": np.log1p(sum(words.values())),
        "word_length": letters / total,
        "distinct_words": len(words) / total,
        "upper": upper / max(1, letters),
        "digits": digits / n,
        "marks": max(0, n - letters - digits - spaces) / n,
        "spaces": spaces / n,
        "distinct_lines": len(set(lines)) / len(lines),
        "log_line": np.log1p(n / len(lines)),
        "top_word": max(words.values(), default=0) / total,
        "stated_chars": None if stated is None else np.log1p(max(0, stated)),
    }


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(text: str | None, stated: int | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indices and values: the statistics' steps first, then the hashed words."""
    text = text or ""
    words = Counter(_WORD.findall(text))
    at, values, base = [], [], 0
    for (name, steps), value in zip(_STEPS.items(), statistics(text, words, stated).values(), strict=True):
        if value is None:
            at.append(base + len(steps))
            values.append(1.0)
        else:
            for k, step in enumerate(steps):
                width = (steps[min(k + 1, len(steps) - 1)] - steps[max(k - 1, 0)]) / 2 / (1 if 0 < k < len(steps) - 1 else 0.5)
                near = 1 - abs(value - step) / width
                if k == 0 and value < step or k == len(steps) - 1 and value > step:
                    near = 1.0
                if near > 0:
                    at.append(base + k)
                    values.append(near)
        base += len(steps) + 1
    hashed: dict[int, float] = {}
    for word, n in words.items():
        h = zlib.crc32(word.lower().encode())
        hashed[base + h % buckets] = hashed.get(base + h % buckets, 0.0) + n
    if hashed:
        where = np.array(sorted(hashed))
        weight = np.log1p(np.array([hashed[k] for k in where]))
        return np.r_[np.array(at, np.int64), where], np.r_[np.array(values), weight / np.sqrt((weight**2).sum())]
    return np.array(at, np.int64), np.array(values)


class Machine:
    """The fitted numbers, and the score in linear time."""

    def __init__(self, intercept: float, linear: np.ndarray, factors: np.ndarray, buckets: int):
        self.intercept, self.linear, self.factors, self.buckets = intercept, linear, factors, buckets

    def score(self, text: str | None, stated: int | None) -> float:
        at, x = features(text, stated, self.buckets)
        weighted = self.factors[at] * x[:, None]
        pairs = 0.5 * ((weighted.sum(axis=0) ** 2).sum() - (weighted**2).sum())
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.linear[at] @ x + pairs, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, buckets: int = 2048, rank: int = 4, rounds: int = 80, rate: float = 0.05, seed: int = 7) -> Machine:
    """docs: doc_id, text and, if known, n_chars. labels: doc_id, label (0 or 1), the rows to learn from."""
    known = labels.filter("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    width = STATISTICS + buckets
    first = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * per_class rows
    kinds = [pa.field("at", pa.list_(pa.int32())), pa.field("x", pa.list_(pa.float64()))]
    given = _given(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars").join(sample, "doc_id")
    made = add_columns(given, ["text", "n_chars"], kinds, lambda t, n: [list(c) for c in zip(*(features(a, b, buckets) for a, b in zip(t, n, strict=True)), strict=True)])
    one = F.min_by(F.struct("label", "at", "x"), F.struct(F.xxhash64("at", "x"), F.size("at")))  # of an id with several texts the same on every run
    rows = stage(made.groupBy("doc_id").agg(one.alias("s")).select("doc_id", "s.*"), "quality-sample").collect()
    found = Counter(r["label"] for r in rows)
    if len(found) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return Machine(float(np.log(max(share, 1e-20) / max(1 - share, 1e-20))), np.zeros(width), np.zeros((width, 1)), buckets)
    rows.sort(key=lambda r: r["doc_id"])
    train = docs.sparkSession.createDataFrame([(float(r["label"]), Vectors.sparse(width, r["at"], r["x"])) for r in rows], ["label", "features"])
    machine = FMClassifier(factorSize=rank, maxIter=rounds, stepSize=rate, regParam=1e-4, initStd=0.05, solver="adamW", seed=seed)
    held = train.coalesce(2).persist()
    try:
        model = machine.fit(held)
    finally:
        held.unpersist()
    # The sample's classes are even; the intercept takes the odds back to those of all labelled rows.
    odds = np.log(totals[1] / totals[0]) - np.log(found[1] / found[0])
    return Machine(model.intercept + float(odds), model.linear.toArray(), model.factors.toArray(), buckets)


def _given(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), stated.alias("n_chars"))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def kernel(texts: list, stated: list) -> list[list]:
        return [[held.value.score(t, n) for t, n in zip(texts, stated, strict=True)]]

    return add_columns(_given(docs), ["text", "n_chars"], [pa.field("score", pa.float64())], kernel).select("doc_id", "score")
