"""Words' vectors and a linear layer over their mean, trained together, with a table of vectors of any size.

The table is a DataFrame, one row a word: its numbers and, for each, the sum of squared slopes that Adagrad keeps. A step joins the batch's
words to it, adds up each text's mean by text and each word's slope by word, joins those back, and writes the rows it has touched and no
others. The table in force is what was written last for each word; every `compact` steps that is written whole. What reaches the driver is
the linear layer: `dim` + 1 numbers a step.

A hot word's slope is a sum, combined before the shuffle; long texts are exploded, never gathered.

Defined results: rows with null ids or label take no part; ids that are null or not in the table are skipped, and a text without others has
the mean 0. Repeated ids count as often as they come. An empty table of rows leaves all weights as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import mathfn
from lumenframe.operators.batching import draw
from lumenframe.operators.staging import staged


def _v(dim: int) -> list[str]:
    return [f"v{k}" for k in range(dim)]


def _g(dim: int) -> list[str]:
    return [f"g{k}" for k in range(dim)]


def means(rows: DataFrame, table: DataFrame, dim: int, key: str = "row") -> DataFrame:
    """key, n (known words) and m0, m1, ... (their mean vector) of the rows that have known words."""
    words = rows.select(key, F.explode("ids").alias("id")).groupBy(key, "id").agg(F.count("*").alias("times"))
    met = words.join(table.select("id", *_v(dim)), "id")
    return met.groupBy(key).agg(F.sum("times").alias("n"), *((F.sum(F.col("times") * F.col(v)) / F.sum("times")).alias(f"m{k}") for k, v in enumerate(_v(dim))))


@dataclass
class Cbow:
    """table: id, v0, v1, ... (and the sums g0, g1, ... of training); weights and bias of the linear layer."""

    dim: int
    table: DataFrame
    weights: np.ndarray
    bias: float

    def logit(self) -> Column:
        return sum((F.coalesce(F.col(f"m{k}"), F.lit(0.0)) * float(w) for k, w in enumerate(self.weights)), F.lit(float(self.bias)))

    def score(self, df: DataFrame, name: str = "score", key: str = "row") -> DataFrame:
        """df with the probability of label 1; null where the ids are."""
        found = means(df, self.table, self.dim, key)
        odds = F.when(F.col("ids").isNotNull(), mathfn.sigmoid(self.logit()))
        return df.join(found, key, "left").withColumn(name, odds).drop("n", *(f"m{k}" for k in range(self.dim)))


def first_table(words: DataFrame, dim: int, seed: int = 0, sums: float = 1e-6) -> DataFrame:
    """id and numbers within +-0.5 / dim, drawn by id; the sums of squares start so low because a word's slope is small: a text's error is
    shared out to all its words, and averaged over the batch."""
    numbers = [((draw(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), seed) - 0.5) / dim).alias(v) for k, v in enumerate(_v(dim))]
    return words.select("id", *numbers, *(F.lit(sums).alias(g) for g in _g(dim)))


def step(model: Cbow, rows: DataFrame, rate: float, sums: np.ndarray, key: str = "row") -> tuple[DataFrame, np.ndarray, float, np.ndarray, float]:
    """One Adagrad step on the mean logistic loss of rows (key, ids, label): the touched rows of the table as they are after it, the linear
    layer's weights, bias and sums, and the loss before it."""
    dim, m = model.dim, [f"m{k}" for k in range(model.dim)]
    scored = rows.select(key, "label").join(means(rows, model.table, dim, key), key, "left").withColumn("z", model.logit())
    scored = staged(scored.withColumn("over", mathfn.sigmoid(F.col("z")) - F.col("label")))
    loss = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("label") + F.log1p(F.exp(-F.abs("z")))
    totals = scored.agg(F.count("*").alias("n"), F.sum("over").alias("b"), F.sum(loss).alias("loss"), *(F.sum(F.col("over") * F.coalesce(c, F.lit(0.0))).alias(c) for c in m)).first()
    if not totals["n"]:
        return model.table.limit(0), model.weights, model.bias, sums, 0.0
    n = totals["n"]
    slope = np.array([totals[c] for c in m] + [totals["b"]]) / n
    after = sums + slope**2
    moved = np.r_[model.weights, model.bias] - rate * slope / np.sqrt(after)
    # A word's slope is the layer's weights times one number: what its texts are over, each by the word's share in it.
    shares = rows.select(key, F.explode("ids").alias("id")).groupBy(key, "id").agg(F.count("*").alias("times"))
    pull = shares.join(scored.select(key, "n", "over").filter("n is not null"), key).groupBy("id").agg((F.sum(F.col("over") * F.col("times") / F.col("n")) / n).alias("pull"))
    met = model.table.join(pull, "id")
    own = [F.col("pull") * float(w) for w in model.weights]
    grown = [(F.col(g) + s * s) for g, s in zip(_g(dim), own, strict=True)]
    touched = met.select("id", *((F.col(v) - rate * s / F.sqrt(a)).alias(v) for v, s, a in zip(_v(dim), own, grown, strict=True)), *(a.alias(g) for a, g in zip(grown, _g(dim), strict=True)))
    return staged(touched), moved[:-1], float(moved[-1]), after, float(totals["loss"]) / n


def _latest(parts: list[DataFrame]) -> DataFrame:
    """What was written last for each id."""
    if len(parts) == 1:
        return parts[0]
    names = [c for c in parts[0].columns if c != "id"]
    every = parts[0].withColumn("__at", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("__at", F.lit(k)))
    return every.groupBy("id").agg(F.max_by(F.struct(*names), "__at").alias("s")).select("id", *(F.col(f"s.{c}").alias(c) for c in names))


def fit(df: DataFrame, words: DataFrame, dim: int = 16, rate: float = 0.3, epochs: int = 5, batches: int = 4, compact: int = 4, key: str = "row", seed: int = 0) -> Cbow:
    """df: key, ids, label (0 or 1); words: the ids that have vectors. Each epoch deals the rows to `batches` steps by a draw of its own."""
    rows = staged(df.select(key, F.col("ids").cast("array<long>").alias("ids"), F.col("label").cast("double").alias("label")).filter("ids is not null and label is not null"))
    rng = np.random.default_rng(seed)
    parts = [staged(first_table(words.select(F.col("id").cast("long").alias("id")).distinct(), dim, seed))]
    weights, bias, sums = rng.normal(0, 1, dim), 0.0, np.full(dim + 1, 0.1)
    for epoch in range(epochs):
        batch = F.floor(draw(key, seed + epoch) * batches).cast("int")
        for k in range(batches):
            touched, weights, bias, sums, _ = step(Cbow(dim, _latest(parts), weights, bias), rows.filter(batch == k), rate, sums, key)
            parts.append(touched)
            if len(parts) > compact:
                parts = [staged(_latest(parts))]
    return Cbow(dim, staged(_latest(parts)).select("id", *_v(dim)), weights, bias)
