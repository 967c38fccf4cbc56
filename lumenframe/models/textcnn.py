"""A text convolution network: embedded words, filters of several widths, the best place of each, and a linear layer.

Weights come from fit(), or from outside, and are kept as a folder of Parquet. fit() trains words and filters together by mini-batches in
partitions (descent): the loss reaches a filter, and the words under it, through the place at which it was greatest, and no other.

Defined results: null ids give a null score. Words without a vector, and what is missing to the widest filter, count as zeros. Texts of any
length are read whole. Rows with null ids or label take no part in training; an id beyond the vocabulary counts as a word without a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.models.descent import Checkpoints, Descended, Weights, descend, softplus

#: The most bytes of word vectors that are broadcast; larger tables are joined.
BROADCAST_BYTES = 64 << 20
_BLOCK = 4096  # places of a text that are handled at once
_TOGETHER = 1 << 15  # words of short texts that are handled at once in training


def pooled(words: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The greatest of relu(filter . words + bias) over all places, for each filter. words: n x d; filters: width x d x k."""
    width, places = len(filters), len(words) - len(filters) + 1
    best = np.zeros(filters.shape[2])
    for low in range(0, places, _BLOCK):
        high = min(places, low + _BLOCK)
        best = np.maximum(best, (bias + sum(words[low + o : high + o] @ filters[o] for o in range(width))).max(axis=0))
    return best


@dataclass
class TextCnn:
    """filters: (weights of width x d x k, bias of k) for each width; out: weights of all filters, one after another; bias: of the score."""

    filters: list[tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    bias: float = 0.0

    @property
    def dim(self) -> int:
        return self.filters[0][0].shape[1]

    def one(self, words: np.ndarray) -> float:
        short = max(len(w) for w, _ in self.filters) - len(words)
        if short > 0:
            words = np.concatenate([words, np.zeros((short, self.dim))])
        return float(np.concatenate([pooled(words, w, b) for w, b in self.filters]) @ self.out + self.bias)

    def score(self, df: DataFrame, key: str, ids: str, words: DataFrame, name: str = "score") -> DataFrame:
        """df with its score. key tells the rows of df apart; words: id and vector, an id once."""
        given = words.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        if given.count() * (self.dim + 1) * 8 <= BROADCAST_BYTES:
            return df.withColumn(name, self._by_table(given)(F.col(ids).cast("array<long>")))
        places = df.select(key, F.posexplode(F.col(ids).cast("array<long>")).alias("at", "id")).join(given, "id", "left")
        zeros = F.array_repeat(F.lit(0.0), self.dim)
        rows = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("vector", zeros).alias("v")))).alias("words"))
        flat = F.flatten(F.transform("words", lambda x: x["v"]))
        found = df.join(rows.select(key, flat.alias("__words")), key, "left")
        some = F.when(F.col(ids).isNotNull(), F.coalesce("__words", F.array().cast("array<double>")))
        return found.withColumn(name, self._by_vectors()(some)).drop("__words")

    def _by_table(self, words: DataFrame):
        table = words.orderBy("id").toPandas()  # of a checked size
        known = table["id"].to_numpy(np.int64)
        vectors = np.stack([*table["vector"], np.zeros(self.dim)])
        sent = words.sparkSession.sparkContext.broadcast((self, known, vectors))

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, ids, rows = sent.value

            def of(asked: np.ndarray | None) -> float | None:
                if asked is None:
                    return None
                asked = asked.astype(np.int64) if asked.dtype.kind == "i" else np.array([-1 if x is None or x != x else x for x in asked], np.int64)
                at = np.minimum(np.searchsorted(ids, asked), len(ids))
                missing = (at == len(ids)) | (ids[np.minimum(at, len(ids) - 1)] != asked) if len(ids) else np.ones(len(asked), bool)
                return model.one(rows[np.where(missing, len(ids), at)])

            for part in parts:
                yield pd.Series([of(x) for x in part], dtype="float64")

        return run

    def _by_vectors(self):
        model, dim = self, self.dim

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([None if x is None else model.one(np.asarray(x, np.float64).reshape(-1, dim)) for x in part], dtype="float64")

        return run

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, list(w.shape), w.ravel().tolist(), b.tolist()) for k, (w, b) in enumerate(self.filters)]
        rows.append((-1, [len(self.out)], self.out.tolist(), [self.bias]))
        spark.createDataFrame(rows, "part int, shape array<int>, weights array<double>, bias array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextCnn:
        rows = sorted(spark.read.parquet(path).collect())  # one for each width
        out, rest = rows[0], rows[1:]
        return TextCnn([(np.reshape(r["weights"], r["shape"]), np.array(r["bias"])) for r in rest], np.array(out["weights"]), float(out["bias"][0]))


def _places(words: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each filter the greatest filter . words + bias, and the first place where it stands."""
    width, places = len(filters), len(words) - len(filters) + 1
    best, where = np.full(filters.shape[2], -np.inf), np.zeros(filters.shape[2], np.int64)
    for low in range(0, places, _BLOCK):
        high = min(places, low + _BLOCK)
        found = sum(words[low + o : high + o] @ filters[o] for o in range(width)) + bias
        top = found.argmax(axis=0)
        value = found[top, np.arange(len(top))]
        better = value > best
        best[better], where[better] = value[better], top[better] + low
    return best, where


def loss_of(widths: tuple[int, ...], keep: float = 1.0):
    """The logistic loss and its slopes for rows of ids and label (0 or 1). weights: words (a vector for each id), f<width> and b<width>
    (filters and biases of each width), out and bias. keep: the chance that a filter's output is kept in training (dropout)."""

    wide = max(widths)

    def together(weights: Weights, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, kept: np.ndarray, slopes: Weights) -> float:
        """Adds the slopes of a few texts, which stand one after another in x (-1: no vector), and returns their loss."""
        vectors, starts = weights["words"], np.r_[0, np.cumsum(sizes)[:-1]]
        known = (x >= 0) & (x < len(vectors))
        words = vectors[np.where(known, x, 0)]
        words[~known] = 0.0
        found = [_places_of(words, starts, sizes, weights[f"f{w}"], weights[f"b{w}"]) for w in widths]
        pooled_all = np.maximum(np.concatenate([best for best, _ in found], axis=1), 0) * kept
        z = pooled_all @ weights["out"] + weights["bias"][0]
        over = 1 / (1 + np.exp(-z)) - labels
        slopes["out"] += over @ pooled_all
        slopes["bias"] += over.sum()
        back = np.split(over[:, None] * weights["out"] * kept, np.cumsum([best.shape[1] for best, _ in found])[:-1], axis=1)
        at, moved = [], []
        for width, (best, where), slope in zip(widths, found, back, strict=True):
            live = np.where(best > 0, slope, 0.0)  # text x filter
            slopes[f"b{width}"] += live.sum(axis=0)
            for o in range(width):
                slopes[f"f{width}"][o] += np.einsum("tk,tkd->dk", live, words[where + o])
                at.append((where + o).ravel())
                moved.append((live[:, :, None] * weights[f"f{width}"][o].T).reshape(-1, vectors.shape[1]))
        at, moved = np.concatenate(at), np.concatenate(moved)
        at, moved = x[at[known[at]]], moved[known[at]]
        cells = (at[:, None] * vectors.shape[1] + np.arange(vectors.shape[1])).ravel()
        slopes["words"] += np.bincount(cells, moved.ravel(), vectors.size).reshape(vectors.shape)
        return float((softplus(z) - labels * z).sum())

    def loss(weights: Weights, rows: pa.Table, rng: np.random.Generator) -> tuple[float, Weights]:
        slopes, total = {k: np.zeros_like(w) for k, w in weights.items()}, 0.0
        count = sum(weights[f"b{w}"].size for w in widths)
        kept = (rng.random((rows.num_rows, count)) < keep) / keep if keep < 1 else np.ones((rows.num_rows, count))
        labels = rows["label"].to_numpy().astype(np.float64)
        x, lengths = _joined(rows["ids"], wide)
        ends = np.r_[0, np.cumsum(lengths)]
        low = 0
        while low < len(lengths):  # as many texts as are _TOGETHER words long, one at least
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + _TOGETHER, "right")) - 1)
            total += together(weights, x[ends[low] : ends[high]], lengths[low:high], labels[low:high], kept[low:high], slopes)
            low = high
        return total, slopes

    return loss


def _joined(ids: pa.ChunkedArray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, each filled up with -1 (as nulls are) to at least so many; and how many each then has."""
    parts = [c for c in ids.chunks if len(c)]
    sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in parts] or [np.empty(0)]).astype(np.int64)
    flat = [c.flatten() for c in parts]
    values = np.concatenate([(f.fill_null(-1) if f.null_count else f).to_numpy(zero_copy_only=False) for f in flat] or [np.empty(0)]).astype(np.int64)
    lengths = np.maximum(sizes, least)
    x = np.full(lengths.sum(), -1, np.int64)
    x[np.arange(len(values)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(sizes) - sizes), sizes)] = values
    return x, lengths


def _places_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_places() of each of the texts that stand one after another in words, text x filter; places are those in words."""
    if len(starts) == 1:
        best, where = _places(words, filters, bias)
        return best[None], where[None]
    width, (_, dim, count) = len(filters), filters.shape
    each = words @ filters.transpose(1, 0, 2).reshape(dim, width * count)
    found = np.full((len(words), count), -np.inf)  # a window may end in the next text: those are left out
    found[: len(words) - width + 1] = sum(each[o : len(words) - width + 1 + o, o * count : (o + 1) * count] for o in range(width)) + bias
    for o in range(1, width):
        found[starts + sizes - o] = -np.inf
    best = np.maximum.reduceat(found, starts, axis=0)
    text, place = np.repeat(np.arange(len(starts)), sizes), np.arange(len(words))
    where = np.full(best.shape, len(words), np.int64)
    at, of = np.nonzero(found == best[text])
    np.minimum.at(where, (text[at], of), place[at])
    return best, where


def first_weights(words: int, dim: int, widths: tuple[int, ...], filters: int, seed: int = 0) -> Weights:
    """Words uniform within +-0.5 / dim, filters and the last layer normal with deviation 0.1, biases 0.1."""
    rng = np.random.default_rng(seed)
    found = {"words": rng.uniform(-0.5 / dim, 0.5 / dim, (words, dim))}
    for w in widths:
        found |= {f"f{w}": rng.normal(0, 0.1, (w, dim, filters)), f"b{w}": np.full(filters, 0.1)}
    return found | {"out": rng.normal(0, 0.1, filters * len(widths)), "bias": np.array([0.1])}


def fit(df: DataFrame, words: int, dim: int = 16, widths: tuple[int, ...] = (3, 4, 5), filters: int = 16, keep: float = 1.0, key: str = "row", seed: int = 0, checkpoint: Checkpoints | None = None, **steps) -> tuple[TextCnn, DataFrame, Descended]:
    """The network and its word vectors (id, vector), from rows of ids (0 to words - 1) and label (0 or 1). steps: what descend() takes."""
    found = descend(df.select(key, "ids", F.col("label").cast("double").alias("label")), loss_of(widths, keep), first_weights(words, dim, widths, filters, seed), key=key, seed=seed, checkpoint=checkpoint, **steps)
    w = found.weights
    table = pa.table({"id": pa.array(np.arange(words)), "vector": pa.array(list(w["words"]), pa.list_(pa.float64()))})
    return TextCnn([(w[f"f{n}"], w[f"b{n}"]) for n in widths], w["out"], float(w["bias"][0])), df.sparkSession.createDataFrame(table), found


def conv_max(x: Column, weights: list[float], bias: float = 0.0) -> Column:
    """One filter over an array of numbers, JVM-side: the greatest relu(weights . window + bias); null for arrays that are too short."""
    width, x = len(weights), x.cast("array<double>")
    term = lambda i: sum((F.get(x, i + o) * w for o, w in enumerate(weights)), F.lit(bias))
    return F.when(F.size(x) >= width, F.array_max(F.transform(F.sequence(F.lit(0), F.size(x) - width), lambda i: F.greatest(F.lit(0.0), term(i)))))
