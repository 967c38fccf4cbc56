"""A calibrator that learns as scores come: a histogram of scores by label, made isotonic when it is asked.

What is kept are the counts and positives of fixed bins of the score, so two histograms add up to that of both their rows: partitions,
micro-batches and days can each have their own. Pooling adjacent violators over the bins gives the isotonic fit of the binned scores, in
linear time, on the driver: it sees the bins alone.

Defined results: null scores or labels count nothing; scores below the range fall into the first bin, above it and NaN into the last. A bin
without rows takes the line between its neighbours; without any rows each score gets 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.models.registry import Calibrator


def bin_of(score: Column, low: float, high: float, bins: int) -> Column:
    x = score.cast("double")
    at = F.floor((x - low) / (high - low) * bins)
    return F.when(F.isnan(x), F.lit(bins - 1)).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, score: str, label: str, low: float = 0.0, high: float = 1.0, bins: int = 256) -> DataFrame:
    """bin, n, positives of the bins that have rows."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(bin_of(F.col(score), low, high, bins).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col(label) > 0).cast("long")).alias("positives"))


def merged(*parts: DataFrame) -> DataFrame:
    """The histogram of all parts' rows."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def pooled(n: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """The shares of positives that rise with the bin and lie closest to the bins' own (least squares by n); bins have rows."""
    blocks: list[list[float]] = []  # positives, rows, bins
    for p, m in zip(positives, n, strict=True):
        blocks.append([float(p), float(m), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, m, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + m, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), p / m) for p, m, k in blocks]) if blocks else np.empty(0)


@dataclass
class Online:
    """Counts and positives of each bin; add() takes in more rows, by a grouped sum that returns the bins alone."""

    low: float = 0.0
    high: float = 1.0
    bins: int = 256
    n: np.ndarray | None = None
    positives: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.n = np.zeros(self.bins, np.int64) if self.n is None else self.n
        self.positives = np.zeros(self.bins, np.int64) if self.positives is None else self.positives

    def add(self, df: DataFrame, score: str = "score", label: str = "label") -> Online:
        for r in histogram(df, score, label, self.low, self.high, self.bins).collect():  # at most `bins` rows
            self.n[r["bin"]] += r["n"]
            self.positives[r["bin"]] += r["positives"]
        return self

    def __add__(self, other: Online) -> Online:
        if (self.low, self.high, self.bins) != (other.low, other.high, other.bins):
            raise ValueError("histograms of different bins don't add up")
        return Online(self.low, self.high, self.bins, self.n + other.n, self.positives + other.positives)

    def shares(self) -> np.ndarray:
        """The calibrated share of every bin."""
        held = np.flatnonzero(self.n)
        if not len(held):
            return np.full(self.bins, 0.5)
        return np.interp(np.arange(self.bins), held, pooled(self.n[held], self.positives[held]))

    def calibrator(self) -> Calibrator:
        """Steps, one for each bin."""
        edges = self.low + (self.high - self.low) * np.arange(1, self.bins) / self.bins
        return Calibrator("isotonic", bounds=[float("-inf"), *edges.tolist()], values=self.shares().tolist())
