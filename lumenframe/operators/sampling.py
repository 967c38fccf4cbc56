"""Bags, folds and weighted samples by hash draws: stable under repartitioning, and complements are exact."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.batching import draw


def bag(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """df with in_bag: whether the key's draw lies below the fraction. Those not in the bag are out of it."""
    return df.withColumn("in_bag", draw(key, seed) < fraction)


def bags(df: DataFrame, key: str, fraction: float, count: int, seed: int = 0, replace: bool = False) -> DataFrame:
    """member, and the rows of each ensemble member's bag, drawn for each by itself. replace: rows may come several times, as often as
    drawn with replacement (Poisson with mean `fraction`); else each comes with that chance."""
    member = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    u = draw(F.concat(F.col("member").cast("string"), F.lit(":"), F.col(key).cast("string")), seed)
    held = df.withColumn("member", member)
    if not replace:
        return held.filter(u < fraction)
    times = sum((u >= step).cast("int") for step in poisson_steps(fraction))
    return held.withColumn("__again", F.explode(F.array_repeat(F.lit(0), times))).drop("__again")


def poisson_steps(mean: float) -> list[float]:
    """Chances that a Poisson number is at most 0, 1, 2, ..., as far as doubles tell them from 1."""
    term = total = math.exp(-mean)
    steps = [total]
    while total < 1 - 1e-13 and term > 0:
        term *= mean / len(steps)
        total += term
        steps.append(total)
    return steps


def folds(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """df with fold 0..k-1; rows of one group share it."""
    return df.withColumn("fold", F.floor(draw(group, seed) * k).cast("int"))


def ensemble_spec(names: str, counts: str, separator: str = ",") -> list[tuple[str, int]]:
    """Trainer names and how many of each, from two lists in text."""
    a, b = [x.strip() for x in names.split(separator)], [int(x) for x in counts.split(separator)]
    if len(a) != len(b):
        raise ValueError("as many counts as names are needed")
    return list(zip(a, b, strict=True))


def weighted_sample(df: DataFrame, key: str, weight: str, k: int, distortion: float = 1.0, seed: int = 0) -> DataFrame:
    """k rows without replacement, likelier the higher weight ** distortion: those with the least -ln(u) / weight."""
    u = draw(key, seed) + F.lit(2.0**-53)
    rank: Column = -F.log(u) / F.pow(F.col(weight).cast("double"), F.lit(distortion))
    return df.filter(F.col(weight) > 0).withColumn("__rank", rank).orderBy("__rank", key).limit(k).drop("__rank")


@dataclass
class AliasTable:
    """Draws of 0, 1, ... by fixed chances, each in constant time: a place is drawn evenly, and kept or exchanged for its alias."""

    chances: np.ndarray
    kept: np.ndarray
    alias: np.ndarray

    @staticmethod
    def of(weights: np.ndarray, distortion: float = 1.0) -> AliasTable:
        """Chances are in proportion to weights ** distortion; what has weight 0 is never drawn."""
        weights = np.asarray(weights, np.float64)
        powers = np.where(weights > 0, np.power(np.maximum(weights, 1e-300), distortion), 0.0)
        if not len(powers) or powers.sum() <= 0 or not np.isfinite(powers).all():
            raise ValueError("some weight must be above 0, and all finite")
        chances = powers / powers.sum()
        kept, alias = np.ones(len(chances)), np.arange(len(chances))
        left = chances * len(chances)
        low, high = [int(k) for k in np.flatnonzero(left < 1)], [int(k) for k in np.flatnonzero(left >= 1)]
        while low and high:
            small, large = low.pop(), high[-1]
            kept[small], alias[small] = left[small], large
            left[large] -= 1 - left[small]
            if left[large] < 1:
                low.append(high.pop())
        for small in low:  # what rounding has left; a chance of 0 still goes to the likeliest
            kept[small], alias[small] = (1.0, small) if chances[small] > 0 else (0.0, int(chances.argmax()))
        return AliasTable(chances, kept, alias)

    def draw(self, place: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Numbers drawn by two uniform numbers in [0, 1) each."""
        at = np.minimum((place * len(self.kept)).astype(np.int64), len(self.kept) - 1)
        return np.where(keep < self.kept[at], at, self.alias[at])
