"""Skip-gram word vectors by noise-contrastive estimation: a word's neighbours against words drawn from the noise distribution.

The loss of a pair is softplus(-s) for its context and softplus(s) for each of the drawn words, where s = center . word + bias - ln(draws
* chance): what a word's number of draws is expected to be is taken off, so that frequent noise words aren't held against a center.

Training is mini-batch descent in partitions (descent), whose bound on weights holds for the vocabulary; the noise's alias table goes with
it. Defined results: texts with fewer than two known words give no pairs; ids outside the vocabulary are skipped, and words on both sides
of one are not neighbours. A vocabulary without counts can't be drawn from and is refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import vectors
from lumenframe.models.descent import MOST_BYTES, Checkpoints, Descended, Weights, descend
from lumenframe.operators.sampling import AliasTable


_ROWS = 1000  # rows whose pairs are found at once


def pairs_of(ids: list[int], window: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Centers and contexts at most `window` places apart, with no unknown word between them."""
    x = np.array([-1 if i is None or not 0 <= i < words else i for i in ids], np.int64)
    run = np.cumsum(x < 0)
    centers, contexts = [], []
    for d in range(1, min(window, len(x) - 1) + 1):
        near = (x[:-d] >= 0) & (x[d:] >= 0) & (run[:-d] == run[d:])
        a, b = x[:-d][near], x[d:][near]
        centers += [a, b]
        contexts += [b, a]
    return (np.concatenate(centers), np.concatenate(contexts)) if centers else (np.empty(0, np.int64),) * 2


def loss_of(noise: AliasTable, window: int, draws: int):
    """The loss of a batch and its slopes. weights: center and context (a vector for each id), bias. rows: ids, or their pairs (coded). `draws` noise words are
    drawn for a batch. The loss is the mean over the batch's pairs, times its rows, as rows are what descend() averages over."""
    shift, words = np.log(draws * noise.chances), len(noise.chances)

    def loss(weights: Weights, rows: pa.Table, rng: np.random.Generator) -> tuple[float, Weights]:
        size = weights["center"].shape[1]
        code, times = (_flat(rows["code"]), _flat(rows["times"])) if "code" in rows.column_names else _coded(rows["ids"], window, words)[1:]
        if not len(code):
            return 0.0, {k: np.zeros_like(w) for k, w in weights.items()}
        low, high = np.divmod(code, words)
        drawn, scale = noise.draw(rng.random(draws), rng.random(draws)), rows.num_rows / (2 * int(times.sum()))
        center, context, times = np.concatenate([low, high]), np.concatenate([high, low]), scale * np.concatenate([times, times])
        lift = weights["bias"] - shift
        u, v, n = weights["center"][center], weights["context"][context], weights["context"][drawn]
        true = np.einsum("ij,ij->i", u, v) + lift[context]
        lost, over = _plus(-true[:, None])
        over_true = -times * over[:, 0]
        # what the noise adds depends on the center alone: once for each of them, as often as it is one
        often = np.bincount(center, times, words)
        own = np.flatnonzero(often)
        held, often = weights["center"][own], often[own]
        lost_noise, over_false = _plus(held @ n.T + lift[drawn])
        over_false *= often[:, None]
        places = np.arange(size)
        spread = lambda at: (at[:, None] * size + places).ravel()
        by_center = np.bincount(spread(center), (over_true[:, None] * v).ravel(), words * size).reshape(words, size)
        by_center[own] += over_false @ n
        at = np.concatenate([context, drawn])
        by_context = np.bincount(spread(at), np.concatenate([over_true[:, None] * u, over_false.T @ held]).ravel(), words * size).reshape(words, size)
        by_bias = np.bincount(at, np.concatenate([over_true, over_false.sum(axis=0)]), words)
        return float(times @ lost + often @ lost_noise), {"center": by_center, "context": by_context, "bias": by_bias}

    return loss


def _plus(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of softplus over each row, and its slopes. Logarithms are taken of products, which a few hundred factors up to 2 allow."""
    small = np.exp(-np.abs(x))
    one = small + 1
    logs = np.log(one[:, 0]) if x.shape[1] == 1 else np.log(np.multiply.reduceat(one, range(0, x.shape[1], 512), axis=1)).sum(axis=1)
    return np.maximum(x, 0).sum(axis=1) + logs, np.where(x < 0, small, 1.0) / one


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks if len(c)] or [np.empty(0, np.int64)])


def _coded(ids: pa.ChunkedArray, window: int, words: int, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pairs_of() finds, as numbers lower * words + higher, once each, and how often each is met (in either direction): of all rows
    together or, with their places in front, of each row apart."""
    ids = pa.concat_arrays([c for c in ids.chunks if len(c)]) if any(len(c) for c in ids.chunks) else pa.array([], ids.type)
    sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = ids.flatten() if len(ids) else pa.array([], pa.int64())
    values = (values.fill_null(-1) if values.null_count else values).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    x = np.full(len(row), -1, np.int64)  # an unknown word after each row
    x[np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    x[x >= words] = -1
    run = np.cumsum(x < 0)
    codes, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, min(window, len(x) - 1) + 1):
        near = (x[:-d] >= 0) & (run[:-d] == run[d:])
        a, b = x[:-d][near], x[d:][near]
        codes.append(np.minimum(a, b) * words + np.maximum(a, b))
        rows.append(row[:-d][near])
    code, of = np.concatenate(codes), np.concatenate(rows)
    if not apart:
        code, times = np.unique(code, return_counts=True)
        return np.zeros(len(code), np.int64), code, times
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])][: len(code)])
    return of[first], code[first], np.diff(np.r_[first, len(code)])


def coded(df: DataFrame, key: str, window: int, words: int) -> DataFrame:
    """key, code and times: the pairs of each row of ids (those with null ids are left out), found once for all epochs."""
    kind = "int" if words * words < 1 << 31 else "bigint"

    def run(it):
        for batch in it:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                row, code, times = _coded(pa.chunked_array([part.column(1)]), window, words, apart=True)
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=part.num_rows))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(code, pa.int32() if kind == "int" else pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]
                yield pa.record_batch([part.column(0), *lists], names=[key, "code", "times"])

    return df.select(key, "ids").dropna().mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, code array<{kind}>, times array<int>")


def noise_of(vocabulary: DataFrame, distortion: float = 0.75) -> AliasTable:
    """The alias table of a vocabulary of ids 0, 1, ... and counts (id, cnt), each to the power `distortion`; collected after a count."""
    n = vocabulary.count()
    if n * 24 > MOST_BYTES:
        raise ValueError(f"{n} words are too many for one alias table")
    rows = vocabulary.select("id", "cnt").toArrow()
    ids = rows["id"].to_numpy()
    if sorted(ids.tolist()) != list(range(n)):
        raise ValueError("ids are 0, 1, ... without gaps")
    counts = np.zeros(n)
    counts[ids] = rows["cnt"].to_numpy()
    return AliasTable.of(counts, distortion)


def fit(df: DataFrame, vocabulary: DataFrame, size: int = 16, window: int = 2, draws: int = 32, distortion: float = 0.75, key: str = "row", seed: int = 0, checkpoint: Checkpoints | None = None, **steps) -> tuple[DataFrame, Descended]:
    """(id, vector) of the vocabulary's words, from rows of ids. vocabulary: id, cnt. steps: what descend() takes."""
    noise, rng = noise_of(vocabulary, distortion), np.random.default_rng(seed)
    n = len(noise.chances)
    first = {"center": rng.uniform(-1, 1, (n, size)), "context": rng.normal(0, 1 / math.sqrt(size), (n, size)), "bias": np.zeros(n)}
    found = descend(coded(df, key, window, n), loss_of(noise, window, draws), first, key=key, seed=seed, checkpoint=checkpoint, **steps)
    table = pa.table({"id": pa.array(np.arange(n)), "vector": pa.array(list(found.weights["center"]), pa.list_(pa.float64()))})
    return df.sparkSession.createDataFrame(table), found


def losses(pairs: DataFrame, drawn: DataFrame, words: DataFrame) -> DataFrame:
    """center, context, loss of each of the pairs (center, context). words: id, center and context (its vectors), bias, chance; drawn: the
    ids of the noise words, as often as drawn. What the noise adds depends on the center alone and is summed up once for each."""
    draws = drawn.groupBy("id").agg(F.count("*").alias("times"))
    total = draws.agg(F.sum("times")).first()[0] or 0
    shift = F.log(F.lit(float(total)) * F.col("chance")) if total else F.lit(0.0)
    known = words.select("id", F.col("center").alias("u"), F.col("context").alias("v"), (F.col("bias") - shift).alias("lift"))
    noise = draws.join(known, "id").select("times", F.col("v").alias("noise_v"), F.col("lift").alias("noise_lift"))  # at most `drawn` rows
    centers = pairs.select(F.col("center").alias("id")).distinct().join(known.select("id", "u"), "id")
    plus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    held = noise.agg(F.coalesce(F.collect_list(F.struct("times", "noise_v", "noise_lift")), F.array()).alias("noise"))
    summed = F.aggregate("noise", F.lit(0.0), lambda a, x: a + x["times"] * plus(vectors.dot(F.col("u"), x["noise_v"]) + x["noise_lift"]))
    apart = centers.crossJoin(F.broadcast(held)).select(F.col("id").alias("center"), "u", summed.alias("against"))  # one row, of the words drawn
    met = pairs.join(apart, "center").join(known.select(F.col("id").alias("context"), "v", "lift"), "context")
    return met.select("center", "context", (plus(-(vectors.dot(F.col("u"), F.col("v")) + F.col("lift"))) + F.col("against")).alias("loss"))
