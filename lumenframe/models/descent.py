"""Training by mini-batches in partitions, with weights that can be kept and taken up again.

Rows are dealt to parts by their key. In an epoch every part starts from the same weights, goes through its rows in an order drawn for
that epoch, and takes a step after each batch; then the parts' weights are averaged, each by its rows. So an epoch moves one vector of
the model's size a part, whatever the number of rows; parts are streamed, and no task holds more than one batch. One part is plain
mini-batch descent. Orders and parts follow from keys and seeds alone, so a lost executor's part is done again with the same result.

Defined results: rows with a null label or features take no part; keys are distinct (equal ones may swap places). No rows: the weights
come back as they were. A checkpoint folder that holds steps already is continued from the last; what a killed run had begun to write has
no final name and is not seen.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.batching import draw
from lumenframe.operators.staging import staged

Weights = dict[str, np.ndarray]
#: (weights, batch, random numbers of the batch) -> (sum of losses, sums of gradients)
Gradient = Callable[[Weights, pa.Table, np.random.Generator], tuple[float, Weights]]
#: The most bytes of weights and optimiser sums that are sent to every part.
MOST_BYTES = 128 << 20
_BLOCK = 4096


@dataclass
class Optimiser:
    """One step of plain descent, Adagrad or Adam for a vector of weights."""

    kind: str
    rate: float
    steps: float = 0
    first: Any = 0.0
    second: Any = 0.0

    def __post_init__(self) -> None:
        if self.kind not in ("descent", "adagrad", "adam"):
            raise ValueError(f"unknown optimiser {self.kind}")

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        if self.kind == "descent":
            return weights - self.rate * gradient
        if self.kind == "adagrad":
            self.second = (self.second if self.steps > 1 else 0.1) + gradient**2
            return weights - self.rate * gradient / np.sqrt(self.second)
        self.first, self.second = 0.9 * self.first + 0.1 * gradient, 0.999 * self.second + 0.001 * gradient**2
        spread = np.sqrt(self.second / (1 - 0.999**self.steps))
        spread += 1e-8
        return weights - self.rate / (1 - 0.9**self.steps) * (self.first / spread)

    def sums(self, size: int) -> np.ndarray:
        """What the next step depends on besides the weights, as one vector."""
        return np.concatenate([[float(self.steps)], *(np.broadcast_to(np.asarray(x, np.float64), size) for x in self._kept())])

    def with_sums(self, sums: np.ndarray) -> Optimiser:
        parts = np.split(sums[1:], max(1, len(self._kept())))
        found = Optimiser(self.kind, self.rate, float(sums[0]))
        if self.kind == "adagrad":
            found.second = parts[0]
        elif self.kind == "adam":
            found.first, found.second = parts
        return found

    def _kept(self) -> list:
        return {"descent": [], "adagrad": [self.second], "adam": [self.first, self.second]}[self.kind]


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([np.asarray(w, np.float64).ravel() for w in weights.values()]) if weights else np.empty(0)


def shaped(vector: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for name, w in like.items():
        size = int(np.size(w))
        out[name] = vector[at : at + size].reshape(np.shape(w))
        at += size
    return out


@dataclass
class Checkpoints:
    """Steps of a training run in a folder: each is written whole under a name of its own and then renamed, so a reader sees it all or not
    at all (where renaming a folder is atomic, as on HDFS and local disks; elsewhere a step counts once Spark has marked it complete)."""

    spark: SparkSession
    folder: str
    keep: int = 2

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(self.folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, at

    def steps(self) -> list[int]:
        fs, path, at = self._fs()
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"step-(\d{10})", n)) and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def save(self, step: int, arrays: Weights, facts: dict | None = None) -> None:
        fs, path, _ = self._fs()
        rows: dict[str, list] = {"name": [], "at": [], "shape": [], "held": [], "facts": []}
        for name, array in [*arrays.items(), ("", np.empty(0))]:
            values = np.asarray(array, np.float64).ravel()
            for at in range(0, max(1, len(values)), 1 << 16):
                for column, value in zip(rows.values(), [name, at, list(np.shape(array)), values[at : at + (1 << 16)], None if name else json.dumps(facts or {})], strict=True):
                    column.append(value)
        schema = pa.schema([("name", pa.string()), ("at", pa.int64()), ("shape", pa.list_(pa.int64())), ("held", pa.list_(pa.float64())), ("facts", pa.string())])
        writing, final = f"{self.folder}/.writing-{uuid.uuid4().hex}", f"{self.folder}/step-{step:010d}"
        self.spark.createDataFrame(pa.table({k: pa.array(v, schema.field(k).type) for k, v in rows.items()}, schema=schema)).coalesce(1).write.parquet(writing)
        if fs.exists(path(final)) or not fs.rename(path(writing), path(final)):  # another attempt was first: its step is the same
            fs.delete(path(writing), True)
        for old in self.steps()[: -self.keep]:
            fs.delete(path(f"{self.folder}/step-{old:010d}"), True)

    def latest(self) -> tuple[int, Weights, dict] | None:
        """The last whole step: its number, arrays and facts."""
        steps = self.steps()
        if not steps:
            return None
        rows = self.spark.read.parquet(f"{self.folder}/step-{steps[-1]:010d}").orderBy("name", "at").collect()  # of a model's size
        parts: dict[str, list] = {}
        shapes = {r["name"]: r["shape"] for r in rows}
        for r in rows:
            parts.setdefault(r["name"], []).append(np.array(r["held"], np.float64))
        arrays = {name: np.concatenate(held).reshape(shapes[name]) for name, held in parts.items() if name}
        return steps[-1], arrays, json.loads(next(r["facts"] for r in rows if not r["name"]))


@dataclass
class Descended:
    weights: Weights
    losses: list[float] = field(default_factory=list)  # the mean over the rows of each epoch, as they were met


def descend(rows: DataFrame, gradient: Gradient, weights: Weights, key: str = "row", optimiser: str = "descent", rate: float = 0.1, batch: int = 64, epochs: int = 5, parts: int = 8, seed: int = 0, checkpoint: Checkpoints | None = None, after: Callable[[int, float, Weights], bool] | None = None) -> Descended:
    """Mini-batch descent over rows; see the module's docstring. The columns of rows but the key reach `gradient` as an Arrow table of
    at most `batch` rows. after(epoch, mean loss, weights): called after each epoch; true ends the training."""
    start, one = flat(weights), Optimiser(optimiser, rate)
    size = len(start)
    if (kept := size * 8 * (1 + len(one._kept()))) > MOST_BYTES:
        raise ValueError(f"weights of {kept} bytes are too many to be sent to every part; the most are {MOST_BYTES}")
    state, losses, first = np.concatenate([start, one.sums(size)]), [], 0
    if checkpoint is not None and (found := checkpoint.latest()) is not None:
        first, arrays, facts = found
        state, losses = arrays["state"], facts["losses"]
        if facts.get("ended"):
            return Descended(shaped(state[:size], weights), losses)
    dealt = staged(rows.dropna().withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartitionById(parts, "__part"))  # by hash, one task would get several parts
    names = [c for c in rows.columns if c != key]
    for epoch in range(first, epochs):
        now = rows.sparkSession.sparkContext.broadcast(state)
        ordered = dealt.withColumn("__order", draw(key, seed + epoch)).sortWithinPartitions("__part", "__order", key)
        made = ordered.select("__part", *names).mapInArrow(_epoch(gradient, weights, one, now, batch, seed, epoch), "block int, n double, held array<double>")
        summed = made.groupBy("block").applyInArrow(_added, "block int, n double, held array<double>").toArrow().sort_by("block")
        now.unpersist()
        if not summed.num_rows:
            break
        total = summed["n"][0].as_py()
        mean = np.concatenate([np.asarray(x) for x in summed["held"].to_pylist()]) / total
        state, loss = mean[:-1], float(mean[-1])
        losses.append(loss)
        ended = bool(after and after(epoch, loss, shaped(state[:size], weights)))
        if checkpoint is not None:
            checkpoint.save(epoch + 1, {"state": state}, {"losses": losses, "ended": ended})
        if ended:
            break
    return Descended(shaped(state[:size], weights), losses)


def _epoch(gradient: Gradient, like: Weights, one: Optimiser, now, batch: int, seed: int, epoch: int):
    """A part's weights after the epoch and its loss, times its rows, in blocks; a task may be dealt several parts."""
    size = sum(int(np.size(w)) for w in like.values())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kept = None, [], 0
        vector = loss = rows = steps = optimiser = None

        def step(table: pa.Table) -> None:
            nonlocal vector, loss, rows, steps
            found, slope = gradient(shaped(vector, like), table, np.random.default_rng([seed, epoch, part, steps]))
            vector = optimiser.step(vector, flat({k: slope[k] for k in like}) / table.num_rows)
            loss, rows, steps = loss + found, rows + table.num_rows, steps + 1

        def begin(number: int) -> None:
            nonlocal part, vector, loss, rows, steps, optimiser
            part, vector, loss, rows, steps = number, now.value[:size].copy(), 0.0, 0, 0
            optimiser = one.with_sums(now.value[size:])

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal held, kept
            if kept:
                step(pa.Table.from_batches(held))
            held, kept = [], 0
            if rows:
                out = np.concatenate([np.concatenate([vector, optimiser.sums(size)]) * rows, [loss]])
                blocks = [out[at : at + _BLOCK] for at in range(0, len(out), _BLOCK)]
                yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([float(rows)] * len(blocks)), pa.array(blocks, pa.list_(pa.float64()))], names=["block", "n", "held"])

        for b in it:
            numbers = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if part != numbers[low]:
                    if part is not None:
                        yield from end()
                    begin(int(numbers[low]))
                own = pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:]).slice(low, high - low)
                while own.num_rows:
                    take = min(batch - kept, own.num_rows)
                    held, kept, own = [*held, own.slice(0, take)], kept + take, own.slice(take)
                    if kept == batch:
                        step(pa.Table.from_batches(held))
                        held, kept = [], 0
        if part is not None:
            yield from end()

    return run


def _added(key: tuple, found: pa.Table) -> pa.Table:
    """The parts' sums of one block: at most one row a part, of _BLOCK numbers."""
    rows = sorted(zip(found["n"].to_pylist(), found["held"].to_pylist(), strict=True))  # an order of its own, so that sums repeat
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(n for n, _ in rows)]), pa.array([np.sum([np.array(x) for _, x in rows], axis=0)], pa.list_(pa.float64()))], names=["block", "n", "held"])


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The rows of an array column as a matrix of this width."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any() or column.flatten().null_count:
        raise ValueError(f"features are arrays of one length (here {width}) without nulls")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def logistic_loss(weights: Weights, rows: pa.Table, _: np.random.Generator) -> tuple[float, Weights]:
    """weights: w (of the features), b (1). rows: features, label (0 or 1)."""
    x, y = matrix(rows["features"], len(weights["w"])), rows["label"].to_numpy().astype(np.float64)
    z = x @ weights["w"] + weights["b"]
    over = 1 / (1 + np.exp(-z)) - y
    return float((softplus(z) - y * z).sum()), {"w": over @ x, "b": np.array([over.sum()])}


def _softmax(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of losses, and the slopes of the logits."""
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = float((np.log(np.exp(z).sum(axis=1)) - z[at, y]).sum())
    p[at, y] -= 1
    return loss, p


def softmax_loss(weights: Weights, rows: pa.Table, _: np.random.Generator) -> tuple[float, Weights]:
    """weights: w (features x classes), b (classes). rows: features, label (0, 1, ...)."""
    x, y = matrix(rows["features"], len(weights["w"])), rows["label"].to_numpy().astype(int)
    loss, over = _softmax(x @ weights["w"] + weights["b"], y)
    return loss, {"w": x.T @ over, "b": over.sum(axis=0)}


def hidden_loss(weights: Weights, rows: pa.Table, _: np.random.Generator) -> tuple[float, Weights]:
    """A layer of tanh units (w0, b0) below softmax_loss (w, b)."""
    x, y = matrix(rows["features"], len(weights["w0"])), rows["label"].to_numpy().astype(int)
    h = np.tanh(x @ weights["w0"] + weights["b0"])
    loss, over = _softmax(h @ weights["w"] + weights["b"], y)
    back = (over @ weights["w"].T) * (1 - h * h)
    return loss, {"w0": x.T @ back, "b0": back.sum(axis=0), "w": h.T @ over, "b": over.sum(axis=0)}
