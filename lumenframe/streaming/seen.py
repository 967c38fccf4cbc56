"""Dropping what has been seen, with a set that is emptied when it is full.

The rule: a key that is not in the set passes and is put in; when the set then holds more than `capacity` keys, it is emptied. So state is
bounded, at the price that a key may pass again after the set was emptied. Keys are dealt to `shards` sets by hash, each with its share
of the capacity, so that no task holds them all; one shard is the rule over all keys. Within a shard and micro-batch, rows go by `order`.

A shard's rows of one micro-batch are sorted together: size micro-batches (files or records a trigger) and shards to fit.

State is kept by transformWithState (its store is RocksDB), one entry a key, and survives restarts with the checkpoint.

Defined results: a null key is a key. Rows of a batch with equal order and key are one. A capacity below the number of shards is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

_ROWS = 100_000  # rows that are gone through and handed over at once
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Seen(StatefulProcessor):
    """The set is worked on in memory, which its capacity bounds; the store is asked for what the set holds, and gets what has changed,
    once a micro-batch, not for every row."""

    def __init__(self, capacity: int, whole: bool) -> None:
        self.capacity, self.whole = capacity, whole  # whole: keys are whole numbers, else text

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "key string", "at bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat([part.drop(columns="shard__") for part in rows], ignore_index=True)
        order = _ordered(found["order__"].to_numpy(), found["key__"], found["null__"])
        keys, null, found = found["key__"].to_numpy(), found["null__"].to_numpy(), found.drop(columns=["order__", "key__", "null__"])
        n = self.count.get()[0] if self.count.exists() else 0
        stored, emptied = n > 0, False
        asked = n > len(order)  # a large set and a small batch: keys are asked for one by one
        own = {self.name(x[0]) for x in self.keys.keys()} if stored and not asked else set()
        new = set()
        for low in range(0, len(order), _ROWS):
            at, passed = order[low : low + _ROWS], []
            for k, name, none in zip(at.tolist(), keys[at].tolist(), null[at].tolist(), strict=True):
                name = None if none else name
                if name in own:
                    continue
                own.add(name)
                if asked and self.keys.containsKey((_label(name),)):
                    continue
                passed.append(k)
                new.add(name)
                n += 1
                if n > self.capacity:
                    own, new, n, asked, emptied = set(), set(), 0, False, True
            if passed:
                yield found.iloc[passed]
        if emptied and stored:
            self.keys.clear()
        for name in new:
            self.keys.updateValue((_label(name),), (0,))
        self.count.update((n,))

    def name(self, label: str) -> int | str | None:
        return None if label == "null" else int(label[1:]) if self.whole else label[1:]

    def close(self) -> None:
        pass


def _label(name: int | str | None) -> str:
    """A key as the store has it."""
    return "null" if name is None else f"k{name}"


def _ordered(order: np.ndarray, keys: pd.Series, null: pd.Series) -> np.ndarray:
    """Places of rows by order, those without one last; ties go by the keys' labels."""
    at = np.argsort(order, kind="stable")
    held = order[at]
    same = (held[1:] == held[:-1]) | (np.isnan(held[1:]) & np.isnan(held[:-1]))
    if same.any():
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        labels = np.array([_label(None if n else k) for k, n in zip(keys.to_numpy()[at[tied]].tolist(), null.to_numpy()[at[tied]].tolist(), strict=True)], dtype=object)
        run = np.cumsum(np.r_[True, ~same])[tied]
        _, code = np.unique(labels, return_inverse=True)
        at[tied] = at[tied][np.lexsort((code, run))]
    return at


def unseen(source: DataFrame, key: str, order: str, capacity: int, shards: int = 8) -> DataFrame:
    """The rows of a stream whose key is not in its set. order: a number. Needs the RocksDB state store (with_store)."""
    if capacity < shards:
        raise ValueError(f"a capacity of {capacity} can't be shared out to {shards} shards")
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    whole = isinstance(source.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType))  # numbers stay numbers in the workers
    plain = F.coalesce(F.col(key).cast("long"), F.lit(0)) if whole else F.coalesce(F.col(key).cast("string"), F.lit(""))
    dealt = source.withColumn("order__", F.col(order).cast("double")).withColumn("key__", plain).withColumn("null__", F.col(key).isNull()).withColumn("shard__", F.pmod(F.xxhash64(name), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard__").transformWithStateInPandas(_Seen(capacity // shards, whole), source.schema, "Append", "None")


def with_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
