"""A table of strings and their values, held by every worker as far as it fits a stated size; what is beyond is left for a join.

The strings most used come first. Workers hold 64-bit hashes and packed values, not the strings: a string whose hash another one shares
is left for the join as well, so an answer is never another string's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_hash(key: str) -> int:
    """What F.xxhash64 gives for the string."""
    found = xxhash.xxh64_intdigest(key.encode(), 42)
    return found - (1 << 64) if found >> 63 else found


@dataclass
class Packed:
    """Hashes in order, and for each a slice of values."""

    hashes: np.ndarray
    ends: np.ndarray
    values: np.ndarray

    def get(self, key: str) -> np.ndarray | None:
        h = key_hash(key)
        at = int(np.searchsorted(self.hashes, h))
        if at == len(self.hashes) or self.hashes[at] != h:
            return None
        return self.values[self.ends[at - 1] if at else 0 : self.ends[at]]


def split(table: DataFrame, key: str, values: str, weight: str, most_bytes: int, item_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(head, tail) of a staged table with distinct keys and an array of values each: the head has at most most_bytes once packed, its
    keys being of the greatest weights; the tail is None if nothing is left. Head: hash, values; tail: as the table."""
    named = table.withColumn("hash", F.xxhash64(key)).withColumn("size", F.lit(12) + F.size(values) * item_bytes).withColumn("class", F.floor(F.log2(F.greatest(F.col(weight), F.lit(1)))).cast("int"))
    classes = sorted(((r["class"], r["size"]) for r in named.groupBy("class").agg(F.sum("size").alias("size")).collect()), reverse=True)  # at most 64 rows
    least, total = 64, 0
    for found, size in classes:
        if total + size > most_bytes:
            break
        least, total = found, total + size
    whole = not classes or least == classes[-1][0]
    twins = named.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash").collect()  # of n keys about n * n / 2**65
    alone = ~F.col("hash").isin([r["hash"] for r in twins]) if twins else F.lit(True)
    inside = (F.col("class") >= least) & alone
    head = named.filter(inside).select("hash", F.col(values).alias("values"))
    return head, None if whole and not twins else named.filter(~inside).select(*table.columns)


def packed(head: DataFrame, kind: type) -> Packed:
    """The head, collected; its size is bounded by split()."""
    got = head.toArrow().combine_chunks()
    hashes, lists = got["hash"].to_numpy(), got["values"]
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks != 1 else lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    order = np.argsort(hashes, kind="stable")
    lists = lists.take(pa.array(order))
    return Packed(hashes[order], lists.offsets.to_numpy()[1:].astype(np.uint32), lists.flatten().to_numpy(zero_copy_only=False).astype(kind))
