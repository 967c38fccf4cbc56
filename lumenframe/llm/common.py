"""What the operators of this subpackage share: tables, staging, checked broadcasts, text kernels."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.staging import shared_dir

#: The most rows of a few numbers each (about 32 MB once hashed) that an operator broadcasts after counting them.
BROADCAST_ROWS = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; Spark's lower() also folds other alphabets."""
    return F.translate(c, UPPER, LOWER)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends here, an executor's loss costs no recomputation,
    and the planner knows the size. Spark deletes the files when the session's file system closes."""
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(where)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, and 80 bytes a row of `most` in its texts and arrays; else as it is, for a
    shuffled join. Pass a staged df: it is counted."""
    wide = [c for c, t in df.dtypes if t.startswith(("string", "binary", "array", "map", "struct"))]
    if wide:
        held = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in wide))))), F.lit(0)).alias("size")).first()
        return F.broadcast(df) if held["n"] <= most and held["size"] <= 80 * most else df
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


#: The names of a row of documents: its id (null made a number) and its text's hash.
ROW_KEYS = ["id_key", "text_key"]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id (long), id_key, text_key and text of every row of docs."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id_key"), F.xxhash64("text").alias("text_key"), "text")


def wide_enough(df: DataFrame) -> DataFrame:
    """A staged table may be one small file; what follows is heavy work by row, so it is dealt out again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def batches(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of each batch, so that what a kernel makes of one stays small."""
    for b in it:
        for at in range(0, max(1, b.num_rows), rows):
            if (piece := b.slice(at, rows)).num_rows:
                yield piece


# --- Hashes of substrings: sums of random values of bytes times powers, so that any substring's hash is a difference of two prefixes.

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_GROWN: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _GROWN.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _GROWN[name] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """For substring_hash: one value more than data (uint8) has bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("up", _BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    down = _powers("down", pow(_BASE, -1, 1 << 64), len(sums) + 1)
    return mixed((sums[end] - sums[start]) * down[start])


def add_columns(df: DataFrame, inputs: list[str], fields: list[pa.Field], kernel, rows: int = 512) -> DataFrame:
    """df with new columns (older ones of the same names go, whatever their case) that `kernel` makes of lists of the input columns.

    kernel: called on a worker for up to `rows` rows; returns a list of values for each field."""
    from pyspark.sql.pandas.types import from_arrow_schema

    new = {f.name.lower() for f in fields}
    names = [c for c in df.columns if c.lower() not in new or c in inputs]
    kept = [c for c in names if c.lower() not in new]
    given = df.select(*(F.col(f"`{c}`") for c in names))
    schema = given.select(*(F.col(f"`{c}`") for c in kept)).schema
    for f in from_arrow_schema(pa.schema(fields)).fields:
        schema.add(f)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, rows):
            columns = dict(zip(names, batch.columns, strict=True))
            made = kernel(*(columns[c].to_pylist() for c in inputs))
            arrays = [columns[c] for c in kept] + [pa.array(v, f.type) for v, f in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return given.mapInArrow(run, schema)
