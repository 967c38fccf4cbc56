"""Row numbers, slices, batches, shuffles and caps, always over a stated order.

Row numbers are counted in two steps (rows of each range partition, then offsets), so that no single task sorts or holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.staging import staged

_RANGE = "__range"


def numbered(df: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """df with a number from 0 in the given order, which should be total.

    Rows are dealt to ranges of the order; each range is numbered by itself and raised by the number of rows in the ranges before it.
    Ranges are sampled, so the dealt rows are staged: sampled anew they would differ."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *keys).withColumn(_RANGE, F.spark_partition_id()))
    sizes = ranged.groupBy(_RANGE).agg(F.count("*").alias("__n"))  # one row a partition
    before = sizes.select(_RANGE, F.coalesce(F.sum("__n").over(Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*keys)) - 1
    return ranged.withColumn(name, local).join(F.broadcast(before), _RANGE).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop(_RANGE, "__before")


def slice_rows(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows start to end - 1; an end below 0 counts from the back."""
    if end < 0:
        end += df.count()
    return numbered(df, *order).filter((F.col("row") >= start) & (F.col("row") < end))


def batch_ids(df: DataFrame, order: list[str], size: int, tail: str = "keep") -> DataFrame:
    """df with row and batch_id. tail: keep the last short batch; drop it; or zip, which drops the last batch even if it is full."""
    if tail not in {"keep", "drop", "zip"}:
        raise ValueError(f"unknown tail {tail}")
    found = numbered(df, *order).withColumn("batch_id", F.floor(F.col("row") / size).cast("long"))
    if tail == "keep":
        return found
    n = df.count()
    return found.filter(F.col("batch_id") < (n // size if tail == "drop" else max(0, -(-n // size) - 1)))


def limit_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def draw(key: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the key and the seed, the same on every run and partitioning: the first 52 bits of the MD5 of `seed:key`."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with a row number in an order that the seed fixes."""
    return numbered(df.withColumn("__draw", draw(key, seed)), "__draw", key).drop("__draw")
