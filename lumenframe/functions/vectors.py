"""Vectors as arrays: products, norms, slices, sparse and dense forms. Pure Column expressions, but for table lookups, which are joins.

Null arrays give null. Elements are taken as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    """Sum over a row's elements; 0 of none."""
    return F.aggregate(doubles(x), F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def dot(x: Column, w: Column) -> Column:
    return total(F.zip_with(doubles(x), doubles(w), lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalised(x: Column) -> Column:
    """Unit vector; null for the zero vector."""
    return F.zip_with(doubles(x), F.array_repeat(F.nullif(norm(x), F.lit(0.0)), F.size(x)), lambda v, n: v / n)  # the norm once a row


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def scale(a: Column, by) -> Column:
    return F.transform(doubles(a), lambda x: x * by)


def maximum(a: Column, b: Column) -> Column:
    """Element by element."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: F.greatest(x, y))


def ones_like(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(1.0))


def zero_out(a: Column) -> Column:
    """Keeps the first element and makes the rest 0."""
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(F.lit(0).cast("double")))


def section(a: Column, begin: int, size: int) -> Column:
    """Elements begin (from 0) to begin + size - 1."""
    return F.slice(a, begin + 1, size)


def reshape(a: Column, width: int) -> Column:
    """Rows of `width` elements; the last may be shorter."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(a, s + 1, width))


def argmax(a: Column) -> Column:
    """Position (from 0) of the greatest element, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def matrix_times(x: Column, columns: list[list[float]]) -> Column:
    """A row times a small matrix given by its columns: an array of as many products."""
    return F.array(*(dot(x, F.array(*(F.lit(float(v)) for v in c))) for c in columns))


def to_dense(ids: Column, weights: Column, size: int | Column) -> Column:
    """Zeros but for the ids' weights; of an id that repeats the last weight stands. Ids outside 0..size-1 are ignored."""
    size = F.lit(size) if isinstance(size, int) else size

    def at(i: Column) -> Column:
        hits = F.filter(F.arrays_zip(ids.alias("i"), weights.alias("w")), lambda p: p["i"] == i)
        return F.coalesce(F.element_at(F.transform(hits, lambda p: p["w"].cast("double")), -1), F.lit(0.0))

    positions = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.when(F.array_contains(ids, i), at(i)).otherwise(F.lit(0.0)))


def to_sparse(x: Column) -> Column:
    """Struct of ids and weights of what isn't 0."""
    pairs = F.filter(F.transform(doubles(x), lambda v, i: F.struct(i.alias("i"), v.alias("w"))), lambda p: p["w"] != 0)
    return F.struct(F.transform(pairs, lambda p: p["i"]).alias("ids"), F.transform(pairs, lambda p: p["w"]).alias("weights"))


def is_sparse(x: Column, threshold: float = 0.5) -> Column:
    """Whether a row is better kept sparse: its share of non-zero elements is below the threshold."""
    return F.size(F.filter(x, lambda v: v != 0)) < threshold * F.size(x)


def coordinates(df: DataFrame, row: str, ids: str, weights: str) -> DataFrame:
    """row, pos, id, weight: one row for each entry. An empty vector has one entry, of id 0 and weight 0, so that no row is lost."""
    pairs = F.arrays_zip(F.col(ids).alias("id"), F.col(weights).alias("weight"))
    long = df.select(F.col(row), F.posexplode_outer(pairs).alias("pos", "entry"))
    return long.select(row, F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce(F.col("entry.id"), F.lit(0)).cast("long").alias("id"), F.coalesce(F.col("entry.weight").cast("double"), F.lit(0.0)).alias("weight"))


def lookup_sum(df: DataFrame, row: str, ids: str, table: DataFrame, weights: str | None = None, combiner: str = "sum") -> DataFrame:
    """row, total: the (weighted) sum or mean of the table's values at a row's ids. table: id, value. Ids that the table lacks and empty
    rows add nothing: their sum is 0 and their mean null. Spark broadcasts the table only if it is small."""
    if combiner not in {"sum", "mean"}:
        raise ValueError(f"unknown combiner {combiner}")
    given = F.col(weights) if weights else F.transform(F.col(ids), lambda i: F.lit(1.0))
    long = df.select(F.col(row), F.posexplode_outer(F.arrays_zip(F.col(ids).alias("id"), given.alias("w"))).alias("pos", "e")).select(row, F.col("e.id").alias("id"), F.col("e.w").cast("double").alias("w"))
    joined = long.join(table.select("id", "value"), "id", "left")
    amount = F.sum(F.col("w") * F.col("value"))
    found = F.coalesce(amount, F.lit(0.0)) if combiner == "sum" else amount / F.sum(F.when(F.col("value").isNotNull(), F.col("w")))
    return joined.groupBy(row).agg(found.alias("total"))


def column_totals(df: DataFrame, x: str, by: tuple[str, ...] = (), how: str = "sum") -> DataFrame:
    """by, pos, total: the sum, mean, max or min of each position over rows (or groups of rows). Partial results meet before the shuffle."""
    long = df.select(*by, F.posexplode(x).alias("pos", "v"))
    return long.groupBy(*by, "pos").agg({"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how](F.col("v").cast("double")).alias("total"))
