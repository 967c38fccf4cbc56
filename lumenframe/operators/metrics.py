"""Evaluation as aggregates. Sums are doubles; ratios of nothing are null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.mathfn import log_sum
from lumenframe.operators.staging import staged


def auc(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, auc: the chance that a row with label > 0 scores above one without, ties counted half; NaN where either kind is missing.

    Rows are first counted by score, so that what is sorted grows with distinct scores alone. The counts are dealt to ranges of group and
    score (staged, as ranges are sampled); running counts are taken within each range and raised by those of the group's ranges before
    it, so that no task holds a whole group."""
    y = (F.col(label) > 0).cast("long")
    counts = df.groupBy(*by, score).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(counts.repartitionByRange(parts, *by, score).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("part").alias("__part"), before.alias("before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("part") == F.col("__part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    ranked = ranged.withColumn("own", own).join(offsets, same).withColumn("below", F.col("own") + F.col("before"))
    pairs = (F.sum("p") * F.sum("n")).cast("double")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return ranked.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).otherwise(F.lit(float("nan"))).alias("auc"))


def logit_loss(z: Column, y: Column) -> Column:
    """Sigmoid cross-entropy of a logit, stable for large ones."""
    z, y = z.cast("double"), y.cast("double")
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def log_loss(p: Column, y: Column, clip: float = 0.0) -> Column:
    """Cross-entropy of a probability, held within clip..1 - clip; unclipped it may be infinite."""
    p = F.greatest(F.least(p.cast("double"), F.lit(1 - clip)), F.lit(clip))
    return -F.when(y > 0, F.log(p)).otherwise(F.log(1 - p))


def softmax_loss(z: Column, y: Column) -> Column:
    """Cross-entropy of an array of logits and a class number."""
    return log_sum(z) - F.get(z, y)


def nll(p: Column, y: Column) -> Column:
    return -F.log(F.get(p, y))


def in_top_1(z: Column, y: Column) -> Column:
    """Whether the class's value is the greatest; ties count as correct."""
    return F.get(z, y) >= F.array_max(z)


def losses(df: DataFrame, label: str, logit: str, by: tuple[str, ...] = ()) -> DataFrame:
    """loss_sum and loss_mean of the sigmoid cross-entropy."""
    return df.groupBy(*by).agg(F.sum(logit_loss(F.col(logit), F.col(label))).alias("loss_sum"), F.avg(logit_loss(F.col(logit), F.col(label))).alias("loss_mean"))


def precision_at_1(df: DataFrame, label: str, logits: str) -> DataFrame:
    return df.agg(F.avg(in_top_1(F.col(logits), F.col(label)).cast("double")).alias("precision_at_1"))


def zero_one(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Share of wrong predictions. Both columns must be whole numbers."""
    kinds = dict(df.dtypes)
    if not {kinds[label], kinds[predicted]} <= {"tinyint", "smallint", "int", "bigint"}:
        raise TypeError("labels and predictions must be whole numbers")
    return df.agg(F.avg((F.col(label) != F.col(predicted)).cast("double")).alias("error"))


def batch_mean_accuracy(df: DataFrame, batch: str, hit: str) -> DataFrame:
    """batch_mean: the mean over batches of their means, in which a short batch counts as much as others; row_mean: that of all rows."""
    per = df.groupBy(batch).agg(F.avg(F.col(hit).cast("double")).alias("m"), F.sum(F.col(hit).cast("double")).alias("s"), F.count(hit).alias("n"))
    return per.agg(F.avg("m").alias("batch_mean"), (F.sum("s") / F.sum("n")).alias("row_mean"))


def penalties(df: DataFrame, weight: str) -> DataFrame:
    return df.agg(F.sum(F.abs(weight)).alias("l1"), F.sum(F.pow(F.col(weight), F.lit(2.0))).alias("l2_squared"))


def running_ratio(df: DataFrame, order: str, hit: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """df with hits so far, rows so far and their ratio, in order (which should be total) within each group; a null hit is none, null
    groups are groups. Rows are dealt to ranges of the order; a group is counted within each range and raised by its counts of the ranges
    before, so that no task holds all rows of a hot group. Ranges are sampled, so the dealt rows are staged."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__hit", F.coalesce(hit.cast("long"), F.lit(0).cast("long"))).repartitionByRange(parts, order)
    ranged = staged(dealt.withColumn("__range", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a group
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__hit").alias("__hits"), F.count("*").alias("__rows"))
    zero = F.lit(0).cast("long")
    before = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__r"), F.coalesce(F.sum("__hits").over(earlier), zero).alias("__hits_before"), F.coalesce(F.sum("__rows").over(earlier), zero).alias("__rows_before"))
    upto = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("hits", F.sum("__hit").over(upto)).withColumn("seen", F.count("*").over(upto))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    met = local.join(before, [F.col("__range") == F.col("__r"), *same])
    raised = met.withColumn("hits", F.col("hits") + F.col("__hits_before")).withColumn("seen", F.col("seen") + F.col("__rows_before"))
    return raised.select(*df.columns, "hits", "seen", (F.col("hits") / F.col("seen")).alias("ratio"))


def num_classes(df: DataFrame, label: str) -> DataFrame:
    return df.agg((F.max(label) + 1).cast("int").alias("num_classes"))


def periodic_average(df: DataFrame, step: str, value: str, every: int) -> DataFrame:
    return df.groupBy(F.floor(F.col(step) / every).cast("long").alias("period")).agg(F.avg(value).alias("average"))
