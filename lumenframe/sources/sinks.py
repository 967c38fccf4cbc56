"""Writers: idempotent appends, deletion requests, result files, posts, models as JSON lines. Nothing is written outside the given paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType
from pyspark.sql.utils import AnalysisException

from lumenframe.functions.text import one_line, tagged_prefix, time_of

#: How posts are written and read, so that quotes, backslashes and outer white space come back.
POST_CSV = {"sep": "\t", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def insert_ignore(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key the target lacks, once each: running it again adds nothing. Only keys within the range of the new ones'
    first column are read from the target, so that a batch of recent keys skips the files of old ones."""
    new, there = df.dropDuplicates(key), read_or_none(df.sparkSession, path)
    (new if there is None else new.join(_between(there, df, key[0]).select(*key).distinct(), key, "left_anti")).write.mode("append").parquet(path)


def _between(there: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Rows of `there` that may equal one of df in the column; a filter that reaches the scan, where both have one type that orders."""
    kind = df.select(column).schema[0].dataType
    if not isinstance(kind, (DateType, IntegralType, StringType)) or there.select(column).schema[0].dataType != kind:
        return there
    least, most = df.agg(F.min(column), F.max(column)).first()
    return there.filter(F.col(column).between(F.lit(least), F.lit(most)))


def insert_ignore_jdbc(df: DataFrame, url: str, table: str, key: list[str], properties: dict[str, str]) -> None:
    """The same into a database table; the table's own key still guards against writers that run at once."""
    there = df.sparkSession.read.jdbc(url, table, properties=properties).select(*key)  # Spark asks for these columns alone, quoted as the database does
    df.dropDuplicates(key).join(there, key, "left_anti").write.jdbc(url, table, mode="append", properties=properties)


def deletion_requests(df: DataFrame, path: str, enabled: bool = False) -> None:
    """Appends thread, post, user and forum ids for a deleter to pick up; off unless enabled. Nothing is deleted here."""
    if enabled:
        df.select("thread_id", "post_id", "uid", "forum_id").write.mode("append").option("sep", "\t").csv(path)


def delete_where(spark: SparkSession, path: str, where: Column, to: str) -> None:
    """The table at `path` without the rows that fit, as a table of its own at `to`: rows for which the predicate is null stay."""
    spark.read.parquet(path).filter(~F.coalesce(where, F.lit(False))).write.mode("overwrite").parquet(to)


def scored_rows(df: DataFrame) -> DataFrame:
    """Rows of scored posts for the store: the creation time in text, and score, posts, age and threshold before the content."""
    age = F.col("now_time") - F.col("create_time")
    return df.withColumn("content", tagged_prefix([F.col("score"), F.col("num_posts"), age, F.col("thre")], F.col("content"))).withColumn("created", time_of(F.col("create_time")))


def write_results(df: DataFrame, path: str, names: list[str], columns: list[str]) -> None:
    df.select(*names, *columns).write.mode("overwrite").option("sep", "\t").csv(path)


def label_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """label (1 for more than 0, else 0) and score."""
    return df.select((F.col(label) > 0).cast("int").alias("label"), F.col(score).alias("score"))


def append_summary(df: DataFrame, path: str, step: int) -> None:
    """Appends the metrics of a step (a frame of one row, a column for each) as rows of step, name and value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns)))
    df.select(F.lit(step).alias("step"), pairs.alias("m")).select("step", "m.*").write.mode("append").parquet(path)


def append_posts(df: DataFrame, path: str) -> None:
    df.select("pid", one_line(F.col("title")).alias("title"), one_line(F.col("content")).alias("content")).write.mode("append").options(**POST_CSV).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
