"""Readers of delimited feature files: dense, index-only and sparse lines, sniffed from the first line, and their writers.

A line's kind: `#` first means a header, and then dense values; else a `:` after the first character means sparse, and a line without
any `.` index-only. A first column that starts with `_` is an id, and the label follows it. Only the first line reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators.batching import numbered
from lumenframe.sources.sinks import POST_CSV

SEPARATORS = {"tab": "\t", "space": " ", "comma": ",", ",": ",", ";": ";", " ": " ", "\t": "\t"}

#: Record files: a label, ids and values.
RECORD = T.StructType([T.StructField("label", T.LongType()), T.StructField("index", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.FloatType()))])
POST = "pid string, title string, content string"
POST_RECORD = "forumId long, threadId long, postId long, createTime long, title string, content string, userName string, forumName string, userId long, ip string"
SCORED_POST = "thread_id long, post_id long, uid long, forum_id long, ip string, create_time long, score double, title string, content string, forum string, uname string, now_time long, num_posts long, thre double"


@dataclass
class Dataset:
    """A parsed frame and what its columns alone don't say."""

    df: DataFrame
    kind: str
    num_features: int
    total_features: int
    num_classes: int
    index_only: bool
    names: tuple[str, ...] = ()


@dataclass
class Layout:
    kind: str
    has_header: bool
    label: int


def sniff(line: str) -> Layout:
    """The layout that a file's first line implies."""
    has_header = line.startswith("#")
    kind = "dense" if has_header else "sparse" if line.find(":") > 0 else "dense" if "." in line else "index_only"
    return Layout(kind, has_header, 1 if line.startswith(("_", "#id")) else 0)


def sniff_column(line: Column) -> Column:
    """sniff() of each line as a struct: kind, has_header, label."""
    header = line.startswith("#")
    kind = F.when(header, "dense").when(F.instr(line, ":") > 1, "sparse").when(F.instr(line, ".") > 0, "dense").otherwise("index_only")
    return F.struct(kind.alias("kind"), header.alias("has_header"), F.when(line.startswith("_") | line.startswith("#id"), 1).otherwise(0).alias("label"))


def split_line(line: Column, separator: str | None = None) -> Column:
    """Tokens of a line: between white space, or at a separator."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+$", "")), r"\s+" if separator is None else re.escape(SEPARATORS.get(separator, separator)))


def parse_dense(line: Column, label: int = 0, separator: str | None = None) -> Column:
    """Struct of label and features."""
    tokens = split_line(line, separator)
    values = F.transform(F.slice(tokens, label + 2, F.greatest(F.size(tokens) - label - 1, F.lit(0))), lambda t: t.cast("double"))
    return F.struct(F.get(tokens, label).cast("double").alias("label"), values.alias("features"))


def parse_index_only(line: Column, label: int = 0) -> Column:
    """Struct of label, total_features (the vocabulary's size) and ids, in their order and with repeats."""
    tokens = split_line(line)
    ids = F.transform(F.slice(tokens, label + 3, F.greatest(F.size(tokens) - label - 2, F.lit(0))), lambda t: t.cast("int"))
    return F.struct(F.get(tokens, label).cast("double").alias("label"), F.get(tokens, label + 1).cast("int").alias("total_features"), ids.alias("ids"))


def parse_sparse(line: Column, label: int = 0, first_index: int = 0) -> Column:
    """Struct of label, num_features, ids and weights, from `label n id:weight ...`. first_index is taken off every id."""
    tokens = split_line(line)
    return F.struct(F.get(tokens, label).cast("double").alias("label"), F.get(tokens, label + 1).cast("int").alias("num_features"), *_pairs(tokens, label + 2, first_index))


def parse_raw(line: Column, label: int = 0) -> Column:
    """Struct of label, num_features and tokens, from `label n id:weight ...`, the tokens as they stand."""
    tokens = split_line(line)
    rest = F.slice(tokens, label + 3, F.greatest(F.size(tokens) - label - 2, F.lit(0)))
    return F.struct(F.get(tokens, label).cast("double").alias("label"), F.get(tokens, label + 1).cast("int").alias("num_features"), rest.alias("tokens"))


def parse_prediction(line: Column) -> Column:
    """Struct of id, label, num_features, ids and weights, from `_id label n id:weight ...`."""
    tokens = split_line(line)
    return F.struct(F.get(tokens, 0).alias("id"), F.get(tokens, 1).cast("double").alias("label"), F.get(tokens, 2).cast("int").alias("num_features"), *_pairs(tokens, 3, 0))


def parse_libsvm(line: Column, first_index: int = 1) -> Column:
    """Struct of label, ids (from 0) and weights, from `label id:weight ...`."""
    tokens = split_line(line)
    return F.struct(F.get(tokens, 0).cast("double").alias("label"), *_pairs(tokens, 1, first_index))


def _pairs(tokens: Column, begin: int, first_index: int) -> tuple[Column, Column]:
    rest = F.filter(F.slice(tokens, begin + 1, F.greatest(F.size(tokens) - begin, F.lit(0))), lambda t: t != "")
    ids = F.transform(rest, lambda t: (F.substring_index(t, ":", 1).cast("int") - first_index))
    return ids.alias("ids"), F.transform(rest, lambda t: F.substring_index(t, ":", -1).cast("double")).alias("weights")


def dense_line(label: Column, features: Column, separator: str = "\t") -> Column:
    return F.concat_ws(separator, label.cast("string"), F.array_join(F.transform(features, lambda v: v.cast("string")), separator))


def sparse_line(label: Column, size: Column, ids: Column, weights: Column, separator: str = "\t") -> Column:
    pairs = F.zip_with(ids, weights, lambda i, w: F.concat(i.cast("string"), F.lit(":"), w.cast("string")))
    return F.concat_ws(separator, label.cast("string"), size.cast("string"), F.array_join(pairs, separator))


def libsvm_line(label: Column, ids: Column, weights: Column, first_index: int = 1, negative: int = 0) -> Column:
    """ids count from 0; labels up to 0 are written as `negative` (0 or -1)."""
    pairs = F.zip_with(ids, weights, lambda i, w: F.concat((i + first_index).cast("string"), F.lit(":"), w.cast("string")))
    return F.concat_ws(" ", F.when(label > 0, label.cast("int")).otherwise(F.lit(negative)).cast("string"), F.array_join(pairs, " "))


def comma_to_tab(line: Column) -> Column:
    return F.translate(line, ",", "\t")


def select_features(names: list[str], include: str | None = None, exclude: str | None = None) -> list[str]:
    """Names that pass two lists of expressions, comma-separated: `s:` substring, `r:` regular expression, `i:` index, `e:` exact name.
    With both, what is included is then thinned by what is excluded."""

    def fits(rule: str, at: int, name: str) -> bool:
        kind, _, value = rule.strip().partition(":")
        if kind not in {"s", "r", "i", "e"} or not value:
            raise ValueError(f"not a feature expression: {rule}")
        return {"s": lambda: value in name, "r": lambda: re.search(value, name) is not None, "i": lambda: int(value) == at, "e": lambda: value == name}[kind]()

    kept = [(k, n) for k, n in enumerate(names) if include is None or any(fits(r, k, n) for r in include.split(","))]
    return [n for k, n in kept if exclude is None or not any(fits(r, k, n) for r in exclude.split(","))]


def read_instances(spark: SparkSession, path: str, kind: str = "auto", separator: str | None = None, header: bool | None = None, label: int = -1, weight: int = -1, names: tuple[int, ...] = (), attrs: tuple[int, ...] = (), group: tuple[int, ...] = (), rank_test: bool = False, name_separator: str = "|", include: str | None = None, exclude: str | None = None, first_index: int = 1, max_rows: int | None = None, feature_names: list[str] | None = None) -> Dataset:
    """Reads a feature file. kind: auto, dense, index_only, sparse or libsvm. Columns are given by position: label, weight, names (joined
    into `name`), attrs (carried as `attr`, not features) and group (also joined; for a rank test without one it is column 0). Dense rows
    must all be as long. max_rows: the first rows in the file's order. feature_names: of the feature columns of a dense file, in order
    (read_names reads them), instead of those of a header."""
    if rank_test and not group:
        group = (0,)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.first()
    if first is None:
        raise ValueError(f"no lines in {path}")
    layout = sniff(first["value"])
    has_header = layout.has_header if header is None else header
    kind = ("dense" if header else layout.kind) if kind == "auto" else kind
    if kind not in {"dense", "index_only", "sparse", "libsvm"}:
        raise ValueError(f"unknown kind {kind}")
    if has_header:  # each file of a folder may start with it; a line of data that equals it stays
        placed = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
        starts = placed.filter(F.trim("value") != "").groupBy("file").agg(F.min(F.struct("at", "value")).alias("s")).filter(F.col("s.value") == first["value"]).select("s.at")
        lines = placed.filter(F.trim("value") != "").join(starts, "at", "left_anti").select("value")
        sample = lines.first()
        layout = Layout(kind, True, 1 if sample and sample["value"].startswith("_") else 0)
    if max_rows is not None:
        lines = lines.withColumn("at", F.monotonically_increasing_id()).orderBy("at").limit(max_rows).drop("at")
    at = layout.label if label < 0 else label
    if kind == "libsvm":
        df = lines.select(parse_libsvm(F.col("value"), first_index).alias("p")).select("p.*")
        width = df.agg(F.max(F.array_max("ids")) + 1).first()[0] or 0
        return Dataset(df, kind, width, width, _classes(df), False)
    if kind == "sparse":
        df = lines.select(parse_sparse(F.col("value"), at).alias("p")).select("p.*")
        width = df.agg(F.max("num_features")).first()[0] or 0
        return Dataset(df, kind, width, width, _classes(df), False)
    if kind == "index_only":
        df = lines.select(parse_index_only(F.col("value"), at).alias("p")).select("p.*")
        r = df.agg(F.max(F.size("ids")), F.max("total_features")).first()
        return Dataset(df, kind, r[0] or 0, r[1] or r[0] or 0, _classes(df), True)
    tokens = split_line(F.col("value"), separator)
    width = len(re.split(r"\s+", first["value"].strip()) if separator is None else first["value"].split(SEPARATORS.get(separator, separator)))
    titles = re.split(r"\s+", first["value"].strip().lstrip("#")) if has_header and separator is None else [f"f{k}" for k in range(width)]
    special = {at, weight, *names, *attrs, *group} | ({0} if layout.label == 1 and label < 0 else set())
    own = [k for k in range(width) if k not in special]
    if feature_names is not None and len(feature_names) != len(own):
        raise ValueError(f"{len(feature_names)} names for the {len(own)} features of {path}")
    named = dict(zip(feature_names or [titles[k] for k in own], own, strict=False))
    feature_names = select_features(list(named), include, exclude)
    spots = [named[n] for n in feature_names]
    joined = lambda cols: F.concat_ws(name_separator, *(F.get(tokens, k) for k in cols))
    columns = [F.get(tokens, at).cast("double").alias("label"), F.array(*(F.get(tokens, k).cast("double") for k in spots)).alias("features"), F.size(tokens).alias("__width")]
    columns += [joined(cols).alias(n) for n, cols in (("name", names), ("attr", attrs), ("group", group)) if cols]
    if weight >= 0:
        columns.append(F.get(tokens, weight).cast("double").alias("weight"))
    df = lines.select(*columns)
    odd = df.filter(F.col("__width") != width).limit(1).count()
    if odd:
        raise ValueError(f"rows of {path} differ in length; {width} columns are expected")
    df = df.drop("__width")
    return Dataset(df, kind, len(spots), len(spots), _classes(df), False, tuple(feature_names))


def read_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a feature name file, one a line; as few as a line of data has columns."""
    numbered = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return [r["value"].strip() for r in numbered.orderBy("at").collect()]


def _classes(df: DataFrame) -> int:
    return int((df.agg(F.max("label")).first()[0] or 0) + 1)


def same_schema(train: Dataset, test: Dataset) -> bool:
    return train.num_features == test.num_features


def as_dataset(df: DataFrame, label: str, features: str) -> Dataset:
    """Of a frame with an array of features; rows must be equally long."""
    r = df.agg(F.min(F.size(features)), F.max(F.size(features))).first()
    if r[0] != r[1]:
        raise ValueError("rows differ in length")
    out = df.select(F.col(label).cast("double").alias("label"), F.col(features).cast("array<double>").alias("features"))
    return Dataset(out, "dense", r[0] or 0, r[0] or 0, _classes(out), False)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records kept as Parquet: label, index, value."""
    return spark.read.schema(RECORD).parquet(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts as append_posts writes them; an empty text isn't null (no line holds its end, so that stands for it on the way)."""
    rows = spark.read.options(**POST_CSV, emptyValue="\n").csv(path, schema=POST)
    return rows.select(*(F.when(F.col(c) == "\n", "").otherwise(F.col(c)).alias(c) for c in rows.columns))


def read_scored_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SCORED_POST)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """pos, word of the text files at path: files by name, lines in their order (numbered by range, not in one task), words within them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    words = lines.select("file", "block", "at", F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("k", "word"))
    return numbered(words, "file", "block", "at", "k", name="pos").select("pos", "word")


def first_of_sorted(df: DataFrame, score: str, key: str, n: int = 100) -> DataFrame:
    """The head of a set sorted by score, ties by key."""
    return df.orderBy(score, key).limit(n)


def _state_of(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of the files of a source, as one digest: what changes if one of them is written anew, added or removed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def cached_parse(spark: SparkSession, source: str, cache: str, parse) -> DataFrame:
    """parse(spark, source), kept in the folder `cache` under the state of the source's files; made again when one of them has changed."""
    kept = f"{cache.rstrip('/')}/{_state_of(spark, source)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        parse(spark, source).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept)
