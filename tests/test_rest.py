"""What no query covers: rank files, datasets of frames, drawn skip-grams, database tables, word averages, and an entry without extras."""

import builtins
import random
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenframe.functions import text, vectors
from lumenframe.models import registry
from lumenframe.operators import metrics
from lumenframe.plans import catalogue
from lumenframe.sources import formats, sinks


def test_rank_files(spark, tmp_path):
    (tmp_path / "r").write_text("q1 1 0.5 2\nq1 0 0.1 3\nq2 1 0.7 4\n")
    found = formats.read_instances(spark, str(tmp_path / "r"), kind="dense", label=1, rank_test=True)
    assert sorted((r.group, r.label, *r.features) for r in found.df.collect()) == [("q1", 0.0, 0.1, 3.0), ("q1", 1.0, 0.5, 2.0), ("q2", 1.0, 0.7, 4.0)]
    own = formats.read_instances(spark, str(tmp_path / "r"), kind="dense", label=1, group=(0, 3), rank_test=True)
    assert sorted((r.group, *r.features) for r in own.df.collect()) == [("q1|2", 0.5), ("q1|3", 0.1), ("q2|4", 0.7)]


def test_datasets_of_frames(spark):
    df = spark.createDataFrame([(1, [1, 2]), (0, [3, 4])], "y int, x array<int>")
    found = formats.as_dataset(df, "y", "x")
    assert (found.num_features, found.num_classes, found.index_only, found.df.columns) == (2, 2, False, ["label", "features"])
    with pytest.raises(ValueError, match="length"):
        formats.as_dataset(df.union(spark.createDataFrame([(0, [1])], df.schema)), "y", "x")


def test_sparse_rows(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 1.0]), (1, [1.0, 0.0, 2.0, 0.0]), (2, [1.0, 1.0])], "k int, x array<double>")
    assert [r.s for r in df.orderBy("k").select(vectors.is_sparse(F.col("x")).alias("s")).collect()] == [True, False, False]
    assert [r.s for r in df.orderBy("k").select(vectors.is_sparse(F.col("x"), 0.6).alias("s")).collect()] == [True, True, False]


def test_drawn_contexts(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, words array<string>").repartition(3)
    every = {}
    for r in text.skipgrams(df, "k", "words", 2).collect():
        every.setdefault((r.k, r.pos), []).append(r.context)
    drawn = {}
    for r in text.skipgram_samples(df, "k", "words", 2, 2, 5).collect():
        drawn.setdefault((r.k, r.pos), []).append(r.context)
    assert drawn.keys() == every.keys()
    for at, found in drawn.items():
        rest = list(every[at])
        for context in found:
            rest.remove(context)  # each was there, as often as drawn
        assert len(found) == min(2, len(every[at]))
    again = sorted(map(tuple, text.skipgram_samples(df.repartition(1), "k", "words", 2, 2, 5).collect()))
    assert again == sorted(map(tuple, text.skipgram_samples(df, "k", "words", 2, 2, 5).collect()))
    with pytest.raises(ValueError, match="2"):
        text.skipgram_samples(df, "k", "words", 1, 3)


@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
def test_running_ratios(spark, by):
    rng = random.Random(len(by))
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1, None]), rng.choice([True, False, None])) for k in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, g string, h int, hit boolean").repartition(5)
    got = {r.k: (r.hits, r.seen, r.ratio) for r in metrics.running_ratio(df, "k", F.col("hit"), by).collect()}
    held = {}
    for k, g, h, hit in sorted(rows):
        own = held.setdefault((g, h)[: len(by)], [0, 0])
        own[0] += hit is True
        own[1] += 1
        assert got[k] == (own[0], own[1], own[0] / own[1])
    assert metrics.running_ratio(df.limit(0), "k", F.col("hit"), by).count() == 0


@pytest.mark.parametrize("window", [1, 2, 5])
def test_counted_pairs_are_those_of_skipgrams(spark, window):
    rng = random.Random(window)
    df = spark.createDataFrame([(k, [rng.choice("abcd") for _ in range(rng.randint(0, 7))]) for k in range(40)] + [(99, None)], "k int, words array<string>").repartition(3)
    want = text.skipgrams(df, "k", "words", window).groupBy("center", "context").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, text.skipgram_counts(df, "words", window).collect())) == sorted(map(tuple, want.collect()))


def test_rows_of_a_database_table(spark):
    url, how = "jdbc:derby:memory:posts;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, 0.5), (2, 0.25)], "id int, score double").write.jdbc(url, "posts", properties=how)
    new = spark.createDataFrame([(2, 9.0), (3, 0.75), (3, 0.75)], "id int, score double")
    for _ in range(2):
        sinks.insert_ignore_jdbc(new, url, "posts", ["id"], how)
        assert sorted(tuple(r) for r in spark.read.jdbc(url, "posts", properties=how).collect()) == [(1, 0.5), (2, 0.25), (3, 0.75)]


def test_word_averages_and_settings(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice(["good", "fine", "nice"] if k % 2 else ["bad", "poor", "sad"]) for _ in range(8)], k % 2) for k in range(80)]
    df = spark.createDataFrame(rows, "row int, words array<string>, label int")
    embedder, model = registry.cbow(df, "words", size=4)
    scored = model.score(embedder.transform(df).withColumn("features", F.col("embedding")).withColumn("features", registry.vector_to_array("features")).drop("embedding"))
    assert metrics.auc(scored, "label", "score").first()[0] > 0.95
    found = catalogue.QUERIES["validation_grid"](spark, "/root/testdata/sf0.01").collect()
    assert [r.reg for r in found] == [0.0, 0.1] and all(r.first > 0.9 and r.second > 0.9 for r in found)


def test_word_vectors(spark, sf):
    found = catalogue.QUERIES["word2vec"](spark, sf).collect()
    assert found and all(r.length > 0 and r.word != r.neighbor and -1 <= r.similarity <= 1.0000001 for r in found)


def test_queries_without_a_package_that_llm_needs(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lumenframe.llm") or m in ("ahocorasick", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "ahocorasick":
            raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    if (__spark_entry__.Path(__spark_entry__.ROOT) / "lumenframe" / "llm").exists():
        with pytest.warns(UserWarning, match="ahocorasick"):
            found = __spark_entry__.queries()
    else:
        found = __spark_entry__.queries()
    assert set(found) == set(catalogue.QUERIES) and set(__spark_entry__.catalogue.ORACLES) <= set(found)
    for name in [m for m in sys.modules if m.startswith("lumenframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
