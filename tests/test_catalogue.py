"""Every query against its SQL on the smallest tables; trained models against a floor."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenframe.functions import text
from lumenframe.operators import batching, metrics
from lumenframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    got = __spark_entry__.queries()[name](spark, sf)
    names = sorted(got.columns)
    found = duck.execute(catalogue.ORACLES[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == names
    want = sorted((tuple(row[at.index(c)] for c in names) for row in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize(("name", "least"), [("train_logistic", 0.95), ("train_svm", 0.95), ("train_gbt", 0.95), ("train_gradient", 0.95), ("train_mlp", 0.8), ("train_mlp2", 0.8), ("train_no_bias", 0.8), ("train_minibatch", 0.95), ("train_text_cnn", 0.9), ("train_cbow", 0.9), ("train_newton", 0.95), ("train_online", 0.95), ("train_boosted", 0.95), ("train_ensemble", 0.95), ("model_roundtrip", 0.95)])
def test_trained_models_beat_a_floor(spark, name, least):
    held = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").filter(batching.draw("row", 1) >= 0.7)
    assert metrics.auc(held, "label", "score").first()[0] > least


@pytest.mark.parametrize("name", ["train_ranking", "train_lambdarank"])
def test_ranking_orders_rows_of_a_group(spark, name):
    held = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").filter(batching.draw("row", 1) >= 0.7)
    found = [r["auc"] for r in metrics.auc(held, "label", "score", by=("group",)).collect()]
    found = [x for x in found if x == x]
    assert found and sum(found) / len(found) > 0.9


def test_languages_of_held_out_documents(spark):
    rows = catalogue.QUERIES["train_softmax_sgd"](spark, "/root/testdata/sf0.01").filter(batching.draw("row", 1) >= 0.7)
    assert rows.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] > 0.8


def test_neighbours_are_of_one_language(spark):
    """Words of different languages never meet, so neighbours by vectors should share one; by chance one in two or three would."""
    folder = "/root/testdata/sf0.01"
    near = catalogue.QUERIES["train_nce"](spark, folder).persist()
    words = spark.read.parquet(f"{folder}/documents.parquet").select("lang", F.explode(text.tokens(F.col("text"))).alias("word"))
    home = words.groupBy("word", "lang").agg(F.count("*").alias("n")).groupBy("word").agg(F.max_by("lang", "n").alias("lang"), (F.max("n") / F.sum("n")).alias("share")).filter("share > 0.9")
    met = near.join(home, "word").join(home.select(F.col("word").alias("neighbor"), F.col("lang").alias("other")), "neighbor").persist()
    n, same = met.agg(F.count("*"), F.avg((F.col("lang") == F.col("other")).cast("double"))).first()
    chance = sum((r["n"] / n) ** 2 for r in met.groupBy("lang").agg(F.count("*").alias("n")).collect())
    assert n > 200 and same > max(0.8, chance + 0.2), (n, same, chance)


def test_softmax_beats_chance(spark):
    rows = catalogue.QUERIES["train_softmax"](spark, "/root/testdata/sf0.01")
    assert rows.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] > 0.3  # ten classes


def test_seen_users_pass_again_when_a_set_was_emptied(spark, sf):
    passed, shards = [], {}
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.pmod(F.xxhash64(F.concat(F.lit("k"), F.col("user_id").cast("string"))), F.lit(4)).alias("shard"))
    for r in rows.orderBy("event_id").collect():
        own = shards.setdefault(r.shard, set())
        if r.user_id not in own:
            passed.append((r.event_id, r.user_id))
            own.add(r.user_id)
            if len(own) > 20:
                own.clear()
    got = catalogue.QUERIES["seen_capacity"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == passed


def test_bags_and_folds_repeat(spark, sf):
    a, b = (catalogue.QUERIES["bag_oob"](spark, sf).filter("in_bag").agg(F.sum("event_id")).first()[0] for _ in range(2))
    assert a == b and catalogue.QUERIES["negative_sampling"](spark, sf).count() == 64


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
