import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.models import registry, textcnn
from lumenframe.operators import batching, lookups, metrics, sampling, trees
from lumenframe.sources import formats, sinks
from lumenframe.streaming import scoring


def test_batches_partition_the_rows(spark):
    rows = spark.range(103).withColumn("o", F.xxhash64("id"))
    kept = batching.batch_ids(rows, ["o", "id"], 10).collect()
    assert sorted(r["row"] for r in kept) == list(range(103)) and max(r["batch_id"] for r in kept) == 10
    assert batching.batch_ids(rows, ["o", "id"], 10, "drop").count() == 100
    assert batching.batch_ids(rows.limit(100), ["id"], 10, "zip").count() == 90
    assert batching.slice_rows(rows, ["id"], 5, -3).count() == 95


def test_numbers_follow_the_order_over_many_ranges(spark):
    rows = spark.range(20_000).withColumn("o", F.xxhash64("id"))
    got = [r["row"] for r in batching.numbered(rows, "o", "id").orderBy("o", "id").collect()]
    assert got == list(range(20_000))


def test_auc_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, rng.randint(0, 5)) for _ in range(200)]
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "y int, s int")
    assert metrics.auc(df, "y", "s").first()[0] == pytest.approx(want)
    assert metrics.auc(df.withColumn("s", F.exp("s")), "y", "s").first()[0] == pytest.approx(want)
    assert metrics.auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0] == pytest.approx(1 - want)
    assert math.isnan(metrics.auc(df.filter("y = 1"), "y", "s").first()[0])
    assert math.isnan(metrics.auc(df.filter("y = 7"), "y", "s").first()[0])


def test_bag_and_its_complement(spark):
    rows = sampling.bag(spark.range(2000), "id", 0.7, 5)
    inside, outside = rows.filter("in_bag"), rows.filter("not in_bag")
    assert inside.count() + outside.count() == 2000 and inside.join(outside, "id").count() == 0 and 1300 < inside.count() < 1500


def test_groups_stay_in_one_fold(spark):
    found = sampling.folds(spark.range(500).withColumn("g", F.col("id") % 40), "g", 4)
    assert found.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n <> 1").count() == 0


def test_smoothing_and_weighted_outputs_agree():
    tree = trees.Node(0, 0.0, "f", 1, trees.Node(3, 1.0), trees.Node(0, 0.0, "g", 2, trees.Node(2, 4.0), trees.Node(5, -1.0)))
    tree.right.docs = 7
    assert tree.weighted() == pytest.approx((3 * 1 + 2 * 4 - 5 * 1) / 10)
    before = tree.weighted()
    tree.smoothed(0.0)
    assert tree.weighted() == pytest.approx(before) and trees.Node.of(tree.as_dict()).weighted() == pytest.approx(before)
    tree.shifted(1.0)
    assert tree.weighted() == pytest.approx(before + 1)
    assert math.isnan(trees.Node(0, 0.0, "f", 1, trees.Node(0, 1.0), trees.Node(0, 2.0)).weighted())


def test_ranking_gradient_equals_that_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.random()) for k in range(30)] + [(30, "alone", 2.0)]
    want = {i: sum(x - y for _, h, y in rows if h == g) / sum(h == g for _, h, _ in rows) for i, g, x in rows}
    df = spark.createDataFrame(rows, "id int, g string, residual double")
    assert {r.id: r.residual for r in trees.pair_residual(df, "g").collect()} == pytest.approx(want)
    assert {r.g for r in trees.with_order(df, "g", "residual").collect()} == {"a", "b", None}


def test_ranking_follows_order_within_groups_and_saves(spark, tmp_path):
    # Groups differ in level, which the features don't tell; within each the second feature alone orders the rows.
    rows = [(k, k % 4, float(100 * (k % 4) + k // 4), [float(k * 7 % 11), float(k // 4)]) for k in range(80)]
    df = spark.createDataFrame(rows, "row int, group int, label double, features array<double>")
    model = registry.train("gbdt_ranking", df, rounds=8, depth=3, rate=0.7)
    model.save(str(tmp_path / "m"))
    got = {r.row: r.score for r in registry.Model.load(str(tmp_path / "m")).score(df).collect()}
    pairs = [(a, b) for a in range(80) for b in range(a % 4, a - 3, 4)]
    assert sum(got[a] > got[b] for a, b in pairs) > 0.85 * len(pairs) and len(model.score(df).columns) == 5
    with pytest.raises(ValueError):
        trees.boost(df, "label", ["row"], "row", rounds=1, active=[True, False])
    assert trees.boost(df, "label", ["row", "group"], "row", rounds=1, depth=2, bins=8, active=[False, True]).features == ["group"]


def test_boosting_lowers_the_error(spark):
    rows = spark.range(400).select("id", (F.xxhash64("id") % 100).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 100).cast("double").alias("b")).withColumn("y", F.when(F.col("a") > 10, 5.0).otherwise(-2.0) + F.when(F.col("b") > 0, 1.0).otherwise(0.0))
    model = trees.boost(rows, "y", ["a", "b"], "id", rounds=3, depth=2, rate=0.9, bins=64)
    error = model.score(rows).agg(F.avg(F.pow(F.col("y") - F.col("score"), F.lit(2)))).first()[0]
    assert error < 0.05 * rows.agg(F.var_pop("y")).first()[0]


@pytest.mark.parametrize(
    ("line", "kind", "header", "label"),
    [("#id\tlabel\ta", "dense", True, 1), ("1\t0.5\t0.25", "dense", False, 0), ("_7\t0\t10.0", "dense", False, 1), ("1\t1000\t3\t17", "index_only", False, 0), ("1\t1000\t3:0.5", "sparse", False, 0), ("0\t1000", "index_only", False, 0)],
)
def test_sniffing(spark, line, kind, header, label):
    got = formats.sniff(line)
    assert (got.kind, got.has_header, got.label) == (kind, header, label)
    assert tuple(spark.createDataFrame([(line,)], "l string").select(formats.sniff_column(F.col("l")).alias("s")).select("s.*").first()) == (kind, header, label)


def test_reading_what_is_written(spark, tmp_path):
    path = str(tmp_path / "x.txt")
    (tmp_path / "x.txt").write_text("#id\tlabel\thight\tmoney\tface\n_0\t1\t20\t80\t100\n_5\t0\t20\t12\t55\n")
    found = formats.read_instances(spark, path, names=(0,))
    assert found.num_features == 3 and found.names == ("hight", "money", "face") and found.num_classes == 2
    assert sorted((r["name"], r["label"], r["features"]) for r in found.df.collect()) == [("_0", 1.0, [20, 80, 100]), ("_5", 0.0, [20, 12, 55])]
    assert formats.read_instances(spark, path, exclude="s:hig").num_features == 2
    (tmp_path / "y.txt").write_text("1\t10\t3:0.5\t7:1.0\n0\t10\n")
    sparse = formats.read_instances(spark, str(tmp_path / "y.txt"))
    assert sparse.kind == "sparse" and sorted((r["label"], r["ids"]) for r in sparse.df.collect()) == [(0.0, []), (1.0, [3, 7])]
    (tmp_path / "z.txt").write_text("1\t0.5\t0.25\n0\t0.5\n")
    with pytest.raises(ValueError, match="length"):
        formats.read_instances(spark, str(tmp_path / "z.txt"))


def test_feature_expressions():
    names = ["age", "height", "weight", "face"]
    assert formats.select_features(names, "s:eight", "e:weight") == ["height"]
    assert formats.select_features(names, None, "r:^f,i:0") == ["height", "weight"]
    with pytest.raises(ValueError, match="feature expression"):
        formats.select_features(names, "x:y")


def test_insert_ignore_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.insert_ignore(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    assert spark.read.parquet(path).count() == 2


def test_exists_flag_doubles_no_row(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    known = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(((r[0] or 0), r[1]) for r in lookups.exists_flag(rows, known, "k").collect()) == [(0, False), (1, True), (2, False)]


def test_stream_equals_batch_and_restarts(spark, tmp_path, sf):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value")
    events.filter("event_id < 600").repartition(3).write.parquet(f"{folder}/a")
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    run = lambda: scoring.score_stream(source(), None, lambda df: df.withColumn("score", F.col("value") / 100), 0.3, "event_id", out, state).awaitTermination()
    run()
    events.filter("event_id >= 400").write.parquet(f"{folder}/b")
    run()
    assert sorted(r[0] for r in spark.read.parquet(out).select("event_id").collect()) == sorted(r[0] for r in events.filter("value / 100 > 0.3").select("event_id").collect())


def test_models_learn_and_survive_a_round_trip(spark, tmp_path):
    rows = spark.range(600).select(F.col("id").alias("row"), (F.xxhash64("id") % 100 / 50.0).alias("a"), (F.xxhash64("id", F.lit(2)) % 100 / 50.0).alias("b")).select("row", (F.col("a") + F.col("b") > 0).cast("int").alias("label"), F.array("a", "b").alias("features"))
    for kind, least in (("logistic", 0.98), ("libsvm", 0.97), ("gbdt", 0.9), ("mlp", 0.95)):
        model = registry.train(kind, rows)
        assert metrics.auc(model.score(rows), "label", "score").first()[0] > least, kind
    model.save(str(tmp_path / "m"))
    a, b = (sorted((r["row"], round(r["score"], 9)) for r in m.score(rows).collect()) for m in (model, registry.Model.load(str(tmp_path / "m"))))
    assert a == b
    with pytest.raises(ValueError, match="unknown trainer"):
        registry.train("nothing", rows)


def test_stopping_rules():
    assert registry.first_plateau([0.5, 0.7, 0.75, 0.7501, 0.9]) == 3
    calls = []
    best = registry.with_patience(lambda k: calls.append(k) or (0.9 if k == 8 else 0.5), start=10)
    assert best == (8, 0.9) and len(calls) == 16


def test_cosine_goes_by_blocks(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(90)], "vec_id long, v array<double>")
    told = lambda most: sorted((r.query_id, r.rank, r.neighbor_id) for r in lookups.top_k_cosine(rows, "vec_id", "v", rows.filter("vec_id % 2 = 0"), 4, most).collect())
    assert told(7) == told(10_000) and len(told(7)) == 45 * 4


def test_posts_come_back_whole(spark, tmp_path):
    found = ['say "x"', '"', '""', "\\", 'a\\"b', "tab\there", "  outer ", "#", 'é' * 5000, 'end\\', '"a"\t"b"', "two\nlines", "", None]
    rows = [(str(k), "t", c) for k, c in enumerate(found)]
    sinks.append_posts(spark.createDataFrame(rows, "pid string, title string, content string"), str(tmp_path / "posts"))
    got = {r.pid: r.content for r in formats.read_posts(spark, str(tmp_path / "posts")).collect()}
    assert got == {k: c and c.replace("\n", " ") for k, _, c in rows}


def test_auc_of_groups_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "one"]), rng.randint(0, 1), rng.randint(0, 9) / 4) for _ in range(300)]
    rows = [(g, 1 if g == "one" else y, s) for g, y, s in rows]
    got = {r.g: r.auc for r in metrics.auc(spark.createDataFrame(rows, "g string, y int, s double").repartition(5), "y", "s", ("g",)).collect()}
    for g in ("a", "b", None):
        pos, neg = ([s for h, y, s in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    assert math.isnan(got["one"]) and len(got) == 4


def test_first_match_takes_the_least(spark):
    table = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 1, "x"), (None, 0, "n")], "k int, o int, v string")
    found = lookups.first_match(spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int"), table, "k", ["o"], ["v"])
    assert sorted(((r.k or 0), r.v) for r in found.collect() if r.v) == [(1, "b"), (2, "x")] and found.count() == 4


def test_bags_with_replacement(spark):
    rows = spark.range(4000)
    bags = sampling.bags(rows, "id", 1.0, 3, seed=2, replace=True)
    times = bags.groupBy("member", "id").count()
    assert {abs(r["count"] - 4000) < 250 for r in bags.groupBy("member").count().collect()} == {True}
    assert times.filter("count > 1").count() > 2000 and abs(times.count() - 3 * 4000 * (1 - math.exp(-1))) < 250
    assert sampling.poisson_steps(0.0) == [1.0]


def test_trainers_can_be_added_and_balanced(spark):
    rows = spark.range(400).select(F.col("id").alias("row"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.array((F.col("id") % 10).cast("double")).alias("features"))
    registry.register("mine", lambda df, k=1: registry.logistic(df, rounds=k))
    assert registry.train("mine", rows, k=3).kind == "logistic"
    model = registry.train("gbdt", rows, rounds=3, depth=2, unbalanced=True, calibration="sigmoid", most_calibration=200)
    assert model.calibrator is not None and metrics.auc(model.score(rows), "label", "score").first()[0] > 0.99
    del registry.TRAINERS["mine"]


def test_text_cnn_by_table_and_by_join(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    model = textcnn.TextCnn([(rng.normal(size=(w, 3, 4)), rng.normal(size=4)) for w in (2, 5)], rng.normal(size=8), 0.5)
    words = {k: rng.normal(size=3) for k in range(6)}
    texts = [None, [], [1], [9, 9], [0, None, 2], [int(x) for x in rng.integers(0, 8, 6000)], *([int(x) for x in rng.integers(0, 8, n)] for n in range(2, 12))]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in words.items()], "id long, vector array<double>")
    df = spark.createDataFrame(list(enumerate(texts)), "row long, ids array<long>")

    def plain(ids):
        x = [words.get(i, np.zeros(3)) for i in ids] + [np.zeros(3)] * (5 - len(ids))
        best = [max(0.0, *(b[f] + sum(x[i + o] @ w[o, :, f] for o in range(len(w))) for i in range(len(x) - len(w) + 1))) for w, b in model.filters for f in range(4)]
        return float(np.dot(best, model.out) + model.bias)

    want = [None if t is None else pytest.approx(plain(t)) for t in texts]
    got = lambda m: [r["score"] for r in m.score(df, "row", "ids", table).orderBy("row").collect()]
    assert got(model) == want
    model.save(spark, str(tmp_path / "cnn"))
    monkeypatch.setattr(textcnn, "BROADCAST_BYTES", 0)
    assert got(textcnn.TextCnn.load(spark, str(tmp_path / "cnn"))) == want


@pytest.mark.parametrize("kind", ["descent", "adagrad", "adam"])
def test_optimisers_against_plain_steps(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] - x[:, 1] > 0.2).astype(float)
    model = registry.gradient_logistic(spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y, strict=True)], "label double, features array<double>").repartition(3), kind, 0.2, 3, standardise=False)
    w, m, v = np.zeros(4), np.zeros(4), np.zeros(4)
    if kind == "adagrad":
        v += 0.1
    ones = np.c_[x, np.ones(60)]
    for t in (1, 2, 3):
        g = ones.T @ (1 / (1 + np.exp(-ones @ w)) - y) / 60
        if kind == "descent":
            w = w - 0.2 * g
        elif kind == "adagrad":
            v = v + g * g
            w = w - 0.2 * g / np.sqrt(v)
        else:
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert [*model.extra["weights"], model.extra["bias"]] == pytest.approx(list(w))


def test_isotonic_steps_against_a_plain_search(spark):
    bounds, values = [0.1, 0.3, 0.3, 0.7], [0.0, 0.2, 0.4, 0.9]
    xs = [-1.0, 0.1, 0.2, 0.3, 0.5, 0.7, 2.0, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame(list(enumerate(xs)), "row int, score double")
    got = [r["score"] for r in registry.Calibrator("isotonic", bounds=bounds, values=values).apply(df, "score").orderBy("row").collect()]
    assert got == [None if x is None else values[max(0, sum(b <= x or x != x for b in bounds) - 1)] for x in xs]
    one = registry.Calibrator("isotonic", bounds=[0.5], values=[0.25]).apply(df, "score")
    assert {r["score"] for r in one.filter("row < 10").collect()} == {0.25}


def test_feature_name_file(spark, tmp_path):
    (tmp_path / "rows.txt").write_text("1\t2.5\t3\n0\t1.5\t4\n")
    (tmp_path / "names.txt").write_text("height\n\nweight\n")
    names = formats.read_names(spark, str(tmp_path / "names.txt"))
    found = formats.read_instances(spark, str(tmp_path / "rows.txt"), feature_names=names, exclude="e:height")
    assert names == ["height", "weight"] and found.names == ("weight",)
    assert sorted(tuple(r["features"]) for r in found.df.collect()) == [(3.0,), (4.0,)]
    with pytest.raises(ValueError, match="names"):
        formats.read_instances(spark, str(tmp_path / "rows.txt"), feature_names=["one"])
