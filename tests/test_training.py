"""Training by steps: slopes against finite differences, one part against plain descent, interrupted runs against whole ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.models import cbow, descent, nce, registry, textcnn
from lumenframe.operators import batching, sampling


def slopes_hold(loss, weights, rows, within=1e-5):
    """Each slope against the change of the loss (random numbers repeat)."""
    of = lambda w: loss(w, rows, np.random.default_rng(3))
    _, slope = of(weights)
    assert list(slope) == list(weights) or set(slope) == set(weights)
    rng = random.Random(1)
    for name, w in weights.items():
        for _ in range(12):
            at = tuple(rng.randrange(n) for n in w.shape)
            values = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][at] += step
                values.append(of(moved)[0])
            assert (values[0] - values[1]) / 2e-6 == pytest.approx(slope[name][at], abs=within), (name, at)


def table(n=9, width=4, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    return pa.table({"features": pa.array(list(rng.normal(size=(n, width))), pa.list_(pa.float64())), "label": pa.array(rng.integers(0, classes, n).astype(float))})


def test_slopes():
    rng = np.random.default_rng(5)
    slopes_hold(descent.logistic_loss, {"w": rng.normal(size=4), "b": rng.normal(size=1)}, table(classes=2))
    slopes_hold(descent.softmax_loss, {"w": rng.normal(size=(4, 3)), "b": rng.normal(size=3)}, table())
    slopes_hold(descent.hidden_loss, {"w0": rng.normal(size=(4, 5)), "b0": rng.normal(size=5), "w": rng.normal(size=(5, 3)), "b": rng.normal(size=3)}, table())


@pytest.mark.parametrize("keep", [1.0, 0.6])
def test_slopes_of_the_text_network(keep):
    """Through the greatest place of each filter; short texts, unknown and null ids, repeated words."""
    rng = np.random.default_rng(2)
    weights = textcnn.first_weights(12, 5, (2, 3), 4, seed=1)
    weights = {k: w + rng.normal(size=w.shape) * 0.5 for k, w in weights.items()}
    rows = pa.table({"ids": [[1, 2, 3, 4, 5, 1], [7], [], [0, 99, None, 3, 3, 3, 3, 11, -1], rng.integers(0, 12, 40).tolist()], "label": [1.0, 0.0, 1.0, 0.0, 1.0]})
    slopes_hold(textcnn.loss_of((2, 3), keep), weights, rows)
    model = textcnn.TextCnn([(weights["f2"], weights["b2"]), (weights["f3"], weights["b3"])], weights["out"], float(weights["bias"][0]))
    z = [model.one(np.array([weights["words"][i] if i is not None and 0 <= i < 12 else np.zeros(5) for i in ids]).reshape(-1, 5)) for ids in rows["ids"].to_pylist()]
    if keep == 1:
        assert textcnn.loss_of((2, 3))(weights, rows, rng)[0] == pytest.approx(sum(np.logaddexp(0, x) - y * x for x, y in zip(z, rows["label"].to_pylist(), strict=True)))


def points(spark, n=200, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 > 0).astype(int)
    return [(k, [float(v) for v in r], int(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "row long, features array<double>, label int"


@pytest.mark.parametrize("optimiser", ["descent", "adagrad", "adam"])
def test_one_part_is_plain_descent(spark, optimiser):
    rows, schema = points(spark)
    df = spark.createDataFrame([*rows, (900, None, 1), (901, [1.0, 2.0, 3.0], None)], schema).repartition(5)
    got = descent.descend(df.withColumn("label", F.col("label").cast("double")), descent.logistic_loss, {"w": np.zeros(3), "b": np.zeros(1)}, optimiser=optimiser, rate=0.2, batch=32, epochs=3, parts=1, seed=9)
    draws = {e: {r["row"]: r["d"] for r in df.select("row", batching.draw("row", 9 + e).alias("d")).collect()} for e in range(3)}
    w, one, losses = np.zeros(4), descent.Optimiser(optimiser, 0.2), []
    for e in range(3):
        order, total = sorted(rows, key=lambda r: draws[e][r[0]]), 0.0
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            x, y = np.array([r[1] for r in part]), np.array([r[2] for r in part])
            z = x @ w[:3] + w[3]
            total += float((np.logaddexp(0, z) - y * z).sum())
            over = 1 / (1 + np.exp(-z)) - y
            w = one.step(w, np.r_[over @ x, over.sum()] / len(part))
        losses.append(total / len(order))
    assert np.allclose(np.r_[got.weights["w"], got.weights["b"]], w, atol=1e-12) and np.allclose(got.losses, losses)


def test_parts_are_averaged_by_rows_and_do_not_depend_on_partitions(spark):
    rows, schema = points(spark)
    of = lambda df: descent.descend(df, descent.logistic_loss, {"w": np.zeros(3), "b": np.zeros(1)}, rate=0.5, batch=16, epochs=4, parts=3, seed=1)
    a, b = of(spark.createDataFrame(rows, schema).repartition(2)), of(spark.createDataFrame(rows[::-1], schema).repartition(7))
    assert np.allclose(a.weights["w"], b.weights["w"], atol=1e-12) and a.losses[-1] < a.losses[0] < 0.7
    none = of(spark.createDataFrame([], schema))
    assert none.losses == [] and not none.weights["w"].any()
    with pytest.raises(Exception, match="one length"):
        of(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 0)], schema).repartition(1))
    with pytest.raises(ValueError, match="too many"):
        descent.descend(spark.createDataFrame(rows, schema), descent.logistic_loss, {"w": np.zeros(1 << 25)})


class Killed(Exception):
    pass


@pytest.mark.parametrize("optimiser", ["descent", "adagrad", "adam"])
def test_an_interrupted_run_ends_with_the_same_weights(spark, tmp_path, optimiser):
    rows, schema = points(spark)
    df, start = spark.createDataFrame(rows, schema).repartition(3), {"w": np.zeros(3), "b": np.zeros(1)}
    of = lambda **more: descent.descend(df, descent.logistic_loss, start, optimiser=optimiser, rate=0.3, batch=20, epochs=5, parts=2, **more)

    def killed(epoch, loss, weights):
        if epoch == 3:
            raise Killed

    whole, kept = of(), descent.Checkpoints(spark, f"file://{tmp_path}/steps")
    with pytest.raises(Killed):
        of(checkpoint=kept, after=killed)
    (tmp_path / "steps" / ".writing-x").mkdir()  # what a killed run leaves
    (tmp_path / "steps" / "step-0000000009").mkdir()  # not marked complete
    assert kept.steps() == [2, 3]
    again = of(checkpoint=kept)
    assert np.array_equal(again.weights["w"], whole.weights["w"]) and np.array_equal(again.weights["b"], whole.weights["b"]) and again.losses == whole.losses
    assert kept.steps() == [4, 5]
    once = of(checkpoint=kept, after=killed)  # nothing is left to do
    assert np.array_equal(once.weights["w"], whole.weights["w"])


def test_a_gradient_trainer_continues(spark, tmp_path):
    rows, schema = points(spark)
    df = spark.createDataFrame(rows, schema).repartition(3)
    whole = registry.gradient_logistic(df, "adam", rounds=6)
    kept = descent.Checkpoints(spark, f"file://{tmp_path}/steps", keep=1)
    registry.gradient_logistic(df, "adam", rounds=4, checkpoint=kept)
    again = registry.gradient_logistic(df, "adam", rounds=6, checkpoint=kept)
    assert again.extra == whole.extra and kept.steps() == [6]


def test_layers_score_as_numpy_does(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 0] > 1)
    rows = [(k, [float(v) for v in r], int(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row long, features array<double>, label int").repartition(3)
    model = registry.train("softmax_sgd", df, hidden=12, optimiser="adam", rate=0.05, batch=16, epochs=12, parts=2)
    got = {r.row: r.score for r in model.score(df).collect()}
    (a, b), (c, d) = [(np.array(m), np.array(v)) for m, v in model.extra["layers"]]
    z = np.tanh(((x - model.extra["mean"]) / model.extra["spread"]) @ a.T + b) @ c.T + d
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert all(np.allclose(got[k], p[k]) for k in range(240)) and (p.argmax(axis=1) == y).mean() > 0.8
    model.save(str(tmp_path / "m"))
    again = registry.Model.load(str(tmp_path / "m"))
    assert {r.row: r.score for r in again.score(df).collect()} == got


def test_alias_draws_have_their_chances():
    weights = np.array([0, 5, 1, 0, 0.5, 100, 3, 3])
    found = sampling.AliasTable.of(weights, 0.75)
    assert np.allclose(found.chances, weights**0.75 / (weights**0.75).sum())
    exact = np.zeros(8)  # over an even grid of both numbers
    for k in range(8):
        exact[k] += found.kept[k] / 8
        exact[found.alias[k]] += (1 - found.kept[k]) / 8
    assert np.allclose(exact, found.chances)
    rng = np.random.default_rng(1)
    drawn = np.bincount(found.draw(rng.random(200_000), rng.random(200_000)), minlength=8) / 200_000
    assert np.abs(drawn - found.chances).max() < 0.005 and not drawn[[0, 3, 4]][:2].any()
    assert found.draw(np.array([0.999999999999]), np.array([0.0])).tolist()[0] < 8
    with pytest.raises(ValueError, match="above 0"):
        sampling.AliasTable.of(np.zeros(3))


def test_slopes_of_the_noise_loss():
    noise = sampling.AliasTable.of(np.array([4.0, 3, 2, 2, 1, 1]))
    rng = np.random.default_rng(3)
    weights = {"center": rng.normal(size=(6, 3)), "context": rng.normal(size=(6, 3)), "bias": rng.normal(size=6)}
    slopes_hold(nce.loss_of(noise, 2, 5), weights, pa.table({"ids": [[0, 1, 2, 1, 5], [3], [], [4, None, 4, 9, 0, 0]]}))


def test_pairs_of_neighbours():
    center, context = nce.pairs_of([0, 1, None, 2, 3, 9, 3], 2, 5)
    assert sorted(zip(center.tolist(), context.tolist(), strict=True)) == [(0, 1), (1, 0), (2, 3), (3, 2)]
    assert len(nce.pairs_of([1], 3, 5)[0]) == len(nce.pairs_of([], 3, 5)[0]) == 0


def test_noise_losses_by_pair(spark):
    rng = np.random.default_rng(6)
    u, v, b, p = rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), rng.normal(size=5), np.array([0.4, 0.3, 0.1, 0.1, 0.1])
    words = spark.createDataFrame([(k, u[k].tolist(), v[k].tolist(), float(b[k]), float(p[k])) for k in range(5)], "id int, center array<double>, context array<double>, bias double, chance double")
    pairs, drawn = [(0, 1), (1, 0), (4, 4), (2, 3)], [1, 1, 4]
    got = {(r.center, r.context): r.loss for r in nce.losses(spark.createDataFrame(pairs, "center int, context int"), spark.createDataFrame([(d,) for d in drawn], "id int"), words).collect()}
    lift = b - np.log(3 * p)
    for c, o in pairs:
        assert got[c, o] == pytest.approx(np.logaddexp(0, -(u[c] @ v[o] + lift[o])) + sum(np.logaddexp(0, u[c] @ v[d] + lift[d]) for d in drawn))


def test_a_step_of_words_and_layer(spark):
    rng = np.random.default_rng(7)
    texts = [(k, rng.integers(0, 9, rng.integers(0, 12)).tolist(), int(k % 2)) for k in range(20)] + [(20, [], 1), (21, [77, None], 0), (22, [3, 3, 3, 77], 1)]
    dim, w, b, sums = 3, rng.normal(size=3), 0.2, np.array([0.1, 0.2, 0.3, 0.4])
    table = cbow.first_table(spark.range(10).select("id"), dim, 5, 0.1)
    start = {r.id: np.array([r.v0, r.v1, r.v2]) for r in table.collect()}
    rows = spark.createDataFrame(texts, "row long, ids array<long>, label int").repartition(4)
    touched, w2, b2, sums2, loss = cbow.step(cbow.Cbow(dim, table, w, b), rows, 0.5, sums)
    slope_w, slope_b, slope_v, total = np.zeros(3), 0.0, {}, 0.0
    for _, ids, y in texts:
        known = [i for i in ids if i is not None and i < 10]
        m = np.mean([start[i] for i in known], axis=0) if known else np.zeros(3)
        z = m @ w + b
        over = 1 / (1 + np.exp(-z)) - y
        total += np.logaddexp(0, z) - y * z
        slope_w, slope_b = slope_w + over * m, slope_b + over
        for i in known:
            slope_v[i] = slope_v.get(i, 0) + over * w / len(known)
    n = len(texts)
    slope = np.r_[slope_w, slope_b] / n
    assert loss == pytest.approx(total / n) and np.allclose(sums2, sums + slope**2)
    assert np.allclose(np.r_[w2, b2], np.r_[w, b] - 0.5 * slope / np.sqrt(sums + slope**2))
    got = {r.id: r for r in touched.collect()}
    assert set(got) == set(slope_v) and 9 not in got  # only words of the rows are written
    for i, s in slope_v.items():
        s = s / n
        assert np.allclose([got[i].v0, got[i].v1, got[i].v2], start[i] - 0.5 * s / np.sqrt(0.1 + s**2)) and np.allclose([got[i].g0, got[i].g2], [0.1 + s[0] ** 2, 0.1 + s[2] ** 2])
    model = cbow.Cbow(dim, table, w, b)
    scores = {r.row: r.score for r in model.score(spark.createDataFrame([*texts, (23, None, 0)], "row long, ids array<long>, label int")).collect()}
    assert scores[23] is None and scores[20] == pytest.approx(1 / (1 + np.exp(-b))) and len(scores) == 24


def test_versions_of_the_table(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "id long, v0 double")
    b, c = spark.createDataFrame([(2, 5.0)], "id long, v0 double"), spark.createDataFrame([(2, 6.0), (3, 7.0)], "id long, v0 double")
    assert sorted(tuple(r) for r in cbow._latest([a, b, c]).collect()) == [(1, 0.0), (2, 6.0), (3, 7.0)]
    empty = cbow.fit(spark.createDataFrame([], "row long, ids array<long>, label int"), spark.range(3), dim=2, epochs=1, batches=1)
    assert empty.table.count() == 3 and empty.bias == 0
