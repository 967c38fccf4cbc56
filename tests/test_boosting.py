"""Second-order boosting, hooks and LambdaRank against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.models import registry
from lumenframe.operators import trees


def test_bins_are_found_by_halves(spark):
    values = [None, float("nan"), -1e9, 0.0, 0.5, 1.0, 1.5, 2.0, 7.0, 1e9]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    for bounds in ([], [1.0], [0.0, 1.0, 2.0], [0.5 * k for k in range(37)]):
        got = [r.b for r in df.select("k", trees.bin_of(F.col("x"), bounds).alias("b")).orderBy("k").collect()]
        want = [0 if v is None else max(0, len(bounds) - 1) if v != v else min(sum(b < v for b in bounds), max(0, len(bounds) - 1)) for v in values]
        assert got == want, bounds


def plain_lambdas(rows, most, steep):
    out = {}
    groups = {}
    for g, k, y, s in rows:
        groups.setdefault(g, []).append((k, y, s))
    for g, held in groups.items():
        order = sorted(held, key=lambda r: (-r[2], r[0]))
        d = {k: 1 / math.log2(n + 2) if n < most else 0.0 for n, (k, _, _) in enumerate(order)}
        ideal = sum((2**y - 1) / math.log2(n + 2) for n, y in enumerate(sorted((y for _, y, _ in held if y > 0), reverse=True)[:most]))
        for k, y, s in held:
            pull = bend = 0.0
            for k2, y2, s2 in held:
                if y != y2 and ideal:
                    change = abs((2**y - 2**y2) * (d[k] - d[k2])) / ideal
                    p = 1 / (1 + math.exp(steep * (s - s2) * (1 if y > y2 else -1)))
                    pull += steep * p * change * (1 if y > y2 else -1)
                    bend += steep * steep * p * (1 - p) * change
            out[g, k] = (pull, bend)
    return out


@pytest.mark.parametrize(("most", "steep"), [(3, 1.0), (10, 2.0), (100, 1.0)])
def test_lambdas_are_those_of_all_pairs(spark, most, steep):
    rng = random.Random(most)
    rows = [(rng.choice(["a", "b", None, "one"]) if k else "alone", k, rng.randint(0, 3), round(rng.uniform(-2, 2), 1)) for k in range(160)] + [("none", 900, 0, 1.0), ("none", 901, 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, row long, y int, s double").repartition(4)
    got = {(r.g, r.row): (r.residual, r.curvature) for r in trees.lambda_slopes(df, "g", "row", "y", "s", most, steep).collect()}
    want = plain_lambdas(rows, most, steep)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert trees.lambda_slopes(df.limit(0), "g", "row", "y", "s").count() == 0


def binned(spark, n=300):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        a, b = rng.random(), rng.random()
        rows.append((k, [a, b, rng.random()], int(a > 0.6 or (a < 0.3 and b > 0.5))))
    return spark.createDataFrame(rows, "row long, features array<double>, label int"), rows


def test_first_newton_tree(spark):
    df, rows = binned(spark)
    model = registry.train("gbdt_newton", df, rounds=1, depth=1, rate=1.0, ridge=0.5)
    boosted = trees.Boosted.of(model.extra["boosted"])
    p = sum(r[2] for r in rows) / len(rows)
    assert boosted.start == pytest.approx(math.log(p / (1 - p)))
    best = None
    for f in range(3):
        for cut in sorted({r[1][f] for r in rows})[:-1]:
            sums = [[0, 0.0, 0.0], [0, 0.0, 0.0]]
            for r in rows:
                side = sums[r[1][f] > cut]
                side[1] += r[2] - p
                side[2] += p * (1 - p)
            gain = sum(s * s / (h + 0.5) for _, s, h in sums)
            if best is None or gain > best[0]:
                best = (gain, f, sums)
    tree = boosted.trees[0]
    assert tree.feature == f"__f{best[1]}__bin"
    # 255 bins of 300 values: nearly every cut is there
    assert tree.left.output == pytest.approx(best[2][0][1] / (best[2][0][2] + 0.5), rel=0.05) and tree.right.output == pytest.approx(best[2][1][1] / (best[2][1][2] + 0.5), rel=0.05)


def test_losses_and_hooks(spark, tmp_path):
    df, rows = binned(spark)
    seen = []

    def after(k, model, scored):
        seen.append(scored.agg(F.avg(F.log1p(F.exp(-F.when(F.col("label") > 0, F.col("score")).otherwise(-F.col("score")))))).first()[0])
        return len(seen) == 3

    model = registry.train("gbdt_newton", df, rounds=9, depth=2, hooks=trees.Hooks(after_round=after))
    assert len(seen) == 3 == len(model.extra["boosted"]["trees"]) and seen[0] > seen[1] > seen[2]
    model.save(str(tmp_path / "m"))
    told = {r.row: r.score for r in model.score(df).collect()}
    assert {r.row: r.score for r in registry.Model.load(str(tmp_path / "m")).score(df).collect()} == told and all(0 < s < 1 for s in told.values())

    # A loss of one's own, labels of one's own, and a last word on the model.
    def halved(found):
        found.start /= 2
        return found

    pseudo = trees.Loss("pseudo_huber", lambda y, s: (y - s) / F.sqrt(1 + (y - s) * (y - s)), lambda y, s: F.pow(1 + (y - s) * (y - s), -1.5), float, lambda s: s)
    hooks = trees.Hooks(labels=lambda y: y * 10.0, finish=halved)
    found = registry.train("gbdt_newton", df, loss=pseudo, rounds=2, depth=2, hooks=hooks)
    assert found.extra["boosted"]["start"] == pytest.approx(5 * sum(r[2] for r in rows) / len(rows)) and trees.LOSSES["pseudo_huber"] is pseudo
    counts = registry.train("gbdt_newton", df, loss="poisson", rounds=3, depth=2).score(df).agg(F.min("score"), F.avg("score")).first()
    assert counts[0] > 0 and counts[1] == pytest.approx(sum(r[2] for r in rows) / len(rows), rel=0.2)
    with pytest.raises(ValueError, match="another loss"):
        trees.boost(df, "label", ["row"], "row", loss=trees.Loss("poisson", *(None,) * 4))
    with pytest.raises(ValueError, match="pairs"):
        trees.boost(df, "label", ["row"], "row", group="row", loss=trees.LOGISTIC)
