"""Trainers by name over Spark ML, their scores as one column, calibration, ensembles, early stopping, and models kept in a folder.

A trainer takes a frame with label and an array of features. Unknown names are errors.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Bucketizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import mathfn, vectors
from lumenframe.models.descent import Checkpoints, Optimiser, descend, hidden_loss, logistic_loss, matrix, softmax_loss
from lumenframe.operators.batching import draw
from lumenframe.operators.metrics import auc
from lumenframe.operators.sampling import ensemble_spec
from lumenframe.operators.staging import staged
from lumenframe.operators.trees import LOSSES, Boosted, Hooks, Loss, boost


def vectorised(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))


@dataclass
class Model:
    """A fitted stage, how its score is read, and a calibration over it, if any."""

    kind: str
    stage: Any
    width: int
    extra: dict = field(default_factory=dict)
    calibrator: Any = None

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the score: for two classes the probability of label 1 (or the margin, where there is none); for a regression its value.
        More classes: all probabilities, as an array."""
        if self.kind == "random":
            out = df.withColumn(name, draw(self.extra["key"], self.extra["seed"]))
        elif self.kind == "gradient":
            out = df.withColumn(name, mathfn.sigmoid(vectors.dot(F.col("features"), F.lit(self.extra["weights"])) + self.extra["bias"]))
        elif self.kind == "layers":
            out = self._layers(df, name)
        elif self.kind == "boosted":
            out = Boosted.of(self.extra["boosted"]).score(_spread(df, self.width), name).drop(*_spots(self.width))
        else:
            out = self.stage.transform(vectorised(df))
            if "probability" in out.columns:
                all_of = vector_to_array("probability")
                out = out.withColumn(name, F.get(all_of, 1) if self.extra.get("classes", 2) == 2 else all_of)
            elif "rawPrediction" in out.columns:
                out = out.withColumn(name, F.get(vector_to_array("rawPrediction"), 1))
            else:
                out = out.withColumn(name, F.col("prediction"))
            out = out.drop("__v", "rawPrediction", "probability", "prediction")
        return out if self.calibrator is None else self.calibrator.apply(out, name)

    def _layers(self, df: DataFrame, name: str) -> DataFrame:
        """Each layer is a projection of its own, so that no expression holds another's many times over."""
        x = F.zip_with(F.zip_with(F.col("features").cast("array<double>"), F.lit(self.extra["mean"]), lambda x, m: x - m), F.lit(self.extra["spread"]), lambda x, d: x / d)
        out = df.withColumn("__x", x)
        for k, (rows, bias) in enumerate(self.extra["layers"]):
            of = F.array(*(vectors.dot(F.col("__x"), F.lit(row)) + b for row, b in zip(rows, bias, strict=True)))
            out = out.withColumn("__x", of if k == len(self.extra["layers"]) - 1 else F.transform(of, F.tanh))
        odds = mathfn.softmax(F.col("__x"))
        return out.withColumn(name, F.get(odds, 1) if self.extra["classes"] == 2 else odds).drop("__x")

    def save(self, path: str) -> None:
        """A folder with the stage and what else is needed; an older one at this path is overwritten by its parts alone."""
        spark = self.stage._java_obj and _session() if self.stage is not None else _session()
        if self.stage is not None:
            self.stage.write().overwrite().save(f"{path}/stage")
        meta = {"kind": self.kind, "width": self.width, "extra": self.extra, "stage": None if self.stage is None else f"{type(self.stage).__module__}.{type(self.stage).__name__}", "calibrator": None if self.calibrator is None else self.calibrator.as_dict()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> Model:
        meta = json.loads(_session().read.text(f"{path}/meta").first()["value"])
        stage = None
        if meta["stage"]:
            module, _, name = meta["stage"].rpartition(".")
            stage = getattr(importlib.import_module(module), name).load(f"{path}/stage")
        return Model(meta["kind"], stage, meta["width"], meta["extra"], None if meta["calibrator"] is None else Calibrator(**meta["calibrator"]))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass
class Calibrator:
    """score -> probability: a logistic line, or steps of an isotonic fit."""

    kind: str
    line: list[float] | None = None
    bounds: list[float] | None = None
    values: list[float] | None = None

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        x = F.col(name)
        if self.kind == "sigmoid":
            return df.withColumn(name, 1 / (1 + F.exp(-(F.lit(self.line[0]) + F.lit(self.line[1]) * x))))
        last = dict(zip(self.bounds, self.values, strict=True))  # of equal bounds the last
        splits = [-math.inf, *(b for b in last if b > -math.inf), math.inf]
        # Bucketizer searches by halves; what is not a number lies above all bounds, as in any ordering of Spark's.
        placed = Bucketizer(splits=splits, inputCol="__x", outputCol="__at", handleInvalid="keep").transform(df.withColumn("__x", x.cast("double")))
        values = [self.values[0], *(v for b, v in last.items() if b > -math.inf)]
        at = F.least(F.col("__at").cast("int"), F.lit(len(values) - 1))
        return placed.withColumn(name, F.when(F.col("__x").isNotNull(), F.get(F.lit(values), at))).drop("__x", "__at")

    def as_dict(self) -> dict:
        return {"kind": self.kind, "line": self.line, "bounds": self.bounds, "values": self.values}


def calibrate(df: DataFrame, score: str, label: str, kind: str = "sigmoid") -> Calibrator:
    """Fits score against label."""
    one = df.select(F.col(label).cast("double").alias("label"), F.array(F.col(score).cast("double")).alias("features"))
    if kind == "sigmoid":
        fitted = LogisticRegression(featuresCol="__v", labelCol="label").fit(vectorised(one))
        return Calibrator("sigmoid", [float(fitted.intercept), float(fitted.coefficients[0])])
    if kind == "isotonic":
        fitted = IsotonicRegression(featuresCol="__v", labelCol="label").fit(vectorised(one))
        return Calibrator("isotonic", bounds=[float(v) for v in fitted.boundaries], values=[float(v) for v in fitted.predictions])
    raise ValueError(f"unknown calibration {kind}")


def _fit(stage, kind: str, df: DataFrame, **extra) -> Model:
    width = len(df.select("features").first()["features"])
    return Model(kind, stage.fit(vectorised(df)), width, extra)


def logistic(df: DataFrame, reg: float = 0.0, bias: bool = True, rounds: int = 100) -> Model:
    return _fit(LogisticRegression(featuresCol="__v", regParam=reg, fitIntercept=bias, maxIter=rounds), "logistic", df)


def gradient_logistic(df: DataFrame, optimiser: str = "adagrad", rate: float = 0.1, rounds: int = 50, bias: bool = True, standardise: bool = True, checkpoint: Checkpoints | None = None) -> Model:
    """Logistic regression by an optimiser of choice (descent, adagrad, adam), each step on the gradient over all rows: partitions add up
    their own, and one vector of the model's size comes back. Rows without a label or features take no part. standardise: steps are
    taken on features of unit deviation (and, with a bias, of mean 0); the weights returned are those of the features as they are.
    checkpoint: where each step's weights and sums are kept; a folder with steps is continued."""
    rows = staged(df.select(F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features")).dropna())
    width, n = len(rows.select("features").first()["features"]), rows.count()
    weights, steps = np.zeros(width + 1), Optimiser(optimiser, rate)
    mean, spread = np.zeros(width), np.ones(width)
    if standardise:
        found = vectorised(rows).agg(Summarizer.metrics("mean", "std").summary(F.col("__v")).alias("s")).first()["s"]
        spread = np.where(found["std"].toArray() > 0, found["std"].toArray(), 1.0)
        mean = found["mean"].toArray() if bias else mean
    first = 0
    if checkpoint is not None and (kept := checkpoint.latest()) is not None:
        first, arrays, _ = kept
        weights, steps = arrays["weights"], steps.with_sums(arrays["sums"])
    for k in range(first, rounds):
        now = rows.sparkSession.sparkContext.broadcast(weights)

        def part(it, now=now):
            total, w = np.zeros(width + 1), now.value
            for b in it:
                x = (matrix(b.column("features"), width) - mean) / spread
                over = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - b.column("label").to_numpy(zero_copy_only=False)
                total += np.r_[over @ x, over.sum()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(total)], names=["at", "slope"])

        sums = rows.mapInArrow(part, "at long, slope double").groupBy("at").agg(F.sum("slope").alias("slope")).toArrow().sort_by("at")
        slope = sums["slope"].to_numpy() / n
        weights = steps.step(weights, slope if bias else np.r_[slope[:-1], 0.0])
        now.unpersist()
        if checkpoint is not None:
            checkpoint.save(k + 1, {"weights": weights, "sums": steps.sums(width + 1)})
    own = weights[:-1] / spread
    return Model("gradient", None, width, {"weights": own.tolist(), "bias": float(weights[-1] - own @ mean)})


def _standardised(df: DataFrame, key: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """key, features of mean 0 and deviation 1, label; and the means and deviations."""
    rows = df.select(key, F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label")).dropna()
    found = vectorised(rows).agg(Summarizer.metrics("mean", "std").summary(F.col("__v")).alias("s")).first()["s"]
    mean, spread = found["mean"].toArray(), found["std"].toArray()
    spread = np.where(spread > 0, spread, 1.0)
    ratio = F.zip_with(F.zip_with("features", F.lit(mean.tolist()), lambda x, m: x - m), F.lit(spread.tolist()), lambda x, d: x / d)
    return rows.withColumn("features", ratio), mean, spread


def logistic_sgd(df: DataFrame, key: str = "row", seed: int = 0, **steps) -> Model:
    """Logistic regression by mini-batches in partitions (descent.descend, which takes `steps`), on standardised features."""
    rows, mean, spread = _standardised(df, key)
    w = descend(rows, logistic_loss, {"w": np.zeros(len(mean)), "b": np.zeros(1)}, key=key, seed=seed, **steps).weights
    own = w["w"] / spread
    return Model("gradient", None, len(mean), {"weights": own.tolist(), "bias": float(w["b"][0] - own @ mean)})


def softmax_sgd(df: DataFrame, key: str = "row", hidden: int = 0, seed: int = 0, **steps) -> Model:
    """Softmax regression over labels 0, 1, ..., or one hidden layer of tanh units below it, by mini-batches in partitions."""
    rows, mean, spread = _standardised(df, key)
    classes, rng = max(2, int(rows.agg(F.max("label")).first()[0]) + 1), np.random.default_rng(seed)
    top = {"w": np.zeros((hidden or len(mean), classes)), "b": np.zeros(classes)}
    below = math.sqrt(6 / (len(mean) + hidden))
    first = {"w0": rng.uniform(-below, below, (len(mean), hidden)), "b0": np.zeros(hidden)} if hidden else {}
    w = descend(rows, hidden_loss if hidden else softmax_loss, first | top, key=key, seed=seed, **steps).weights
    layers = [(w["w0"], w["b0"])] if hidden else []
    return Model("layers", None, len(mean), {"mean": mean.tolist(), "spread": spread.tolist(), "classes": classes, "layers": [[a.T.tolist(), b.tolist()] for a, b in [*layers, (w["w"], w["b"])]]})


def softmax(df: DataFrame, reg: float = 0.0, rounds: int = 100) -> Model:
    classes = int(df.agg(F.max("label")).first()[0]) + 1
    return _fit(LogisticRegression(featuresCol="__v", family="multinomial", regParam=reg, maxIter=rounds), "softmax", df, classes=classes if classes > 2 else 2)


def linear_svm(df: DataFrame, reg: float = 0.001, rounds: int = 100) -> Model:
    return _fit(LinearSVC(featuresCol="__v", regParam=reg, maxIter=rounds), "linear_svm", df)


def svm_probability(df: DataFrame, reg: float = 0.001, rounds: int = 100) -> Model:
    """A linear SVM whose margin is calibrated to a probability."""
    model = linear_svm(df, reg, rounds)
    model.kind, model.calibrator = "svm_probability", calibrate(model.score(df), "score", "label")
    return model


def mlp(df: DataFrame, hidden: tuple[int, ...] = (20,), rounds: int = 100, seed: int = 1) -> Model:
    classes = max(2, int(df.agg(F.max("label")).first()[0]) + 1)
    width = len(df.select("features").first()["features"])
    stage = MultilayerPerceptronClassifier(featuresCol="__v", layers=[width, *hidden, classes], maxIter=rounds, seed=seed)
    return _fit(stage, "mlp", df, classes=classes)


def mlp2(df: DataFrame, hidden: tuple[int, ...] = (20, 10), rounds: int = 100, seed: int = 1) -> Model:
    return mlp(df, hidden, rounds, seed)


def gbdt(df: DataFrame, rounds: int = 20, depth: int = 4, seed: int = 1, unbalanced: bool = False, calibration: str | None = None, most_calibration: int | None = None) -> Model:
    """unbalanced: rows weigh so that both classes weigh alike. calibration: sigmoid or isotonic, over at most about most_calibration rows."""
    stage = GBTClassifier(featuresCol="__v", maxIter=rounds, maxDepth=depth, seed=seed)
    rows = df
    if unbalanced:
        n, ones = df.agg(F.count("*"), F.sum((F.col("label") > 0).cast("double"))).first()
        stage = stage.setWeightCol("__weight")
        rows = df.withColumn("__weight", F.when(F.col("label") > 0, n / max(1.0, 2 * (ones or 0))).otherwise(n / max(1.0, 2 * (n - (ones or 0)))))
    model = _fit(stage, "gbdt", rows)
    if calibration:
        share = 1.0 if most_calibration is None else min(1.0, most_calibration / max(1, df.count()))
        held = model.score(df.filter(draw(F.to_json(F.struct("features")), seed) < share)) if share < 1 else model.score(df)
        model.calibrator = calibrate(held, "score", "label", calibration)
    return model


def gbdt_regression(df: DataFrame, rounds: int = 20, depth: int = 4, seed: int = 1) -> Model:
    return _fit(GBTRegressor(featuresCol="__v", maxIter=rounds, maxDepth=depth, seed=seed), "gbdt_regression", df)


def _spots(width: int) -> list[str]:
    return [f"__f{k}" for k in range(width)]


def _spread(df: DataFrame, width: int) -> DataFrame:
    return df.withColumns({f: F.get("features", F.lit(k)) for k, f in enumerate(_spots(width))})


def gbdt_ranking(df: DataFrame, group: str = "group", key: str = "row", rounds: int = 20, depth: int = 4, rate: float = 0.1, filter_zero: bool = False, seed: int = 1, first: int | None = None) -> Model:
    """Boosted trees that order the rows of a group by label: by squared loss over the pairs of a group, or, with `first`, by the
    discounted gain of that many places (trees.boost)."""
    width = len(df.select("features").first()["features"])
    found = boost(_spread(df, width), "label", _spots(width), key, rounds, depth, rate, seed=seed, group=group, filter_zero=filter_zero, first=first)
    return Model("boosted", None, width, {"boosted": found.as_dict()})


def gbdt_newton(df: DataFrame, loss: str | Loss = "logistic", key: str = "row", rounds: int = 20, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, seed: int = 1, hooks: Hooks | None = None, **more) -> Model:
    """Second-order boosted trees for a loss by name (trees.LOSSES) or one's own, with hooks (trees.Hooks)."""
    width = len(df.select("features").first()["features"])
    found = boost(_spread(df, width), "label", _spots(width), key, rounds, depth, rate, seed=seed, loss=LOSSES[loss] if isinstance(loss, str) else loss, ridge=ridge, hooks=hooks, **more)
    return Model("boosted", None, width, {"boosted": found.as_dict()})


def random_scores(df: DataFrame, key: str = "row", seed: int = 0) -> Model:
    return Model("random", None, 0, {"key": key, "seed": seed})


#: Trainers by name; several names of other toolkits lead to the nearest that Spark has.
TRAINERS: dict[str, Callable[..., Model]] = {
    "logistic": logistic,
    "gradient": gradient_logistic,
    "logistic_sgd": logistic_sgd,
    "softmax": softmax,
    "softmax_sgd": softmax_sgd,
    "linear_svm": linear_svm,
    "sofia": linear_svm,
    "liblinear": logistic,
    "libsvm": svm_probability,
    "vw": logistic,
    "mlp": mlp,
    "mlp2": mlp2,
    "gbdt": gbdt,
    "gbdt_regression": gbdt_regression,
    "gbdt_ranking": gbdt_ranking,
    "gbdt_newton": gbdt_newton,
    "random": random_scores,
}


def register(name: str, trainer: Callable[..., Model]) -> None:
    """Adds a trainer: called with a frame of label and features (and its parameters), it returns a Model or what has score(df, name)."""
    TRAINERS[name] = trainer


def train(kind: str, df: DataFrame, **params) -> Model:
    if kind not in TRAINERS:
        raise ValueError(f"unknown trainer {kind}; known: {', '.join(TRAINERS)}")
    return TRAINERS[kind](df, **params)


@dataclass
class Ensemble:
    models: list[Model]
    calibrator: Calibrator | None = None

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """The mean of the members' scores, calibrated once at the end."""
        parts = [f"__m{k}" for k in range(len(self.models))]
        for model, part in zip(self.models, parts, strict=True):
            df = model.score(df, part)
        out = df.withColumn(name, sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts)).drop(*parts)
        return out if self.calibrator is None else self.calibrator.apply(out, name)


def ensemble(df: DataFrame, names: str, counts: str, key: str, rate: float = 0.7, seed: int = 0, calibration: str | None = "sigmoid") -> Ensemble:
    """Members trained on bags of their own. Members of one kind aren't calibrated by themselves."""
    models = []
    for kind, count in ensemble_spec(names, counts):
        for _ in range(count):
            models.append(train(kind, df.filter(draw(key, seed + len(models)) < rate)))
    if len({m.kind for m in models}) == 1:
        for m in models:
            m.calibrator = None
    found = Ensemble(models)
    if calibration:
        found.calibrator = calibrate(found.score(df), "score", "label", calibration)
    return found


def first_plateau(scores: list[float], least: float = 0.001) -> int:
    """Index of the first score that beats the one before by less than `least`; the last, if none."""
    return next((k for k in range(1, len(scores)) if scores[k] - scores[k - 1] < least), len(scores) - 1)


def with_patience(step: Callable[[int], float], start: int = 10_000, every: int = 1, factor: int = 2, gain: float = 1e-4, most: int = 1_000_000) -> tuple[int, float]:
    """Runs step(iteration) -> score until the patience is used up; a gain over the best extends it to factor * iteration. Returns the
    best iteration and score."""
    best, at, patience, k = float("-inf"), 0, start, 0
    while k < min(patience, most):
        found = step(k)
        if found > best:
            if found > best + gain:
                patience = max(patience, k * factor)
            best, at = found, k
        k += every
    return at, best


def validated(kind: str, train_df: DataFrame, valid: dict[str, DataFrame], grid: list[dict]) -> list[dict]:
    """Trains each setting and reports its AUC on every validation frame."""
    out = []
    for params in grid:
        model = train(kind, train_df, **params)
        out.append(params | {name: float(auc(model.score(v), "label", "score").first()["auc"]) for name, v in valid.items()})
    return out


def word2vec(df: DataFrame, words: str, size: int = 16, window: int = 1, least: int = 1, rounds: int = 1, seed: int = 1):
    """Skip-gram embeddings (hierarchical softmax). The model averages a row's words by transform()."""
    return Word2Vec(inputCol=words, outputCol="embedding", vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, numPartitions=4).fit(df)


def cbow(df: DataFrame, words: str, size: int = 16, **params) -> tuple[Any, Model]:
    """Mean of word vectors, then a linear model."""
    embedder = word2vec(df, words, size)
    rows = embedder.transform(df).withColumn("features", vector_to_array("embedding")).drop("embedding")
    return embedder, logistic(rows, **params)
