"""Gradient boosting in relational form: bins, residuals, best splits, leaves, smoothing. Each step is a grouped sum or a small join.

First order: leaves are mean residuals. Second order (a Loss given): splits and leaves by sums of slopes and curvatures, leaves are Newton
steps. Ranking: slopes of a group's pairs, or of its discounted gain (LambdaRank)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.batching import draw
from lumenframe.operators.staging import staged


def bin_bounds(df: DataFrame, column: str, bins: int, accuracy: int = 10_000) -> list[float]:
    """Distinct upper bounds of up to `bins` bins of about equal counts, the last the maximum. At most `bins` numbers reach the driver."""
    shares = [(k + 1) / bins for k in range(bins)]
    found = df.agg(F.percentile_approx(column, shares, accuracy).alias("q")).first()["q"]
    return sorted({float(v) for v in found or []})


def bin_medians(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """bin, n, median (the lower of two middle values) of each bin of a column."""
    binned = df.filter(F.col(column).isNotNull()).select(bin_of(F.col(column), bounds).alias("bin"), F.col(column).cast("double").alias("v"))
    counts = binned.groupBy("bin", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("bin").orderBy("v"))
    total = F.sum("c").over(Window.partitionBy("bin"))
    reached = counts.select("bin", "v", upto.alias("upto"), total.alias("n")).filter(F.col("upto") * 2 >= F.col("n"))
    return reached.groupBy("bin").agg(F.first("n").cast("long").alias("n"), F.min("v").alias("median"))


def bin_of(x: Column, bounds: list[float]) -> Column:
    """Number of the first bound that isn't below x; the last for what lies above all. The sorted bounds are searched by halves."""
    if not bounds:
        return F.lit(0)
    known = F.lit([float(b) for b in bounds])
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(known, at + step - 1) < x, step).otherwise(0))
    return F.least(below, F.lit(len(bounds) - 1)).cast("int")


def residual(label: Column, score: Column) -> Column:
    """The gradient of the squared loss."""
    return label.cast("double") - score.cast("double")


def pair_residual(df: DataFrame, group: str, column: str = "residual") -> DataFrame:
    """df with the gradient of the squared loss over a group's pairs, averaged over a row's partners, in place of the rows' own residuals.

    The loss of a pair is ((s - t) - (y - z))^2 for scores s, t and labels y, z; summed over all partners its gradient is n times a row's
    residual less the mean of its group's. So no pairs are made: one mean a group is joined back. Rows without a group are one group."""
    means = df.groupBy(F.col(group).alias("__group")).agg(F.avg(column).alias("__mean"))
    return df.join(means, F.col(group).eqNullSafe(F.col("__group"))).withColumn(column, F.col(column) - F.col("__mean")).drop("__group", "__mean")


def with_order(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of groups with more than one label: the others have no pair to put in order."""
    told = df.groupBy(F.col(group).alias("__group")).agg((F.min(label) < F.max(label)).alias("__told")).filter("__told")
    return df.join(told, F.col(group).eqNullSafe(F.col("__group")), "left_semi")


@dataclass(frozen=True)
class Loss:
    """What boosting lowers: minus its slope and its curvature by the score, the best constant score for a mean label, and what a score
    means."""

    name: str
    slope: Callable[[Column, Column], Column]
    curvature: Callable[[Column, Column], Column]
    start: Callable[[float], float]
    link: Callable[[Column], Column]


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _log_odds(mean: float) -> float:
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return math.log(mean / (1 - mean))


SQUARED = Loss("squared", residual, lambda y, s: F.lit(1.0), float, lambda s: s)
LOGISTIC = Loss("logistic", lambda y, s: y - _sigmoid(s), lambda y, s: _sigmoid(s) * (1 - _sigmoid(s)), _log_odds, _sigmoid)
POISSON = Loss("poisson", lambda y, s: y - F.exp(s), lambda y, s: F.exp(s), lambda mean: math.log(max(mean, 1e-9)), F.exp)
#: Losses by name; others may be added.
LOSSES = {loss.name: loss for loss in (SQUARED, LOGISTIC, POISSON)}


@dataclass
class Hooks:
    """Where a trainer of one's own comes in. labels: the label to learn, made of the given one. after_round: called with the round, the
    model so far and the training rows (key, label, score); true ends the training. finish: called with the model, returns the one to use."""

    labels: Callable[[Column], Column] | None = None
    after_round: Callable[[int, Boosted, DataFrame], bool | None] | None = None
    finish: Callable[[Boosted], Boosted] | None = None


def first_of_groups(df: DataFrame, group: str, order: list[Column], most: int, key: str, slices: int = 32) -> DataFrame:
    """The first rows of each group, with their rank (from 1). Slices of a group are ranked before the group, so that no task sorts all
    rows of a hot one."""
    piece = F.pmod(F.xxhash64(key), F.lit(slices))
    some = df.withColumn("__slice", piece).withColumn("rank", F.row_number().over(Window.partitionBy(group, "__slice").orderBy(*order))).filter(F.col("rank") <= most).drop("__slice", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= most)


def lambda_slopes(df: DataFrame, group: str, key: str, label: str, score: str, most: int = 10, steep: float = 1.0) -> DataFrame:
    """df with residual and curvature: minus the slope, and the curvature, that LambdaRank gives a row for the discounted cumulative gain
    of its group's first `most` places, a share of the best possible.

    A pair of rows with different labels pulls them apart by its logistic loss, weighted by what exchanging their places would change. A
    place beyond `most` counts nothing, so a pair that changes anything has a row in the first `most`: each row meets those of its group
    alone, `most` pairs a row, and all other pairs of the group add 0. Ties of scores go by key. Groups whose labels are all 0 or below
    have nothing to gain."""
    base = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    top = first_of_groups(base, "g", [F.desc("s"), F.asc("k")], most, "k")
    gain, discount = (lambda y: F.pow(F.lit(2.0), y) - 1), (lambda rank: F.coalesce(1 / F.log2(rank + 1.0), F.lit(0.0)))
    ideal = first_of_groups(base.filter("y > 0"), "g", [F.desc("y"), F.asc("k")], most, "k").groupBy("g").agg(F.sum(gain(F.col("y")) * discount(F.col("rank"))).alias("ideal"))
    ahead = top.join(ideal.withColumnRenamed("g", "ig"), F.col("g").eqNullSafe(F.col("ig"))).select(F.col("g").alias("tg"), F.col("k").alias("tk"), F.col("y").alias("ty"), F.col("s").alias("ts"), F.col("rank").alias("tr"), "ideal")
    placed = base.join(top.select(F.col("g").alias("pg"), F.col("k").alias("pk"), "rank"), F.col("g").eqNullSafe(F.col("pg")) & (F.col("k") == F.col("pk")), "left").select("g", "k", "y", "s", "rank")
    met = placed.join(ahead, F.col("g").eqNullSafe(F.col("tg"))).filter((F.col("y") != F.col("ty")) & (F.col("rank").isNull() | (F.col("tr") < F.col("rank"))))
    change = F.abs(gain(F.col("y")) - gain(F.col("ty"))) * F.abs(discount(F.col("rank")) - discount(F.col("tr"))) / F.col("ideal")
    better = F.when(F.col("ty") > F.col("y"), 1.0).otherwise(-1.0)  # the row ahead is the better one
    wrong = _sigmoid(-steep * better * (F.col("ts") - F.col("s")))
    pulled = met.select("g", "k", "tk", (better * steep * wrong * change).alias("pull"), (steep * steep * wrong * (1 - wrong) * change).alias("bend"))
    both = pulled.select("g", F.explode(F.array(F.struct(F.col("tk").alias("k"), "pull", "bend"), F.struct("k", (-F.col("pull")).alias("pull"), "bend"))).alias("x"))
    sums = both.groupBy(F.col("g").alias("sg"), F.col("x.k").alias("sk")).agg(F.sum("x.pull").alias("residual"), F.sum("x.bend").alias("curvature"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return df.join(sums, F.col(group).eqNullSafe(F.col("sg")) & (F.col(key) == F.col("sk")), "left").select(*df.columns, zero("residual"), zero("curvature"))


def leaf_step(output: Column, rate: float, most: float) -> Column:
    """A leaf's output times the learning rate, within +-most."""
    return F.least(F.greatest(output * rate, F.lit(-most)), F.lit(most))


def node_documents(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, docs: documents under each node. leaves: one row a document, with leaf; nodes: node, leaf pairs."""
    counts = leaves.groupBy("leaf").agg(F.count("*").alias("n"))
    return nodes.join(counts, "leaf", "left").groupBy("node").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("docs"))


def best_splits(df: DataFrame, features: list[str], node: str = "node", target: str = "residual", least: int = 1, curvature: str | None = None, ridge: float = 0.0) -> DataFrame:
    """node, feature, bin, gain: the split (bin or below to the left) that lowers the loss of each node most; ties go to the earlier
    feature and the lower bin. df has a bin column for every feature. The gain is sl^2/wl + sr^2/wr - s^2/w for the sums s of the target,
    where the weights w are counts (squared error), or sums of a curvature plus ridge (second order)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f).alias("bin")) for k, f in enumerate(features))))
    bend = F.lit(1.0) if curvature is None else F.col(curvature)
    sums = df.select(node, F.col(target).alias("r"), bend.alias("h"), pairs.alias("p")).groupBy(node, "p.f", "p.bin").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum("h").alias("h"))
    upto = Window.partitionBy(node, "f").orderBy("bin")
    whole = Window.partitionBy(node, "f")
    held = [F.sum(c).over(w).alias(f"{c}{end}") for w, end in ((upto, "l"), (whole, "a")) for c in ("n", "s", "h")]
    cut = sums.select(node, "f", "bin", *held).withColumns({f"{c}r": F.col(f"{c}a") - F.col(f"{c}l") for c in ("n", "s", "h")})
    part = lambda end: F.col(f"s{end}") * F.col(f"s{end}") / (F.col(f"h{end}") + ridge)
    valid = cut.filter((F.col("nl") >= least) & (F.col("nr") >= least) & (F.col("hl") + ridge > 0) & (F.col("hr") + ridge > 0)).withColumn("gain", part("l") + part("r") - part("a"))
    place = F.row_number().over(Window.partitionBy(node).orderBy(F.desc(F.round("gain", 9)), "f", "bin"))
    names = F.element_at(F.array(*(F.lit(f) for f in features)), F.col("f") + 1)
    return valid.withColumn("k", place).filter("k = 1").select(node, names.alias("feature"), "bin", "gain")


@dataclass
class Node:
    """A node of a fitted tree; without a feature it is a leaf."""

    docs: int
    output: float
    feature: str | None = None
    bin: int = -1
    left: Node | None = None
    right: Node | None = None

    def smoothed(self, amount: float, parent: float | None = None) -> float:
        """Pulls outputs towards the parent's: (1 - amount) * weighted mean of the leaves below + amount * parent. Sets the leaves'."""
        own = self.weighted()
        mine = own if parent is None else (1 - amount) * own + amount * parent
        if self.feature is None:
            self.output = mine
        else:
            self.left.smoothed(amount, mine)
            self.right.smoothed(amount, mine)
        return mine

    def weighted(self) -> float:
        """Mean of the leaves' outputs by their documents; NaN without any."""
        if self.feature is None:
            return self.output
        n = self.left.docs + self.right.docs
        return (self.left.docs * self.left.weighted() + self.right.docs * self.right.weighted()) / n if n else float("nan")

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(float(self.output))
        return F.when(F.col(self.feature) <= self.bin, self.left.column()).otherwise(self.right.column())

    def leaf_column(self, name: str = "0") -> Column:
        if self.feature is None:
            return F.lit(name)
        return F.when(F.col(self.feature) <= self.bin, self.left.leaf_column(f"{name}l")).otherwise(self.right.leaf_column(f"{name}r"))

    def shifted(self, delta: float) -> None:
        """Adds delta to all leaves below."""
        if self.feature is None:
            self.output += delta
        else:
            self.left.shifted(delta)
            self.right.shifted(delta)

    def as_dict(self) -> dict:
        found = {"docs": self.docs, "output": self.output}
        return found if self.feature is None else found | {"feature": self.feature, "bin": self.bin, "left": self.left.as_dict(), "right": self.right.as_dict()}

    @staticmethod
    def of(d: dict) -> Node:
        sides = {k: Node.of(d[k]) for k in ("left", "right") if k in d}
        return Node(d["docs"], d["output"], d.get("feature"), d.get("bin", -1), **sides)


@dataclass
class Boosted:
    """A fitted ensemble: bounds of each feature's bins, a start score and trees."""

    features: list[str]
    bounds: dict[str, list[float]]
    start: float
    trees: list[Node] = field(default_factory=list)
    loss: str | None = None  # its name, if its link is to be applied to scores

    def binned(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{f}__bin": bin_of(F.col(f), self.bounds[f]) for f in self.features})

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column()
        if self.loss is not None:
            total = LOSSES[self.loss].link(total)
        return self.binned(df).withColumn(name, total).drop(*(f"{f}__bin" for f in self.features))

    def as_dict(self) -> dict:
        return {"features": self.features, "bounds": self.bounds, "start": self.start, "trees": [tree.as_dict() for tree in self.trees], "loss": self.loss}

    @staticmethod
    def of(d: dict) -> Boosted:
        return Boosted(d["features"], d["bounds"], d["start"], [Node.of(tree) for tree in d["trees"]], d.get("loss"))


def boost(df: DataFrame, label: str, features: list[str], key: str, rounds: int = 10, depth: int = 3, rate: float = 0.1, bins: int = 255, most_output: float = 100.0, bag_fraction: float = 1.0, smoothing: float = 0.0, seed: int = 0, active: list[bool] | None = None, group: str | None = None, filter_zero: bool = False, loss: Loss | None = None, ridge: float = 1.0, first: int | None = None, hooks: Hooks | None = None) -> Boosted:
    """Boosting on binned features, by squared loss unless told otherwise. Scores are a function of the trees so far, not of the rounds'
    lineage, so the plan of a round stays short; what reaches the driver is one split a node. The binned table is cached for the rounds.

    active: which features may be used. group: rank within groups, by the squared loss over a group's pairs, or by the discounted gain of
    its `first` places (LambdaRank); scores of different groups then don't compare. filter_zero: leave out groups without a pair of
    different labels. loss: second-order boosting of that loss, with `ridge` added to curvatures; a loss not in LOSSES is added to it under
    its name. hooks: see Hooks."""
    if group and loss is not None:
        raise ValueError("a group's loss is that of its pairs")
    if loss is not None and LOSSES.setdefault(loss.name, loss) is not loss:
        raise ValueError(f"another loss is called {loss.name}")
    hooks = hooks or Hooks()
    if hooks.labels is not None:
        df = df.withColumn(label, hooks.labels(F.col(label)))
    features = [f for f, on in zip(features, active or [True] * len(features), strict=True) if on]
    if group and filter_zero:
        df = with_order(df, group, label)
    mean = float(df.agg(F.avg(label)).first()[0] or 0.0)
    model = Boosted(features, {f: bin_bounds(df, f, bins) for f in features}, mean if loss is None else loss.start(mean), loss=loss and loss.name)
    names = [f"{f}__bin" for f in features]
    held = model.binned(df).select(key, F.col(label).cast("double").alias("label"), *names, *([F.col(group).alias("group")] if group else [])).persist()
    second = loss is not None or bool(group and first)
    try:
        for k in range(rounds):
            total = F.lit(model.start)
            for tree in model.trees:
                total = total + tree.column()
            rows = held.withColumn("score", total)
            if loss is not None:
                rows = rows.withColumns({"residual": loss.slope(F.col("label"), F.col("score")), "curvature": loss.curvature(F.col("label"), F.col("score"))})
            elif not second:
                rows = rows.withColumn("residual", residual(F.col("label"), F.col("score")))
            if bag_fraction < 1:
                rows = rows.filter(draw(key, seed + k) < bag_fraction)
            if group and first:
                rows = staged(lambda_slopes(rows, "group", key, "label", "score", first))
            elif group:
                rows = pair_residual(rows, "group")
            root = _grow(rows, names, depth, "curvature" if second else None, ridge if second else 0.0)
            if smoothing:
                root.smoothed(smoothing)
            _step(root, rate, most_output)
            model.trees.append(root)
            if hooks.after_round is not None and hooks.after_round(k, model, held.withColumn("score", total + root.column()).select(key, "label", "score")):
                break
    finally:
        held.unpersist()
    return hooks.finish(model) if hooks.finish is not None else model


def _step(node: Node, rate: float, most: float) -> None:
    if node.feature is None:
        node.output = min(max(node.output * rate, -most), most)
    else:
        _step(node.left, rate, most)
        _step(node.right, rate, most)


def _grow(rows: DataFrame, names: list[str], depth: int, curvature: str | None = None, ridge: float = 0.0) -> Node:
    """Level by level: the splits of all nodes of a level come from one query."""
    weight = F.sum(curvature) if curvature else F.count("*").cast("double")
    n, s, w = rows.agg(F.count("*"), F.sum("residual"), weight).first()
    root = Node(n, (s or 0.0) / w_all if (w_all := (w or 0.0) + ridge) else 0.0)
    for _ in range(depth):
        at = root.leaf_column()
        placed = rows.withColumn("node", at)
        splits = {r["node"]: r for r in best_splits(placed, names, curvature=curvature, ridge=ridge).collect() if r["gain"] > 1e-12}
        if not splits:
            break
        _split(root, "0", splits)
        sums = {r["node"]: r for r in rows.withColumn("node", root.leaf_column()).groupBy("node").agg(F.count("*").alias("n"), F.sum("residual").alias("s"), weight.alias("w")).collect()}
        _fill(root, "0", sums, ridge)
    return root


def _split(node: Node, name: str, splits: dict) -> None:
    if node.feature is not None:
        _split(node.left, f"{name}l", splits)
        _split(node.right, f"{name}r", splits)
    elif name in splits:
        node.feature, node.bin = splits[name]["feature"], int(splits[name]["bin"])
        node.left, node.right = Node(0, 0.0), Node(0, 0.0)


def _fill(node: Node, name: str, sums: dict, ridge: float = 0.0) -> int:
    """Sets documents and outputs from the leaves' sums; returns the documents below."""
    if node.feature is None:
        found = sums.get(name)
        node.docs = found["n"] if found else 0
        weight = (found["w"] if found else 0.0) + ridge
        node.output = found["s"] / weight if found and weight else 0.0
    else:
        node.docs = _fill(node.left, f"{name}l", sums, ridge) + _fill(node.right, f"{name}r", sums, ridge)
    return node.docs
