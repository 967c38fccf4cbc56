"""What large tables showed: the same results with work that stays bounded."""

import contextlib
import io
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.models import descent, nce, textcnn
from lumenframe.operators import lookups, sampling, staging
from lumenframe.plans import catalogue
from lumenframe.streaming import seen


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("extended")
    return said.getvalue()


@pytest.mark.parametrize("most", [7, 1 << 17])
def test_nearest_vectors_with_ties_and_odd_ones(spark, most):
    """Against all pairs in numpy: equal vectors (ties go by key), keys twice, keys of another type, null and zero vectors, other lengths."""
    rng = random.Random(3)
    rows = [(f"w{k % 650}", [float(rng.randrange(-2, 3)) for _ in range(4)] + [1.0]) for k in range(700)] + [(None, [1.0] * 5), ("zero", [0.0] * 5), ("none", None), ("hole", [1.0, None, 1.0, 1.0, 1.0]), ("a", [1.0, 2.0]), ("b", [2.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(3)
    plain = [(k, np.array(v)) for k, v in rows if k and v and len(v) == 5 and None not in v and any(v)]
    units = np.array([v / np.sqrt((v * v).sum()) for _, v in plain])
    near = np.round(units @ units.T, 9)
    want = {}
    for i, (k, _) in enumerate(plain):
        if k.endswith("7"):
            found = sorted((-near[i, j], other) for j, (other, _) in enumerate(plain) if other != k)
            want.setdefault(k, []).extend(found)
    got = {}
    for r in lookups.top_k_cosine(df, "k", "v", df.filter("k like '%7'"), 3, most).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -round(r.similarity, 9), r.neighbor_id))
    assert set(got) == set(want)
    for k, found in got.items():
        assert [(s, o) for _, s, o in sorted(found)] == sorted(want[k])[:3]
    odd = {r.query_id: (r.neighbor_id, r.similarity) for r in lookups.top_k_cosine(df, "k", "v", df.filter("k in ('a', 'zero')"), 1, most).collect()}
    assert odd["a"] == ("b", pytest.approx(0.8)) and odd["zero"][1] is None  # nothing is like the zero vector
    numbers = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "k int, v array<double>")
    found = lookups.top_k_cosine(numbers, "k", "v", numbers.withColumn("k", F.col("k").cast("long")), 1, most).collect()
    assert sorted((r.query_id, r.neighbor_id) for r in found) == [(1, 2), (2, 1), (3, 2)]


def test_word_vectors_are_no_literal_of_the_plan(spark, sf):
    """a relation held by the driver was worked on there, and sent out again, for each of its uses."""
    assert "LocalRelation" not in plan_of(catalogue.QUERIES["word2vec"](spark, sf))


def test_pairs_of_vectors_are_not_rows(spark, sf):
    """every pair of a query and a row was a row of a join."""
    plan = plan_of(catalogue.QUERIES["cosine_topk"](spark, sf))
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


class Store:
    """A map and a value as the state store has them; `calls` counts what is asked of either."""

    def __init__(self):
        self.held, self.value, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Count(self)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def keys(self):
        self.calls += 1
        return iter(list(self.held))

    def clear(self):
        self.calls += 1
        self.held.clear()


class Count:
    def __init__(self, store):
        self.store = store

    def exists(self):
        return self.store.value is not None

    def get(self):
        return self.store.value

    def update(self, value):
        self.store.value = value


@pytest.mark.parametrize(("capacity", "sizes", "kinds"), [(20, [4000, 3, 0, 900, 1, 1, 5], 300), (500, [900, 40, 2, 600, 3], 700), (2, [50, 50], 9)])
@pytest.mark.parametrize("whole", [True, False])
def test_the_store_is_asked_for_sets_not_rows(capacity, sizes, kinds, whole, monkeypatch):
    """each row was a call or two of the store. Rows without an order come last, ties go by the key's text, a null key is a key."""
    monkeypatch.setattr(seen, "_ROWS", 37)
    rng, store = random.Random(capacity), Store()
    processor = seen._Seen(capacity, whole)
    processor.init(store)
    own = set()
    for batch, size in enumerate(sizes):
        rows = [(k, None if (x := rng.randrange(kinds)) == 0 else x, rng.choice([float("nan"), *map(float, range(size))])) for k in range(size)]
        want = []
        for k, x, _ in sorted(rows, key=lambda r: (r[2] != r[2], r[2] if r[2] == r[2] else 0, "null" if r[1] is None else f"k{r[1]}")):
            if x not in own:
                want.append((k, x))
                own.add(x)
                if len(own) > capacity:
                    own = set()
        key = [(0 if x is None else x) if whole else ("" if x is None else str(x)) for _, x, _ in rows]
        frame = pd.DataFrame({"id": [r[0] for r in rows], "order__": [r[2] for r in rows], "key__": key, "null__": [r[1] is None for r in rows], "shard__": 0}).astype({"order__": float, "null__": bool})
        before = store.calls
        got = [(k, rows[k][1]) for part in processor.handleInputRows((0,), iter([frame[: size // 2], frame[size // 2 :]]), None) for k in part["id"].tolist()]
        assert [x for _, x in got] == [x for _, x in want] and len(store.held) == len(own), batch
        assert store.calls - before <= 3 * capacity + 3


def test_letters_are_counted_without_patterns(spark, sf):
    """F2: sixteen patterns ran over each text, again for the means, the rows and the scores."""
    assert "regexp_replace" not in plan_of(found := catalogue.QUERIES["train_softmax_sgd"](spark, sf)) and "parquet" not in plan_of(found).lower()
    texts = spark.createDataFrame([("Äpfel à la\\nÉTÉ ñandú, straße; aaa",), ("",), ("İzmir ǅ aé",), (None,)], "text string")
    for c in "aeinorstwyàéñßu":
        of = F.length(F.regexp_replace(F.lower("text"), f"[^{c}]", "")), catalogue.letters(F.col("text"), c)
        assert all(x == y for x, y in texts.select(*of).collect())


TEXTS = [(1, " Aa  b\tc\n\x0b\x0cd\rb "), (2, ""), (3, None), (4, "a"), (5, "\u00a0a \u2003b b\x1cc c"), (6, "É é ÄÄ ä b É"), (7, " \n "), (8, "a b c a b c a b x y z " * 30)]


def test_ids_of_texts_need_no_row_a_word(spark):
    """the same ids as by joining each word to the vocabulary, whichever way; texts of no words have none."""
    df = spark.createDataFrame(TEXTS, "row long, text string").repartition(2)
    vocab = text.vocabulary(df, "text", 6).persist()
    words = df.select("row", text.tokens(F.col("text")).alias("words"))
    want = {k: [] for k, _ in TEXTS} | {r.row: [i for _, i in sorted(r.ids)] for r in text.encode(words, "row", "words", vocab).groupBy("row").agg(F.collect_list(F.struct("pos", "id")).alias("ids")).collect()}
    for most in (32 << 20, 0):
        found = text.id_lists(df.withColumn("label", F.col("row") * 2), "row", "text", vocab, keep=("label",), most=most)
        assert {r.row: r.ids for r in found.collect()} == want and all(r.label == 2 * r.row for r in found.collect())
        found = text.id_lists(df, "row", "text", vocab, unknown=-1, most=most).collect()
        assert {r.row: [max(i, 0) for i in r.ids] for r in found} == want and any(-1 in r.ids for r in found)
    plan = plan_of(text.id_lists(df, "row", "text", vocab))
    assert "Generate explode" not in plan.split("InMemoryRelation")[0] and "MapInArrow" in plan


@pytest.mark.parametrize("words", [7, 60_000])
def test_pairs_are_found_once_for_all_epochs(spark, words, monkeypatch):
    """pairs of each text against pairs_of(), the loss and slopes of a batch by them against those of its ids."""
    rng = np.random.default_rng(4)
    rows = [(k, [None if x > 5 else int(x) if x else 99_999 for x in rng.integers(0, 9, rng.integers(0, 25))]) for k in range(40)] + [(40, None), (41, []), (42, [3]), (43, [-1, 2, 2, 2])]
    monkeypatch.setattr(nce, "_ROWS", 7)
    found = nce.coded(spark.createDataFrame(rows, "row long, ids array<int>").repartition(3), "row", 2, words).toArrow()
    got = {r["row"]: {divmod(c, words): n for c, n in zip(r["code"], r["times"], strict=True)} for r in found.to_pylist()}
    assert set(got) == {k for k, ids in rows if ids is not None}
    for k, ids in rows:
        if ids is not None:
            want = Counter(tuple(sorted((int(a), int(b)))) for a, b in zip(*nce.pairs_of(ids, 2, words), strict=True))
            assert got[k] == {p: n // 2 for p, n in want.items()}
    if words < 100:
        loss = nce.loss_of(sampling.AliasTable.of(np.arange(1.0, 8)), 2, 1100)
        weights = {"center": rng.normal(size=(7, 3)), "context": rng.normal(size=(7, 3)), "bias": rng.normal(size=7)}
        ids = {k: x for k, x in rows if x is not None}
        for low in range(0, 44, 5):
            part = found.slice(low, 5)
            a, b = (loss(weights, t, np.random.default_rng(1)) for t in (part, pa.table({"ids": pa.array([ids[k] for k in part["row"].to_pylist()], pa.list_(pa.int32()))})))
            assert a[0] == pytest.approx(b[0]) and all(np.allclose(a[1][k], b[1][k]) for k in weights)


def test_parts_are_tasks_of_their_own(spark, monkeypatch):
    """dealt by their hash, several parts came to one task, and others had nothing to do."""
    held = []
    monkeypatch.setattr(descent, "staged", lambda df: held.append(staging.staged(df)) or held[-1])
    rows = spark.createDataFrame([(k, [float(k % 7)], k % 2) for k in range(400)], "row long, features array<double>, label int")
    for parts in (4, 5, 8):
        descent.descend(rows, descent.logistic_loss, {"w": np.zeros(1), "b": np.zeros(1)}, epochs=1, parts=parts)
        assert held[-1].select(F.spark_partition_id().alias("task"), "__part").distinct().groupBy("task").count().count() == parts


@pytest.mark.parametrize("keep", [1.0, 0.7])
@pytest.mark.parametrize("words", [1 << 15, 40, 1])
def test_texts_of_a_batch_are_worked_on_together(monkeypatch, keep, words):
    """filters ran over each text by itself. Against each text alone; texts shorter than a filter, repeated words, nulls, none."""
    rng = np.random.default_rng(8)
    weights = {k: w + rng.normal(size=w.shape) * 0.3 for k, w in textcnn.first_weights(9, 4, (2, 3, 5), 6, seed=1).items()}
    ids = [[None if i > 10 else int(i) - 1 for i in rng.integers(0, 12, n)] for n in (0, 1, 2, 3, 4, 5, 17, 30, 8, 0, 12, 90)] + [[3] * 20, []]
    rows = pa.table({"ids": pa.chunked_array([pa.array(ids[:5], pa.list_(pa.int32())), pa.array(ids[5:], pa.list_(pa.int32()))]), "label": pa.chunked_array([[float(k % 2) for k in range(5)], [float(k % 2) for k in range(5, len(ids))]])})
    calls = []
    alone, whole = textcnn._places, textcnn._places_of
    monkeypatch.setattr(textcnn, "_places", lambda *a: calls.append("text") or alone(*a))
    monkeypatch.setattr(textcnn, "_places_of", lambda *a: calls.append("batch") or whole(*a))
    monkeypatch.setattr(textcnn, "_TOGETHER", words)
    loss, slopes = textcnn.loss_of((2, 3, 5), keep)(weights, rows, np.random.default_rng(5))
    assert ("text" in calls) == (words < 1 << 15) and (words > 40) <= (len(calls) == 3)
    kept, total, sums = np.random.default_rng(5).random((len(ids), 18)), 0.0, {k: np.zeros_like(w) for k, w in weights.items()}
    for k in range(len(ids)):
        fixed = type("Fixed", (), {"random": lambda self, shape, row=kept[k]: row.reshape(shape)})()
        one, slope = textcnn.loss_of((2, 3, 5), keep)(weights, rows.slice(k, 1), fixed)
        total, sums = total + one, {n: sums[n] + slope[n] for n in sums}
    assert loss == pytest.approx(total) and all(np.allclose(slopes[n], sums[n]) for n in sums)


def test_pairs_of_words_are_shuffled_once(spark, sf):
    """pairs were shuffled in the text's direction and then, twice as many, in both."""
    plan = plan_of(catalogue.QUERIES["skipgram_pairs"](spark, sf)).split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") <= 1
    df = spark.createDataFrame([(["b", None, "a", "a", None, None],), (["a", "b", "b"],), (None,)], "w array<string>").repartition(2)
    want = Counter()
    for r in df.collect():
        for i, x in enumerate(r.w or []):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(r.w):
                    want[x, r.w[j]] += 1
    assert {(r.center, r.context): r.n for r in text.skipgram_counts(df, "w", 2).collect()} == want


def test_pieces_of_pairs_add_up(monkeypatch):
    """pairs of a few texts at a time, in buckets, against plain counts; null texts and words, several pieces a bucket, slices."""
    monkeypatch.setattr(text, "_WORDS", 9)
    monkeypatch.setattr(text, "_OUT", 5)
    rng = random.Random(2)
    texts = [[rng.choice(["a", "b", "é", "", None, "中文", "zz"]) for _ in range(rng.randint(0, 12))] for _ in range(30)] + [None, [], ["a"], ["a", "a", "a"]]
    batch = pa.record_batch([pa.array(texts, pa.list_(pa.string()))], names=["words"])
    made = [r for b in text._pieces(2, 3)([batch.slice(0, 20), batch.slice(20)]) for r in b.to_pylist()]
    want = Counter((w[i], w[j]) for w in texts if w for i in range(len(w)) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(w))
    got = {}
    for k in range(3):
        own = pa.record_batch({"bucket": [r["bucket"] for r in made if r["bucket"] == k], "piece": pa.array([r["piece"] for r in made if r["bucket"] == k], pa.binary())})
        for out in text._summed(iter([own])):
            for r in out.to_pylist():
                assert (r["center"], r["context"]) not in got
                got[r["center"], r["context"]] = r["n"]
    assert got == want and len(made) > 9 and not list(text._summed(iter([])))
    words = [f"word{int(w)}" for w in np.random.default_rng(1).zipf(1.3, 20_000) % 5000]
    pairs = pa.record_batch([pa.array([words[k : k + 200] for k in range(0, 20_000, 200)])], names=["words"])
    monkeypatch.setattr(text, "_WORDS", 1 << 20)
    made = list(text._pieces(2, 4)([pairs]))
    assert sum(len(b["piece"][0].as_py()) for b in made) < 10 * sum(b.num_rows for p in made for b in text._summed(iter([p]))) / 2
