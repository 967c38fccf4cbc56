import pickle
import random
import zlib
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import quality, toxicity
from lumenframe.llm.queries import op3_toxicity, op4_quality


@pytest.mark.parametrize("common", [0, 3, 256])
def test_block_max_search_is_exact(common):
    rng = random.Random(1)
    vectors = []
    for _ in range(500):
        v = {rng.randrange(200): rng.random() for _ in range(rng.randint(0, 8))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    vectors += vectors[:40]  # ties
    vectors += [v | {7: 0.01} for v in vectors[40:140]]  # a common term
    index = toxicity.BlockMaxIndex(vectors, 200, block=16, common=common)
    assert sorted(index.order) == list(range(len(vectors)))
    found = list(index.search_all(vectors, 7, list(range(len(vectors)))))
    for n, q in enumerate(vectors):
        want = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), k) for k, v in enumerate(vectors) if k != n))[:7]
        ids, similarity = found[n]
        assert list(index.search(q, 7, without=n)[0]) == list(ids)
        assert [k for s, k in want if s < 0] == list(ids) and np.allclose([-s for s, k in want if s < 0], similarity)


def test_linear_time_identity_equals_all_pairs():
    rng = np.random.default_rng(2)
    width = quality.STATISTICS + 64
    machine = quality.Machine(0.1, rng.normal(size=width), rng.normal(size=(width, 3)) * 0.1, 64)
    at, x = quality.features("Some words, some more words!\nAnd 12 numbers", 40, 64)
    pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    assert machine.score("Some words, some more words!\nAnd 12 numbers", 40) == pytest.approx(1 / (1 + np.exp(-(0.1 + machine.linear[at] @ x + pairs))))


def labelled(spark, n: int = 240):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        text = [rng.choice(words) for _ in range(40)] + (["vileword", "rudeness"] if bad else [])
        rng.shuffle(text)
        rows.append((k, " ".join(text), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_only_toxic_words_are_found(spark):
    rows = labelled(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.filter("doc_id < 160").select("doc_id", "label"))
    got = toxicity.score(rows, model).filter("doc_id >= 160").collect()
    assert all((r.score >= 0.7) == (r.label == 1) for r in got)


def test_toxic_words_are_found(spark, odd, none):
    rows = labelled(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.filter("doc_id < 160").select("doc_id", "label"))
    got = toxicity.score(rows, model).filter("doc_id >= 160").collect()
    assert all(r.score >= 0.7 for r in got if r.label)
    assert all(e.doc_id < 160 for r in got for e in r.evidence) and all(r.evidence for r in got if r.label)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and scored.filter("score is null or score not between 0 and 1").count() == 0
    assert "band" in scored.columns and dict(scored.dtypes)["score"] == "double"
    assert toxicity.score(none, model).count() == 0


@pytest.mark.parametrize("fit", [toxicity.fit, quality.fit])
def test_missing_labels(spark, odd, fit):
    nothing = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(4, 1), (5, 1), (None, 1), (6, None), (99999, 0)], "doc_id long, label int")
    module = toxicity if fit is toxicity.fit else quality
    assert {round(r.score, 6) for r in module.score(odd, fit(odd, nothing)).collect()} == {0.0}
    got = {round(r.score, 3) for r in module.score(odd, fit(odd, one)).collect()}
    assert len(got) == 1 and 0.5 < got.pop() <= 1


def test_fit_on_an_empty_table(spark, none):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0 and quality.score(none, quality.fit(none, labels)).count() == 0


def test_queries_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = op4_quality(spark, sf).join(labels, "doc_id").filter("held_out")
    assert q.filter(F.col("predicted") == F.col("quality")).count() >= 0.9 * q.count()
    t = op3_toxicity(spark, sf).join(labels, "doc_id").filter("held_out")
    assert t.filter(F.col("predicted") == F.col("toxic")).count() >= 0.9 * t.count()


def test_every_term_is_indexed(spark):
    """Words that have nothing to do with the label find neighbours too; cosines are those over all terms."""
    rows = labelled(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.filter("doc_id < 160").select("doc_id", "label"), k=200)
    texts = {r.doc_id: r.text for r in rows.collect()}
    at = model.vocabulary.at
    every = {i: toxicity.term_counts(t) for i, t in texts.items()}
    assert set(at) == {t for i in texts if i < 160 for t in every[i]}

    def vector(i):
        v = {at[t]: (1 + np.log(n)) * model.weights[at[t]] for t, n in every[i].items() if t in at}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    held = {i: vector(i) for i in texts}
    for r in toxicity.score(rows, model).filter("doc_id >= 160").collect():
        want = {i: s for i in range(160) if (s := sum(x * held[i].get(t, 0) for t, x in held[r.doc_id].items())) > 0}
        assert want and {e.doc_id for e in r.evidence} == set(want) and all(abs(e.similarity - want[e.doc_id]) < 1e-9 for e in r.evidence)


def test_a_sent_model_is_the_same(spark):
    rows = labelled(spark, 80)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "label"))
    sent = pickle.loads(pickle.dumps(model))
    texts = [r.text for r in rows.collect()]
    assert sent.scores(texts) == model.scores(texts)


def plain_toxicity(docs, labels, per_class=3000, k=15):
    """All cosines of all pairs, in plain Python: id -> score."""
    counts = {i: toxicity.term_counts(t) for i, t in docs.items()}
    known = {i: y for i, y in labels.items() if i in docs}
    both = Counter(labels.values())
    shares = [both[c] / sum(both.values()) for c in (0, 1)]
    signs, held = {}, []
    for i in sorted(known):
        own = toxicity.copy_signs(counts[i])
        if not any(s in signs for s in own):
            held.append(i)
        for s in own:
            signs.setdefault(s, i)
    terms = sorted({t for i in held for t in counts[i]})
    df = Counter(t for c in counts.values() for t in c)
    n, ones = len(held), sum(known[i] for i in held)
    least = NormalDist().inv_cdf(1 - toxicity.ERROR / (2 * len(terms))) ** 2
    weight = {}
    for t in terms:
        a = sum(known[i] for i in held if t in counts[i])
        b = sum(t in counts[i] for i in held) - a
        chi = n * (a * (n - ones - b) - b * (ones - a)) ** 2 / ((a + b) * (n - a - b) * ones * (n - ones)) if a + b < n else 0
        weight[t] = (np.log((1 + len(docs)) / (1 + df[t])) + 1) * (max(chi, 1) if chi >= least else 1)

    def unit(i):
        v = {t: (1 + np.log(m)) * weight[t] for t, m in counts[i].items() if t in weight}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    units = {i: unit(i) for i in docs}
    per = Counter(known[i] for i in held)
    vote = {i: shares[known[i]] / per[known[i]] for i in held}

    def share(i, without=None):
        near = sorted((-round(s, 12), j) for j in held if j != without and (s := sum(x * units[j].get(t, 0) for t, x in units[i].items())) > 0)[:k]
        if not near:
            return None
        own = [(vote[j] / (1.1 + s), known[j]) for s, j in near]
        return sum(v * y for v, y in own) / sum(v for v, _ in own)

    left_out = {i: share(i, i) for i in held}
    some = [i for i in held if left_out[i] is not None]
    line = toxicity._logistic(np.array([left_out[i] for i in some]), np.array([float(known[i]) for i in some]), np.array([vote[i] for i in some]) * n)
    rest = [i for i in held if left_out[i] is None]
    pull = 2 * np.mean(list(vote.values()))
    prior = (sum(vote[i] * known[i] for i in rest) + pull * shares[1]) / (sum(vote[i] for i in rest) + pull)
    return {i: prior if (s := share(i)) is None else 1 / (1 + np.exp(-(line[0] + line[1] * s))) for i in docs}


def test_toxicity_query_against_all_pairs(spark, tmp_path):
    rng = random.Random(21)
    rows = [(r.doc_id, r.text, r.label) for r in labelled(spark, 150).collect()] + [(500, None, 0), (501, "", 1), (502, "no known words here", None)]
    rows += [(600 + k, rows[k][1] + " more", rows[k][2]) for k in range(5)]  # near copies of examples
    rng.shuffle(rows)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, y) for i, _, y in rows if y is not None], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in op3_toxicity(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    want = plain_toxicity({i: t for i, t, _ in rows}, {i: y for i, _, y in rows if y is not None and not held[i]})
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.held_out == held[i] and abs(r.score - want[i]) < 1e-6 and r.predicted == int(r.score >= 0.7), (i, r.score, want[i])


def test_quality_query_against_all_pairs_of_features(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.label) for r in labelled(spark, 150).collect()] + [(500, None, 0), (501, "", 1), (502, "long " * 20_000, None)]
    rows += [(3, "another text of an id", 0), rows[0]]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else len(t or "")) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, y) for i, _, y in rows if y is not None], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in op4_quality(spark, str(tmp_path)).collect())
    learn = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None and zlib.crc32(str(i).encode()) % 5], "doc_id long, label int")
    m = quality.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), learn)
    want = []
    for r in docs.collect():
        at, x = quality.features(r.text, r.n_chars, m.buckets)
        z = m.intercept + float(m.linear[at] @ x) + sum(float(m.factors[at[i]] @ m.factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        want.append((r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 0, round(float(s), 9), int(s >= 0.3)))
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 and a[3] == b[3] for a, b in zip(got, sorted(want), strict=True))


def test_fit_lets_go_of_the_examples_table(spark, monkeypatch):
    """What the driver collected is counted and freed before the index is built."""
    rng, held = random.Random(2), []
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, label int")
    made = toxicity.Model
    monkeypatch.setattr(toxicity, "Model", lambda *a: held.append(pa.total_allocated_bytes()) or made(*a))
    before = pa.total_allocated_bytes()
    assert len(toxicity.fit(docs, labels).ids) == 200
    assert held[0] - before < 200_000  # the table of the examples takes half a MB
