import random
import re
import time

import pytest

from lumenframe.llm import decontaminate as d


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    parsed = [(str(i), words(t)) for i, t in items if i is not None and words(t)]
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for i, v in parsed:
            n = min(window, len(v))
            grams = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    found.add(i)
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, odd, odd_rows, none):
    rng = random.Random(9)
    texts = [t for _, t, *_ in odd_rows if t]
    items = [(k, " ".join(words(rng.choice(texts))[s : s + rng.randint(1, 30)])) for k, s in enumerate([0, 3, 5, 8, 20, 2, 7, 11, 1, 4, 40, 12])]
    items += [(100, None), (101, ""), (None, "word"), (102, "a b c"), (103, "A. B, C!"), (104, "ab " * 12), (105, "unseen words only here of course in no text at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in d.decontaminate(odd, table).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in odd_rows], items)
    kept = d.clean(odd, table)
    dirty = {x[0] for x in got if x[4]}
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in odd_rows if r[0] not in dirty)
    assert d.decontaminate(none, table).count() == 0
    assert d.decontaminate(odd, table.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("vocab", [["a", "b", "c", "dd", "e1"], ["É", "é", "ß", "İ", "i", "I", "\u212a", "k", "ΟΔΟΣ", "οδος", "οδοσ", "ΣΑΣ", "A", "a"]])
@pytest.mark.parametrize("between", [" ", ".", "'", ":", "\u00ad ", ", "])
def test_random_spans_are_never_missed(spark, vocab, between):
    """What stands between words may differ in the item; a capital sigma's small form depends on it."""
    rng = random.Random(10)
    docs = [(k, "".join(rng.choice(vocab) + rng.choice([" ", between]) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    items = [(k, " ".join(words(docs[rng.randrange(40)][1])[rng.randint(0, 20) :][: rng.randint(1, 25)])) for k in range(25)]
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == brute(docs, items)


def test_a_sigma_before_a_stop(spark):
    text = ["ΟΔΟΣ", "ΑΒΓ", "ΛΟΓΟΣ", "ΣΑΣ", *"abcdef"]
    docs = spark.createDataFrame([(1, ".".join(text)), (2, " ".join(text)), (3, "'".join(text)), (4, ". ".join(text[:9]))], "doc_id long, text string")
    found = {r.doc_id: r.n_hit for r in d.decontaminate(docs, spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")).collect()}
    assert found == {1: 10, 2: 10, 3: 10, 4: 0}


def test_work_is_linear_in_texts_that_repeat_themselves(spark):
    docs = [(1, "ab " * 20_000), (2, "ab cd " * 10_000), (3, "x " + "ab " * 15 + "y"), (4, "ab " * 9)]
    items = [(1, "ab " * 400), (2, "ab cd " * 200), (3, "cd " * 9)]
    began = time.time()
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert time.time() - began < 60
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == [(1, 20_000, 20_000, ["1"]), (2, 20_000, 20_000, ["2"]), (3, 17, 15, ["1"]), (4, 9, 0, [])]
