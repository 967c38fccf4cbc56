import random
import re

import pytest

from lumenframe.llm import spans


def brute(rows, n, m):
    """doc_id -> (n_sentences, n_removed, first_doc_id, text), over rows of one text for each id."""
    held = {}
    for i, t in rows:
        t = t or ""
        found = [x for x in re.split(r"(?<=[.!?])(?=[\t\n\f\r ])|(?<=\n)", t) if x.strip("\t\n\f\r ")]
        held[i] = [re.sub(r"[\t\n\f\r ]+", " ", x.strip("\t\n\f\r ")) for x in found]
    places = {}
    for i in sorted(held):
        s = [re.sub("[A-Z]", lambda x: x[0].lower(), x) for x in held[i]]
        if s and len(s) < n and sum(len(x.split(" ")) for x in s) < m:
            places.setdefault(tuple(s), []).append((i, 0, len(s)))
            continue
        for a in range(len(s)):
            for b in range(a + 1, min(a + n, len(s)) + 1):
                if b - a == n or sum(len(x.split(" ")) for x in s[a:b]) >= m:
                    places.setdefault(tuple(s[a:b]), []).append((i, a, b))
    gone, first = {i: set() for i in held}, {}
    for found in places.values():
        for i, a, b in found[1:]:
            gone[i] |= set(range(a, b))
            first[i] = min(first.get(i, i), found[0][0])
    return {i: (len(held[i]), len(gone[i]), first.get(i), [x for k, x in enumerate(held[i]) if k not in gone[i]]) for i in held}


def told(r):
    return r.n_sentences, r.n_removed, r.first_doc_id, [re.sub(r"[\t\n\f\r ]+", " ", x.strip("\t\n\f\r ")) for x in spans.pieces(r.text)]


@pytest.mark.parametrize("least", [0, 10**9])
def test_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 10**9 - least)  # both ways of joining the cuts
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["ab", "Cd", "é", "x.y", "f"]) for _ in range(rng.randint(1, 14))) + rng.choice([".", "!", "?!", "\n"]) for _ in range(40)]
    texts = [rng.choice(["", " "]).join([""] + [rng.choice(pool) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12))]) for _ in range(150)]
    texts = [re.sub(r"(?<=[.!?])(?=[^\s.!?])", " ", t) for t in texts] + [None, "", " \n", "One.", "one.", "ONE.  "]
    rows = list(enumerate(texts))
    want = brute(rows, 3, 20)
    got = spans.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), sentences=3, words=20).collect()
    assert len(got) == len(rows) and {r.doc_id: told(r) for r in got} == want
    assert sum(n > 0 for _, n, _, _ in want.values()) > 20


def test_null_and_equal_ids(spark):
    """Different texts without an id, or with one id, are documents each, in the order of their hashes."""
    rng = random.Random(6)
    pool = [" ".join(rng.choice(["ab", "cd", "é", "f"]) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!"]) for _ in range(7)]
    texts = sorted({" ".join(rng.choice(pool) for _ in range(rng.randint(1, 10))) for _ in range(60)})
    for key in (None, 7):
        df = spark.createDataFrame([(key, t) for t in texts + texts[:3]], "doc_id long, text string")
        order = [r.text for r in df.selectExpr("text", "xxhash64(text) as h").distinct().orderBy("h").collect()]
        want = {order[n]: x for n, x in brute(list(enumerate(order)), 3, 20).items()}
        assert sum(x[1] > 0 for x in want.values()) > 10
        joined = spans.dedup(df, sentences=3, words=20).collect()
        kept = sorted(" ".join(told(r)[3]) for r in joined)
        assert kept == sorted(" ".join(want[t][3]) for t in texts + texts[:3])
        assert sorted(r.n_removed for r in joined) == sorted(want[t][1] for t in texts + texts[:3]) and {r.first_doc_id for r in joined} == {None, key}


def test_every_sentence_of_a_passage_goes(spark):
    """Two sentences of enough words and a short one after them; two sentences that only together have enough words."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long_one, pair = f"{words(25)}. {words(25)}. {words(10)}.", f"{words(14)}. {words(13)}."
    rows = [(k, f"{words(9)}. {p} {words(8)}.") for k, p in enumerate([long_one, long_one, pair, pair])]
    got = {r.doc_id: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in range(4)] == [0, 3, 0, 2] and long_one not in got[1].text and got[3].text.count(".") == 2


def test_passages_and_copies(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = f"{words(9)}. {words(11)}! {words(10)}. {words(25)}."
    rows = [(k, f"{words(12)}. {passage} {words(9)}.") for k in range(50)] + [(90, words(60)), (91, words(60)), (92, words(60))] + [(k, rows_) for k, rows_ in zip((93, 94), [words(45)] * 2, strict=True)]
    got = {r.doc_id: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and got[0].text == rows[0][1]
    assert all(got[k].n_removed == 4 and got[k].first_doc_id == 0 and passage not in got[k].text for k in range(1, 50))
    assert all(got[k].n_removed == 0 and got[k].first_doc_id is None for k in (90, 91, 92, 93)) and got[94].text == ""


def test_odd_rows(odd, odd_rows, none):
    got = spans.dedup(odd).collect()
    assert len(got) == len(odd_rows) and {r.doc_id for r in got} == {r[0] for r in odd_rows}
    by = {r.doc_id: r for r in got}
    assert by[0].text == "" and by[0].n_sentences == 0 and by[2].text == "  \n\t " and by[4].n_removed == 0 and by[5].text == "" and by[5].first_doc_id == 4
    assert spans.dedup(none).collect() == []
    nulls = spans.dedup(odd.selectExpr("cast(null as long) as doc_id", "text")).collect()
    assert len(nulls) == len(odd_rows) and all(r.first_doc_id is None for r in nulls)
