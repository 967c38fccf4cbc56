import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import neardup, substrings
from lumenframe.llm.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, n):
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "cell"), [(4, 512), (5, 8)])
def test_near_copies_against_all_pairs(spark, words, cell):
    rng = random.Random(7)
    texts = [t for _ in range(6) for t in family(rng, 15)] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", " "]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words, cell=cell).collect()}
    assert got == groups(rows, words)


def test_odd_rows(odd, odd_rows, none):
    got = neardup.near_duplicates(odd, words=5).collect()
    want = groups([(r[0], r[1]) for r in odd_rows], 5)
    assert len(got) == len(odd_rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id) for r in got)
    left = neardup.one_of_each(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert neardup.near_duplicates(none).count() == 0


def test_an_id_with_several_texts(spark):
    """Rows of one id are one document; the result doesn't depend on the order of rows."""
    rng = random.Random(12)
    a, b, c, d = ((t, t.replace(t.split()[50], "changed")) for t in (family(rng, 1)[0] for _ in range(4)))
    rows = [(5, a[0]), (5, b[0]), (2, a[1]), (9, b[1]), (7, c[0]), (7, c[0]), (8, c[1]), (3, d[0]), (8, d[1]), (5, ""), (8, None), (20, "alone"), (20, "apart")]
    want = {5: 2, 2: 2, 9: 2, 7: 3, 8: 3, 3: 3, 20: 20}
    for _ in range(4):
        rng.shuffle(rows)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=4).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.n_shingles else (r.doc_id, True)), r


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared, own in ((400, 50), (40, 5), (900, 300)):
        pool = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
        a, b = np.sort(pool[: shared + own]), np.sort(np.r_[pool[:shared], pool[shared + own :]])
        found = neardup.estimate(neardup.registers(a, 1600), neardup.registers(b, 1600)[None], len(a), np.array([len(b)]))[0]
        assert found == pytest.approx(shared / (shared + 2 * own), abs=0.06)


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(200, 300)] + [(5, 5), (7, 3)] + [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    at = {x: x for link in links for x in link}
    for _ in range(len(links)):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: c for x, c in at.items() if x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cut(df, length, **options):
    return sorted((r.doc_id, r.n_bytes, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in substrings.dedup(df, length, **options).collect())


@pytest.mark.parametrize("options", [{"gram": 8}, {"gram": 20, "most": 1, "per_bin": 3}, {"gram": 40}])
def test_substrings_against_counting(spark, options):
    rng = random.Random(2)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 90))) for _ in range(6)]
    rows = [(k, rng.choice([None, "", "ab"]) if rng.random() < 0.1 else "".join(rng.choice(parts) if rng.random() < 0.8 else rng.choice("xyz") * rng.randint(1, 60) for _ in range(rng.randint(0, 12)))) for k in range(50)]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string"), 40, **options) == repeats(rows, 40)


def test_substrings_of_odd_rows(odd, odd_rows, none):
    assert cut(odd, 200) == repeats([(r[0], r[1]) for r in odd_rows], 200)
    assert substrings.dedup(none).count() == 0


def test_segments_do_not_show(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    whole = [x.sum() for x in (substrings.runs(data, 60, 20)[3],)]
    monkeypatch.setattr(substrings, "_SEGMENT", 700)
    assert [x.sum() for x in (substrings.runs(data, 60, 20)[3],)] == whole == [5000 - 59]


def test_the_cover_is_a_difference_cover():
    v, cover = substrings.COVER_PERIOD, substrings.COVER
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_suffix_order_equals_plain_sorting():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 3100).astype(np.uint8)
    text[1500:1900] = text[100:500]
    starts = np.arange(0, 3000, substrings.COVER_PERIOD)
    order, same = substrings.suffix_order(text, starts, np.zeros(len(starts), np.int64), 64)
    keys = [text[s : s + 64].tobytes() for s in starts[order]]
    assert keys == sorted(keys) and list(same) == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]


def test_components_run_few_tasks(spark):
    """The driver remembers every task; stars, chains and a hub of hubs, with as many partitions as a cluster has."""
    rng = random.Random(3)
    hub = [(0, k) for k in range(1, 200)] + [(k, 1000 + rng.randrange(500)) for k in range(1, 200)]
    links = {"stars": [(k % 5, 10 + k) for k in range(300)], "hubs": hub, "chain": [(k, k + 1) for k in range(2000, 2030)]}
    context, held = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    tasks = {}
    try:
        for key, value in zip(held, ("20", "false", "-1"), strict=True):
            spark.conf.set(key, value)
        for name, pairs in links.items():
            context.setJobGroup(f"components-{name}", name)
            got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
            at = {n: n for p in pairs for n in p}
            for _ in at:
                before = dict(at)
                for a, b in pairs:
                    at[a] = at[b] = min(at[a], at[b])
                if at == before:
                    break
            assert got == at
            stages = {s for j in context.statusTracker().getJobIdsForGroup(f"components-{name}") for s in context.statusTracker().getJobInfo(j).stageIds}
            tasks[name] = sum(i.numCompletedTasks for s in stages if (i := context.statusTracker().getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in held.items():
            spark.conf.set(key, value)
    assert tasks["stars"] <= 120 and tasks["hubs"] <= 240 and tasks["chain"] <= 720, tasks  # it was 186, 315 and 831
