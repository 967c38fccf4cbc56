import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import packing


def bins(pieces) -> int:
    return sum(n for _, n in pieces)


def fewest(items: list[int], capacity: int) -> int:
    best = [len(items)]

    def put(k: int, spaces: list[int]) -> None:
        if len(spaces) >= best[0]:
            return
        if k == len(items):
            best[0] = len(spaces)
            return
        for at in range(len(spaces)):
            if spaces[at] >= items[k]:
                spaces[at] -= items[k]
                put(k + 1, spaces)
                spaces[at] += items[k]
        put(k + 1, [*spaces, capacity - items[k]])

    put(0, [])
    return best[0]


def test_small_plans_are_optimal():
    rng = random.Random(3)
    for _ in range(120):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randint(0, 10))), reverse=True)
        got = packing.plan(Counter(items), capacity, width=None, nodes=None)
        used = Counter()
        for pattern, many in got:
            assert sum(x * n for x, n in pattern) <= capacity
            for x, n in pattern:
                used[x] += n * many
        assert used == Counter(items) and bins(got) == fewest(items, capacity)


def test_a_search_that_must_leave_best_fit():
    """Best-fit decreasing takes one sequence too many here; both the bounded and the proven search find the fewest."""
    counts = {6: 2, 5: 2, 4: 4, 3: 2, 2: 2}  # 48 in all
    assert bins(packing.best_fit_decreasing({5: 1, 4: 1, 3: 2, 2: 2}, 10)) >= packing.lower_bound({5: 1, 4: 1, 3: 2, 2: 2}, 10)
    rng, better = random.Random(11), 0
    for _ in range(200):
        items = Counter(rng.randint(12, 45) for _ in range(rng.randint(6, 10)))
        first, found, proven = bins(packing.best_fit_decreasing(items, 100)), bins(packing.plan(items, 100)), bins(packing.plan(items, 100, None, None))
        assert proven == fewest(sorted(items.elements(), reverse=True), 100) <= found <= first
        better += proven < first
    assert better and bins(packing.plan(counts, 12)) == 4


def test_large_plans_come_close_to_the_bound():
    rng = random.Random(4)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(5000))
    got = packing.plan({x: n * 1000 for x, n in counts.items()}, 2048)
    assert bins(got) <= 1.002 * packing.lower_bound({x: n * 1000 for x, n in counts.items()}, 2048)


def test_both_encoders_agree_where_the_faster_is_used():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bare = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bare.encode_special_tokens = True
    plain = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)]]
    rng = random.Random(6)
    texts = ["".join(rng.choice(plain if k % 2 else plain[:99] + [" ", "\n", "'s"] * 20) for _ in range(200)) for k in range(300)]
    texts += ["\n".join(plain), " ".join(plain), "".join(plain), "a  b \n\n c ", "<|endoftext|> it's", ""]
    assert all(not packing._PLAIN.search(t) for t in texts)
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|endoftext|", "é<|endoftext|>中"]
    assert all(packing.encode(t) == slow.encode(t, add_special_tokens=False).ids for t in texts)
    assert all(packing.encode(t, special=False) == bare.encode(t, add_special_tokens=False).ids for t in texts)
    assert packing.encode("a<|endoftext|>b") == [64, 50256, 65]
    other = "中文 \u00a0\u2009 x \u0663"
    assert packing.encode(other) == slow.encode(other, add_special_tokens=False).ids


def test_pieces_and_places(spark, odd, odd_rows):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd_rows = [*odd_rows, (900, "one<|endoftext|>two <|endoftext|>", "en", "s", 1, 1, "x")]
    odd = odd.unionByName(spark.createDataFrame(odd_rows[-1:], odd.schema))
    got = packing.pack(odd, keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, text, *_ in set(odd_rows):
        copies = sum(1 for x in odd_rows if x[0] == doc)
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        rows = sorted(by_doc[doc], key=lambda r: r.piece)
        assert sum(r.length for r in rows) == copies * len(ids)
        for r in rows:
            assert r.token_ids == ids[r.start : r.start + r.length] and (r.length == 2048 or r.piece == 0)


@pytest.mark.parametrize("most", [0, 400_000])
def test_places_are_whole_by_join_and_by_broadcast(spark, monkeypatch, most):
    """Many pieces of few lengths over many partitions: each place is used once, without gaps, whichever way the counts are joined."""
    monkeypatch.setattr(packing, "BROADCAST_ROWS", most, raising=False)
    docs = spark.range(3000, numPartitions=7).selectExpr("id AS doc_id", "repeat('word ', cast(id % 5 * 150 AS int)) AS text")
    got = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in got) == dict.fromkeys(range(3000), 1)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == bins(packing.plan(Counter(r.length for r in got), 2048))


def test_pieces_stay_in_their_partitions(spark):
    """The pieces themselves are not shuffled: a large number of shuffle partitions doesn't cut the result into as many tasks and files."""
    held = {"spark.sql.shuffle.partitions": "53", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = packing.pack(spark.range(2000, numPartitions=5).selectExpr("id AS doc_id", "repeat('a b ', cast(id % 400 AS int)) AS text"))
        assert got.count() == 2000 and got.rdd.getNumPartitions() <= 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_table(none):
    assert packing.pack(none).collect() == []


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError, match="lengths"):
        packing.plan({11: 1}, 10)
