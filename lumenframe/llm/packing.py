"""Best-fit packing of tokenised documents into sequences of a fixed length, by bin completion.

Only lengths matter to a packing, and there are at most `capacity` of them. Spark tokenises, counts the pieces of each length and
deals the pieces to their places; the driver sees that histogram alone (capacity numbers, whatever the input's size) and searches
for patterns: multisets of lengths that share one sequence, each with the number of sequences that use it.

The search is bin completion (branch and bound): the largest piece left must lie somewhere, so a node branches over the undominated
fillings of the space beside it, least waste first; a branch ends where its waste so far shows that it can't beat the incumbent. The
first incumbent is the best-fit decreasing packing. A pattern is used as often as the histogram allows, or once where that turns out
worse, so a plan has at most about capacity * ln(capacity) patterns. The search ends when the incumbent meets the lower bound, or after
`nodes` nodes with `width` fillings each (finding the fewest is NP-hard); with nodes=None and width=None it runs until it is proven.

Defined results: null text is an empty text, and an empty text is one piece that holds the separator alone. Rows that repeat are
packed as often as they come. A null doc_id stays null. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import BROADCAST_ROWS, batches, small, stage

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first

# ---------------------------------------------------------------- tokens

#: Texts of these characters alone get the same ids from both libraries (tests/llm compares them); the rest goes through tokenizers.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ſ]")


@lru_cache(maxsize=4)
def _encoders(tokenizer_json: str | None, ranks_file: str | None, special: bool):
    """The tokenizer, the strings of its special tokens (none, if they count as plain text), and where the same vocabulary is given as
    ranks, an encoder of the same ids that is five times as fast."""
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_json or public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = not special
    strings = tuple(t.content for t in slow.get_added_tokens_decoder().values() if special or not t.special)
    if tokenizer_json and not ranks_file:
        return slow, strings, None
    import tiktoken

    with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return slow, strings, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, tokenizer_json: str | None = None, ranks_file: str | None = None, special: bool = True) -> list[int]:
    """The ids that the tokenizer gives without adding special tokens. special: those whose strings stand in the text are found, as the
    tokenizer does by itself; else their strings are plain text."""
    slow, strings, fast = _encoders(tokenizer_json, ranks_file, special)
    if fast is not None and not _PLAIN.search(text) and not any(s in text for s in strings):
        return fast.encode_ordinary(text)
    return slow.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, capacity: int = 2048, separator: int = 0, tokenizer_json: str | None = None, ranks_file: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and token_ids, if kept) of every piece of every document; part is the partition that made
    it, and place its number among that partition's pieces of its length, from 0."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
    if keep_ids:
        fields.append(("token_ids", pa.list_(pa.int32())))
        schema += ", token_ids array<int>"
    kinds = pa.schema(fields)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)  # at most capacity lengths
        for batch in batches(it, 256):
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = array("I", encode(text or "", tokenizer_json, ranks_file))
                ids.append(separator)
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first + k * capacity]
                    row = [doc, k, start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()), task, seen[len(part)]]
                    seen[len(part)] += 1
                    for to, value in zip(out, [*row, part.tolist()] if keep_ids else row, strict=True):
                        to.append(value)
            yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(out, fields, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


# ---------------------------------------------------------------- the search for patterns


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the fullest sequence that has room; equal sequences are handled together."""
    spaces: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((s for s, groups in spaces.items() if s >= length and groups), default=None)
            if room is None:
                per = capacity // length
                if left >= per:
                    spaces[capacity - per * length].append(({length: per}, left // per))
                    left %= per
                else:
                    spaces[capacity - left * length].append(({length: left}, 1))
                    left = 0
                continue
            held, many = spaces[room].pop()
            per = min(room // length, left)
            use = min(many, left // per)
            if use < many:
                spaces[room].append((held, many - use))
            spaces[room - per * length].append((held | {length: held.get(length, 0) + per}, use))
            left -= use * per
    merged: dict[Pattern, int] = defaultdict(int)
    for groups in spaces.values():
        for held, many in groups:
            merged[tuple(sorted(held.items(), reverse=True))] += many
    return list(merged.items())


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: pieces over half of a sequence can't share one; those beside them need room."""
    total = sum(length * n for length, n in counts.items())
    best = -(-total // capacity)
    for small in sorted({0, *(x for x in counts if x <= capacity // 2)}):
        large = sum(n for x, n in counts.items() if x > capacity - small)
        middle = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - small]
        rest = sum(x * n for x, n in counts.items() if small <= x <= capacity // 2)
        free = sum((capacity - x) * n for x, n in middle)
        best = max(best, large + sum(n for _, n in middle) + max(0, -(-(rest - free) // capacity)))
    return best


def _reachable(left: dict[int, int], room: int) -> int:
    """Bit s is set if pieces that are left can sum up to s <= room."""
    sums, mask = 1, (1 << (room + 1)) - 1
    for length, n in left.items():
        if length <= room and n:
            n, step = min(n, room // length), 1
            while n:
                step = min(step, n)
                sums |= (sums << (length * step)) & mask
                n -= step
                step *= 2
    return sums


def fillings(left: dict[int, int], room: int, most: int | None) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of up to `most` (None: all) undominated fillings of the room, least waste first, long pieces first.

    A filling is dominated if a piece that is left could replace one of its own, or two of them together, and fill the room better."""
    usable = sorted((x for x, n in left.items() if n and x <= room), reverse=True)
    if not usable:
        return [(room, ())]
    sums, out = _reachable(left, room), []
    most = float("inf") if most is None else most
    budget = 50 * most

    def extend(target: int, start: int, taken: tuple[int, ...]) -> None:
        nonlocal budget
        if not target:
            found.append(taken)
            return
        for k in range(start, len(usable)):
            x = usable[k]
            if x <= target and taken.count(x) < left[x]:
                budget -= 1
                if budget < 0 or len(found) >= most - len(out):
                    return
                extend(target - x, k, (*taken, x))

    for waste in range(room + 1):
        if not sums >> (room - waste) & 1:
            continue
        found: list[tuple[int, ...]] = []
        extend(room - waste, 0, ())
        for taken in found:
            free = {x: n - taken.count(x) for x, n in left.items() if n > taken.count(x)}
            single = any(y < x <= y + waste for y in set(taken) for x in free)
            pairs = {a + b for i, a in enumerate(taken) for b in taken[i + 1 :]}
            if waste and (single or any(y <= x <= y + waste for y in pairs for x in free)):
                continue
            out.append((waste, taken))
        if len(out) >= most or budget < 0:
            break
    return out[: int(min(most, len(out)))] or [(room, ())]


def plan(counts: dict[int, int], capacity: int, width: int | None = 6, nodes: int | None = 1000) -> list[tuple[Pattern, int]]:
    """Patterns and their numbers of sequences for a histogram of lengths. width: fillings tried at a node (None: all). nodes: the most
    nodes opened besides two for each length (None: as many as it takes); the best packing found till then stands."""
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    best = best_fit_decreasing(counts, capacity)
    used, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total, opened = sum(x * n for x, n in counts.items()), 0
    most = float("inf") if nodes is None else nodes + len(counts) * 2
    # The stack holds, for each depth, the fillings not tried yet, how often each is used, and the state in which they start.
    stack: list[tuple[dict[int, int], list, list, int, int]] = []

    def open_node(left: dict[int, int], chosen: list, waste: int, bins: int) -> None:
        nonlocal best, used, opened
        if not left:
            if bins < used:
                best, used = list(chosen), bins
            return
        opened += 1
        longest = max(left)
        options = []
        for lost, filling in fillings(left | {longest: left[longest] - 1}, capacity - longest, width):
            need: dict[int, int] = defaultdict(int)
            for x in (longest, *filling):
                need[x] += 1
            options.append((lost, need, min(left[x] // n for x, n in need.items())))
        once = [(lost, need, 1) for lost, need, many in options if many > 1]
        stack.append((left, chosen, (options + once)[::-1], waste, bins))

    open_node(counts, [], 0, 0)
    while stack and used > bound and opened < most:
        left, chosen, options, waste, bins = stack[-1]
        if not options:
            stack.pop()
            continue
        lost, need, many = options.pop()
        wasted = waste + lost * many
        # With this waste, at least so many sequences are needed in the end.
        if -(-(total + wasted) // capacity) >= used:
            continue
        after = {x: n - need.get(x, 0) * many for x, n in left.items()}
        open_node({x: n for x, n in after.items() if n}, [*chosen, (tuple(sorted(need.items(), reverse=True)), many)], wasted, bins + many)
    return best


# ---------------------------------------------------------------- placing the pieces


def pack(docs: DataFrame, capacity: int = 2048, separator: int = 0, tokenizer_json: str | None = None, ranks_file: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there. See the module's docstring.

    Pieces of one length are interchangeable, so each gets a rank among its length: a running count over the input's partitions plus
    its place in its own partition, counted as it is made. So pieces stay where they are: only counts by length and partition are
    shuffled, and joined back by a broadcast while they are few."""
    spark = docs.sparkSession
    pieces = stage(token_pieces(docs, capacity, separator, tokenizer_json, ranks_file, keep_ids), "pieces")
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("parts")).collect()  # at most capacity rows
    counts = {r["length"]: r["n"] for r in histogram}
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = small(before, sum(r["parts"] for r in histogram), BROADCAST_ROWS)
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "part")

    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, many in plan(counts, capacity):
        at = 0
        for length, n in pattern:
            slots[length].append((taken[length], base, n, at))  # from this rank on: n to each sequence from base, the first at `at`
            taken[length] += n * many
            at += n * length
        base += many
    table = spark.sparkContext.broadcast({length: np.array(rows, np.int64) for length, rows in slots.items()})
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id long, offset long"

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                mine, rows = np.flatnonzero(length == x), table.value[int(x)]
                start, first, n, at = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1].T
                sequence[mine], offset[mine] = first + (rank[mine] - start) // n, at + (rank[mine] - start) % n * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.mapInArrow(placed, schema).select(*order, *(["token_ids"] if keep_ids else []))
