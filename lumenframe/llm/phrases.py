"""Phrases whose words keep together: every contiguous run of words is counted, held against its parts, and ranked by language.

1. Texts are cut into pieces at punctuation; identical pieces of a language become one with a multiplicity (each task sums up its own
   before the shuffle), so copied lines and passages are taken apart once.
2. Runs are counted by length, 1 to `longest`. A run that occurs `least` times has only parts that do, so a longer run is counted only
   where the two runs in it, one word shorter, passed; which passed is told by a bitmap of fixed size (`filter_bits`) that every worker
   holds. It lets some through that didn't pass, never the other way, and their counts are exact all the same. Each task sums up the
   weighted runs of its pieces, each hash bucket of runs adds up what the tasks found, both in duckdb, which goes to disk scratch beyond
   `memory`. The scratch belongs to one task and goes with it; another attempt starts anew.
3. A candidate asks for the counts of its parts: one request for each part, joined by part (Spark splits a part that many ask for), and
   the least score of its cuts is a grouped minimum. Scores are integers of any size, exact.
4. A candidate goes if a longer one that holds its words has `share` percent of its count: longer ones send their count to the runs
   inside them, whose maximum is joined back.
5. The first `top` of each language: first those of each slice of a language, then those of the slices' firsts, so no task ranks a
   language's candidates.

Defined results: null texts are empty; a null language is `und`, together with that name itself. Repeated rows count as often as they
come. Languages without candidates don't appear; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import batches, mixed, small, stage

_CUT = re.compile(rb"[.,;:!?\n-\r]")
#: A task gives out its sums at so many bytes of distinct pieces.
MOST_BYTES = 48 << 20
_RUNS = pa.schema([("lang", pa.string()), ("run", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
_RUN_TYPE = "lang string, run string, words int, n long"


def pieces_of(text: str | None) -> list[bytes]:
    """The pieces of a text that hold words, in lower case (A-Z), a blank between words."""
    if not text:
        return []
    return [b" ".join(words) for piece in _CUT.split(text.encode().lower()) if (words := piece.split())]


def distinct_pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece, n of every distinct piece of a language."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for name, found in seen.items():
                for part in pa.table({"piece": pa.array(found.keys(), pa.binary()), "n": pa.array(found.values(), pa.int64())}).to_batches(50_000):
                    yield pa.record_batch([pa.array([name] * part.num_rows, pa.string()), part.column(0).cast(pa.string()), part.column(1)], names=["lang", "piece", "n"])
            seen.clear()

        for batch in batches(it):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(name, Counter())
                had = len(own)
                found = pieces_of(t)
                own.update(found)
                held += (len(own) - had) * 100 + (len(t) if len(own) > had else 0)
            if held > MOST_BYTES:
                yield from told()
                held = 0
        yield from told()

    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _in_duckdb(given: Iterator[pa.RecordBatch], schema: pa.Schema, query: str, memory: str) -> Iterator[pa.RecordBatch]:
    """The rows of a query over the stream `given`, out of core."""
    with tempfile.TemporaryDirectory(prefix="runs-") as scratch, duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
        con.register("given", pa.RecordBatchReader.from_batches(schema, given))
        yield from con.sql(query).to_arrow_reader(50_000)


def _gathered(it: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Larger batches, of about `most` bytes: what they share is looked up once."""
    held, size = [], 0
    for batch in it:
        held.append(batch)
        size += batch.get_total_buffer_size() if batch.num_rows else 0
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word in its language."""
    own = lambda x: pd.util.hash_array(x.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return _longer_hash(own(langs), own(words))


def _longer_hash(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run with one more word."""
    return mixed(run * np.uint64(0x9E3779B97F4A7C15) + word)


class _Words:
    """The words of a task's pieces as numbers, by language."""

    def __init__(self) -> None:
        self.keys = self.langs = self.words = pa.array([], pa.string())
        self.hashes = np.empty(0, np.uint64)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of a batch's distinct words; and for each word of its pieces (of lang, piece, n) its place among those, and its
        piece's row."""
        lists = pc.split_pattern(batch.column(1), " ")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words, langs = lists.flatten().dictionary_encode(), batch.column(0).dictionary_encode()
        size = max(1, len(words.dictionary))
        pair = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + words.indices.to_numpy(zero_copy_only=False)
        found, at = np.unique(pair, return_inverse=True)
        lang, word = langs.dictionary.take(pa.array(found // size)), words.dictionary.take(pa.array(found % size))
        key = pc.binary_join_element_wise(pc.utf8_length(lang).cast(pa.string()), lang, word, ":")  # the length tells where the language ends
        number = pc.index_in(key, value_set=self.keys).to_numpy(zero_copy_only=False).astype(np.float64)
        new = np.flatnonzero(np.isnan(number))
        number[new] = len(self.keys) + np.arange(len(new))
        fresh = pa.array(new)
        lang, word = lang.take(fresh), word.take(fresh)
        self.keys, self.langs, self.words = (pa.concat_arrays(x) for x in ((self.keys, key.take(fresh)), (self.langs, lang), (self.words, word)))
        self.hashes = np.r_[self.hashes, _hashes(lang, word)]
        return number.astype(np.int32), at, row


def _runs_of(words: _Words, batch: pa.RecordBatch, size: int, passed: np.ndarray | None) -> pa.RecordBatch:
    """w0, w1, ..., n: each place of a batch at which a run of `size` words may occur often enough; single words summed up."""
    own, at, row = words.of(batch)
    n = batch.column(2).to_numpy(zero_copy_only=False)[row]
    if size == 1:
        sums = np.zeros(len(own), np.int64)
        np.add.at(sums, at, n)
        return pa.record_batch([pa.array(own), pa.array(sums)], names=["w0", "n"])
    number = own[at]
    starts = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    run = words.hashes[number]
    for k in range(1, size - 1):
        run = _longer_hash(run[:-1], words.hashes[number[k:]])
    slot = run & np.uint64(64 * len(passed) - 1)
    fits = (passed[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    starts = starts[fits[starts] & fits[starts + 1]]
    return pa.RecordBatch.from_arrays([*(pa.array(number[starts + k]) for k in range(size)), pa.array(n[starts])], names=[*(f"w{k}" for k in range(size)), "n"])


def _counted(pieces: DataFrame, size: int, passed, least: int, memory: str) -> DataFrame:
    """lang, run, words, n of the runs of `size` words that occur `least` times; with those of one word a row of 0 words for all words of
    a language."""
    columns = [f"w{k}" for k in range(size)]
    schema = pa.schema([*((c, pa.int32()) for c in columns), ("n", pa.int64())])

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = _Words(), None if passed is None else passed.value
        placed = (_runs_of(words, part, size, bits) for part in _gathered(it))
        totals: Counter = Counter()
        for found in _in_duckdb(placed, schema, f"SELECT {', '.join(columns)}, sum(n)::BIGINT AS n FROM given GROUP BY ALL", memory):
            parts = [words.words.take(found.column(k)) for k in range(size)]  # all batches have been read
            lang = words.langs.take(found.column(0))
            run = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
            yield pa.record_batch([lang, run, pa.array([size] * len(run), pa.int32()), found.column(size)], schema=_RUNS)
            if size == 1:
                by_lang = pa.table([lang, found.column(size)], names=["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
                totals.update(dict(zip(by_lang["lang"].to_pylist(), by_lang["n_sum"].to_pylist(), strict=True)))
        yield pa.record_batch([pa.array(totals.keys(), pa.string()), pa.array([""] * len(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array(totals.values(), pa.int64())], schema=_RUNS)

    summed = f"SELECT lang, run, any_value(words)::INTEGER AS words, sum(n)::BIGINT AS n FROM given GROUP BY lang, run HAVING sum(n) >= {int(least)} OR run = ''"
    buckets = pieces.mapInArrow(own, _RUN_TYPE).repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "run")
    return buckets.mapInArrow(lambda it: _in_duckdb(it, _RUNS, summed, memory), _RUN_TYPE)


def _bitmap(runs: DataFrame, filter_bits: int) -> np.ndarray:
    """2**filter_bits bits, of which those that the hashes of runs choose are set."""

    def slots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = pc.split_pattern(batch.column(1), " ")
            size, cuts, each = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), size)
            hashes, first = _hashes(batch.column(0).take(pa.array(row)), each), cuts[:-1] - cuts[0]
            found = hashes[first]
            for k in range(1, int(size.max(initial=0))):
                more = np.flatnonzero(size > k)
                found[more] = _longer_hash(found[more], hashes[first[more] + k])
            yield pa.record_batch([pa.array((found & np.uint64((1 << filter_bits) - 1)).astype(np.int64))], names=["slot"])

    bit = F.expr("shiftleft(1L, cast(slot % 64 AS INT))")
    words = runs.select("lang", "run").mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2**filter_bits / 64 rows at most
    found = np.zeros(1 << (filter_bits - 6), np.uint64)
    found[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return found


def run_counts(pieces: DataFrame, longest: int, least: int, memory: str, filter_bits: int = 26) -> DataFrame:
    """lang, run, words, n of the runs of up to `longest` words that occur `least` times, and a row of 0 words for all words of a language."""
    counts, passed = [], None
    for size in range(1, longest + 1):
        counts.append(stage(_counted(pieces, size, passed, least, memory), f"runs-{size}"))
        if size < longest:
            passed = pieces.sparkSession.sparkContext.broadcast(_bitmap(counts[-1].filter(F.col("words") == size), filter_bits))
    return reduce(DataFrame.unionByName, counts)


def _scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        a, left, rest = (b.column(c).to_pylist() for c in ("a", "l", "r"))
        score = [1_000_000 * x * x // (y * z) for x, y, z in zip(a, left, rest, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.int64())], names=[*b.schema.names, "score"])


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000, slices: int = 64, memory: str = "256MB") -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (its parts' at the cut of the least score), n (all words of the language), score."""
    counts = run_counts(stage(distinct_pieces(docs), "pieces"), longest, least, memory)
    candidates = counts.filter(f"words >= 2 and n >= {int(least)}").select("lang", F.col("run").alias("phrase"), F.col("n").alias("a"), F.split("run", " ").alias("w"))
    cut = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda start, size: F.concat_ws(" ", F.slice("w", start, size))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("part"))))
    requests = cut.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    parts = counts.filter("words >= 1").select("lang", F.col("run").alias("part"), F.col("n").alias("f"))
    answered = requests.join(parts, ["lang", "part"])
    cuts = answered.groupBy("lang", "phrase", "k").agg(F.first("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = cuts.mapInArrow(_scored, "lang string, phrase string, k int, a long, l long, r long, score long")
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    longer = candidates.filter(F.size("w") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.concat_ws(" ", F.slice("w", at, size)))))
    inside = longer.select("lang", F.col("a").alias("held"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = stage(worst.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("held").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)"), F.lit(True))).drop("held"), "collocations")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    totals = small(stage(counts.filter("words = 0").select("lang", "n"), "totals"))
    if top is not None:
        slice_of = F.pmod(F.xxhash64("phrase"), F.lit(slices))
        kept = kept.withColumn("slice", slice_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top).drop("slice", "rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
