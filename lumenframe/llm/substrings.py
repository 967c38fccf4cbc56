"""Exact substring dedup on bytes: removes every byte covered by a string of `length` bytes that also starts anywhere else.

Suffixes are sorted one bucket at a time. A suffix is filed under the anchor of its first `length` bytes: the k-gram with the least hash
among them and its offset, which equal strings share; so only suffixes of one bucket can agree that far, and a suffix array of each
bucket, sorted by its first `length` bytes, finds them as neighbours.

1. Runs. Consecutive suffixes with one anchor are a run; it has a hash of its anchor and one of all bytes that its strings cover (its
   block). That is about 1.6 rows for 100 bytes of text, and texts don't leave the scan.
2. Anchors that occur once are done: their strings are unique. Where a whole block recurs, all of its strings do. This settles copies of
   any number without comparing them.
3. Blocks that differ but share an anchor (one block of each kind, whatever its count) are fetched and dealt to bins of whole buckets.
   A bin's suffixes are sorted by difference cover: cover positions are ranked first by prefix doubling; then all suffixes are sorted by
   their first v bytes, and ties by the ranks at their next cover positions. Blocks are laid out with their anchors on multiples of v,
   so all suffixes of a bucket have one residue and one rank decides a tie. Neighbours that agree in `length` bytes, which is checked on
   the bytes, are repeated. Memory is bounded by the bin.
4. An anchor with more than `most` different blocks is too large for a bin: its strings are hashed each and counted, which Spark
   aggregates before the shuffle and splits, and the repeated ones joined back.
5. The ranges of each document are merged and cut.

Defined results: null text has no bytes and nothing removed; texts below `length` bytes are kept whole. Rows that repeat are documents
like others, so their strings repeat; a null doc_id is kept. An empty table gives no rows. Only doc_id and the text are read. What is
left of a text may end or begin within a character; it is bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import ROW_KEYS, batches, keyed, mixed, prefix_sums, small, stage, substring_hash

_SEGMENT = 1 << 22  # strings of a text that are handled at once
_POSITION = np.uint64((1 << 23) - 1)
#: A difference cover of the residues modulo 31: every residue is the difference of two of these.
COVER_PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values: suffix and prefix minima of blocks of that width meet in every window."""
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor hash, block hash, start, number of strings and the anchor's offset from the start, of each run of a text's bytes."""
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(0, len(data) - length + 1), _SEGMENT):
        part = data[base : base + _SEGMENT + length - 1]
        sums, at = prefix_sums(part), np.arange(len(part) - gram + 1)
        grams = substring_hash(sums, at, at + gram)
        anchor = (_sliding_min((grams & ~_POSITION) | at.astype(np.uint64), length - gram + 1) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, len(anchor)])
        offset = anchor[first] - first
        block = substring_hash(sums, first, first + count - 1 + length) ^ mixed(offset.astype(np.uint64))
        out.append((grams[anchor[first]], block, first + base, count, offset))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by bucket and their first `length` bytes; whether each agrees with the one before it in bucket and bytes.

    All suffixes of a bucket must have one residue modulo COVER_PERIOD, and `length` bytes must follow each start."""
    v, n = COVER_PERIOD, len(text)
    padded = np.concatenate([text, np.zeros(length + 2 * v, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + length + v, np.uint64)  # eight bytes from each position on, first byte highest
    for k in range(8):
        word |= padded[k : k + len(word)] << np.uint64(56 - 8 * k)
    spots = (0, 8, 16, v - 8)  # the words that make up the first v bytes

    in_cover = np.isin(np.arange(v), COVER)
    sample = np.flatnonzero(in_cover[np.arange(n) % v])
    index = np.full(n + 16 * v, -1, np.int64)
    index[sample] = np.arange(len(sample))
    order = np.lexsort([word[sample + s] for s in spots[::-1]])
    new = np.zeros(len(sample), bool)
    for s in spots:
        w = word[sample[order] + s]
        new[1:] |= w[1:] != w[:-1]
    rank = np.empty(len(sample), np.int64)
    rank[order] = np.cumsum(new)
    depth = v
    while depth < length:
        ahead = index[sample + depth]
        pair = (rank + 1) * (len(sample) + 2) + np.where(ahead >= 0, rank[ahead] + 1, 0)
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        depth *= 2

    shift = np.array([next(d for d in range(v) if in_cover[(r + d) % v]) for r in range(v)])
    tie = rank[index[starts + shift[starts % v]]]
    order = np.lexsort([tie, *(word[starts + s] for s in spots[::-1]), bucket])
    same, a, b = bucket[order[1:]] == bucket[order[:-1]], starts[order[:-1]], starts[order[1:]]
    for s in (*range(0, length - 8, 8), length - 8):
        same &= word[a + s] == word[b + s]
    return order, np.r_[False, same]


def repeated(pieces: list[bytes], anchor: np.ndarray, offset: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Whether each string of each block (one after another) also stands in another block with the same anchor. A block is given once."""
    where, at = np.empty(len(pieces), np.int64), 0
    for k, piece in enumerate(pieces):
        where[k] = at = at + (-(at + int(offset[k]))) % COVER_PERIOD  # the anchor falls on a multiple of the period
        at += len(piece)
    text = np.zeros(at, np.uint8)
    for k, piece in enumerate(pieces):
        text[where[k] : where[k] + len(piece)] = np.frombuffer(piece, np.uint8)
    own = np.repeat(np.arange(len(pieces)), count)
    step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    kind = np.unique(anchor, return_inverse=True)[1].reshape(-1)
    bucket = kind[own] * (2 * length) + step - offset[own] + length
    order, same = suffix_order(text, where[own] + step, bucket, length)
    found = np.zeros(len(own), bool)
    found[order[same]] = True
    found[order[np.flatnonzero(same) - 1]] = True
    return found


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeated_ranges(docs: DataFrame, length: int = 200, gram: int = 48, most: int = 2048, per_bin: int = 2048, text: str = "text") -> DataFrame:
    """id_key, text_key, begin, end (bytes, end exclusive; they may overlap) of what recurs in each document. most: the different
    blocks of one anchor that a bin may hold; per_bin: the blocks that a bin holds on average."""
    if not 8 <= gram <= length or length < COVER_PERIOD + 8:
        raise ValueError("gram must lie in 8..length, and length be 39 or more")
    rows = keyed(docs, text)
    longs = pa.schema([(c, pa.int64()) for c in (*ROW_KEYS, "anchor", "block", "begin")] + [("n", pa.int32()), ("offset", pa.int32())])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = [runs(np.frombuffer((t or "").encode(), np.uint8), length, gram) for t in batch.column(2).to_pylist()]
            each = [len(x[0]) for x in found]
            anchor, block, begin, n, offset = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, each)), pa.array(np.repeat(texts, each)), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array(begin), pa.array(n.astype(np.int32)), pa.array(offset.astype(np.int32))], schema=longs
            )

    found = stage(rows.select(*ROW_KEYS, "text").mapInArrow(scan, "id_key long, text_key long, anchor long, block long, begin long, n int, offset int"), "runs")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("times"), (F.min("block") != F.max("block")).alias("differ")).filter("times > 1")
    # Grouped tables are staged before the join, so that Spark can split a hot anchor's runs.
    shared = stage(found.join(stage(anchors.select("anchor", "differ"), "anchors"), "anchor"), "shared-runs")
    end = (F.col("begin") + F.col("n") - 1 + length).alias("end")
    alike = shared.filter("not differ").select(*ROW_KEYS, "begin", end)

    mixed_runs = shared.filter("differ").drop("differ")
    first = F.min(F.struct(*ROW_KEYS, "begin")).alias("at")
    blocks = stage(mixed_runs.groupBy("anchor", "block").agg(F.count("*").alias("times"), first, F.first("n").alias("n"), F.first("offset").alias("offset")), "blocks")
    again = mixed_runs.join(blocks.filter("times > 1").select("anchor", "block"), ["anchor", "block"]).select(*ROW_KEYS, "begin", end)

    buckets = stage(blocks.groupBy("anchor").agg(F.count("*").alias("different")), "buckets")
    total = blocks.count()
    bins = max(1, -(-total // per_bin))
    sized = blocks.join(buckets, "anchor").select("at.*", "anchor", "n", "offset", (F.col("times") > 1).alias("settled"), (F.col("different") > most).alias("large"))
    wanted = stage(sized.groupBy(*ROW_KEYS).agg(F.collect_list(F.struct("anchor", "begin", "n", "offset", "settled", "large")).alias("wanted")), "wanted")
    holders = rows.join(small(wanted.select(*ROW_KEYS)), ROW_KEYS, "left_semi").join(wanted, ROW_KEYS)

    fields = pa.schema([*((c, pa.int64()) for c in (*ROW_KEYS, "anchor", "begin")), ("n", pa.int32()), ("offset", pa.int32()), ("settled", pa.bool_()), ("large", pa.bool_()), ("piece", pa.binary())])

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 64):
            rows = []
            for id_key, text_key, t, wants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = t.encode()
                for w in wants:
                    rows.append({"id_key": id_key, "text_key": text_key, **w, "piece": data[w["begin"] : w["begin"] + w["n"] - 1 + length]})
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    fetched = stage(holders.select(*ROW_KEYS, "text", "wanted").mapInArrow(fetch, "id_key long, text_key long, anchor long, begin long, n int, offset int, settled boolean, large boolean, piece binary"), "pieces")
    schema = "id_key long, text_key long, begin long, end long"
    spans = pa.schema([(c, pa.int64()) for c in ("id_key", "text_key", "begin", "end")])

    def sort_bin(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        whole = held.select(["id_key", "text_key", "begin", "anchor", "n", "offset"])
        ids, texts, begin, anchor, n, offset = (c.to_numpy().astype(np.int64) for c in whole.columns)
        _, once = np.unique(np.stack([ids, texts, begin], 1), axis=0, return_index=True)  # a row may be there twice
        once = np.sort(once)
        pieces, settled = held["piece"].take(pa.array(once)).to_pylist(), held["settled"].to_numpy()[once]
        ids, texts, begin, anchor, n, offset = (x[once] for x in (ids, texts, begin, anchor, n, offset))
        flags = repeated(pieces, anchor, offset, n, length)
        own = np.repeat(np.arange(len(n)), n)
        base = np.cumsum(n) - n
        flags &= ~settled[own]
        # A gap after each block keeps stretches of two blocks apart.
        spread = np.zeros(len(flags) + len(n), bool)
        spread[np.arange(len(flags)) + own] = flags
        left, right = _stretches(spread)
        block = np.searchsorted(base + np.arange(len(n)), left, "right") - 1
        shift = begin[block] - base[block] - block
        return pa.table([pa.array(x) for x in (ids[block], texts[block], left + shift, right + shift + length)], schema=spans)

    binned = fetched.filter("not large").withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(bins)))
    sorted_out = binned.groupBy("bin").applyInArrow(sort_bin, schema)

    # Anchors too large for a bin: each string's hash, counted.
    strings = pa.schema([*((c, pa.int64()) for c in (*ROW_KEYS, "anchor", "begin")), ("settled", pa.bool_()), ("string", pa.int64())])

    def spell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            for r in batch.to_pylist():
                sums, at = prefix_sums(np.frombuffer(r["piece"], np.uint8)), np.arange(r["n"])
                hashes = substring_hash(sums, at, at + length).view(np.int64)
                same = [pa.array(np.full(len(at), r[c], np.int64)) for c in (*ROW_KEYS, "anchor")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at + r["begin"]), pa.array(np.full(len(at), r["settled"])), pa.array(hashes)], schema=strings)

    large = fetched.filter("large").dropDuplicates([*ROW_KEYS, "begin"])
    spelt = large.mapInArrow(spell, "id_key long, text_key long, anchor long, begin long, settled boolean, string long")
    counted = spelt.groupBy("anchor", "string").agg(F.count("*").alias("times")).filter("times > 1").select("anchor", "string")
    spelt_out = spelt.filter("not settled").join(counted, ["anchor", "string"]).select(*ROW_KEYS, "begin", (F.col("begin") + length).alias("end"))
    return alike.unionByName(again).unionByName(sorted_out).unionByName(spelt_out)


def dedup(docs: DataFrame, length: int = 200, text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, spans (begin, end of the maximal removed runs) and kept (the remaining bytes) of every row of docs."""
    rows = keyed(docs, text)
    cuts = stage(repeated_ranges(docs, length, text=text, **options).groupBy(*ROW_KEYS).agg(F.collect_set(F.struct("begin", "end")).alias("cuts")), "cuts")
    named = small(cuts.select(*ROW_KEYS))
    kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", kinds), ("kept", pa.binary())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            sizes, spans, kept = [], [], []
            for t, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, merged = t.encode(), []
                for x in sorted((g["begin"], g["end"]) for g in given):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                at, parts = 0, []
                for begin, end in merged:
                    parts.append(data[at:begin])
                    at = end
                sizes.append(len(data))
                spans.append([{"begin": b, "end": e} for b, e in merged])
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())], schema=fields)

    touched = rows.join(named, ROW_KEYS, "left_semi").join(cuts, ROW_KEYS).select("doc_id", "text", "cuts")
    schema = "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    whole = rows.join(named, ROW_KEYS, "left_anti").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.array().cast("array<struct<begin: bigint, end: bigint>>").alias("spans"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("kept"))
    return touched.mapInArrow(cut, schema).unionByName(whole)
