"""Near-duplicate documents by HyperMinHash: sketch, band, estimate, then confirm on the full shingle sets.

A document's set is its distinct word shingles. Each shingle's hash picks a register and leaves a value; a register keeps the least
value as its count of leading zeros and the mantissa bits after them (16 bits in all). A register that no shingle picks copies that of
another by a fixed sequence of probes, so that two sets agree in a register with the probability of their similarity, however small
they are. Bands of registers are hashed and joined: at the threshold of 0.8, with 64 bands of 8, a link has no common band with
probability 8e-6, while a pair of similarity 0.5 meets with probability 0.22, one of 0.3 with 0.004.

1. Documents with the same set are one class. In each bucket of a band, every class is held against the bucket's least class, on the
   full sets: one text for each distinct pair of class and least class, dealt in cells of bounded size. Copies of one text, near or
   exact, are joined here, in linear work.
2. Components of these links. A bucket whose classes are all in one component is done; only buckets that hold several can hide a link.
   Classes that meet in those, directly or through others, are a family. Families are compared in cells: one for a family of up to
   `cell` classes, else one for each pair of its chunks. In a cell, pairs that are connected already are passed over; others are
   estimated from the registers (corrected for chance collisions), and if they may reach the threshold, confirmed on the full sets. A
   pair at the threshold is taken for less by the estimate with probability 3e-7 (five deviations), and confirmed otherwise.
3. Components of all links. Nothing is dropped, whatever a bucket's size.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with nothing. A null doc_id has a null
component and is kept. Rows of one id are one document, which is linked with all that any of its texts is linked with; a row of it without
words stays by itself, but one_of_each keeps or drops all rows of an id together. An empty table gives no rows. Only doc_id and the
text are read; other columns, whatever their names, pass through one_of_each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import batches, mixed, prefix_sums, small, stage, substring_hash
from lumenframe.llm.components import components

_VALUE_BITS, _MANTISSA = 40, 10
_PROBES, _STEP = 256, 16


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Words lie between ASCII white space; A-Z are lower-cased."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    sums = prefix_sums(np.frombuffer(b" ".join(parts), np.uint8))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(parts) <= words:
        return substring_hash(sums, starts[:1], ends[-1:])
    return np.unique(substring_hash(sums, starts[: len(parts) - words + 1], ends[words - 1 :]))


@lru_cache(maxsize=4)
def _probes(count: int) -> np.ndarray:
    """For each register the registers that it looks at, one after another, while it is empty."""
    number = np.arange(count * _PROBES, dtype=np.uint64).reshape(count, _PROBES)
    return (mixed(number) % np.uint64(count)).astype(np.int32)


def registers(shingles: np.ndarray, count: int) -> np.ndarray:
    """The sketch of a set that isn't empty: `count` values of 16 bits, leading zeros above mantissa."""
    spread = mixed(shingles + np.uint64(0x2545F4914F6CDD1D))
    own = (((spread >> np.uint64(_VALUE_BITS)) * np.uint64(count)) >> np.uint64(64 - _VALUE_BITS)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    own, value = own[order], (spread & np.uint64((1 << _VALUE_BITS) - 1))[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    least = np.minimum.reduceat(value, first)
    zeros = (_VALUE_BITS - np.frexp(least.astype(np.float64))[1]).astype(np.uint64)
    tail = (least << (zeros + np.uint64(1))) & np.uint64((1 << _VALUE_BITS) - 1)
    out, full = np.zeros(count, np.uint16), np.zeros(count, bool)
    out[own[first]] = ((zeros << np.uint64(_MANTISSA)) | (tail >> np.uint64(_VALUE_BITS - _MANTISSA))).astype(np.uint16)
    full[own[first]] = True
    empty, held = np.flatnonzero(~full), own[first]
    for low in range(0, _PROBES, _STEP):
        if not len(empty):
            return out
        at = _probes(count)[empty, low : low + _STEP]
        fits = full[at]
        first = fits.argmax(axis=1)
        hit = fits[np.arange(len(empty)), first]
        out[empty[hit]] = out[at[hit, first[hit]]]
        empty = empty[~hit]
    if len(empty):  # the next full one, round the ring
        out[empty] = out[held[np.searchsorted(held, empty) % len(held)]]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash of each band's registers and its number."""
    rows = sketch.reshape(bands, -1).astype(np.uint64)
    key = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for column in rows.T:
        key = mixed(key ^ (column + np.uint64(1)))
    return key.view(np.int64)


def estimate(sketch: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers. Two independent minima of n1 and n2 values agree in zeros and mantissa by chance with a
    probability of about 0.7213 * 2**-mantissa * n1 * n2 / (n1 + n2)**2, which is taken off."""
    equal = (others == sketch).mean(axis=1)
    chance = 0.7213 * 2.0**-_MANTISSA * size * sizes / (size + sizes.astype(np.float64)) ** 2
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def connecting_links(ids: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, count: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """True links between left and right (masks) that connect what was not connected, until none is missing. known: numbers of the
    components that are known, equal for what is connected already."""
    n = len(ids)
    sketches = np.stack([registers(s, count) for s in sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    group, found = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1].reshape(-1), []
    floor = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / count) - 1e-9
    whole = bool((left & right).all())
    for a in np.flatnonzero(left):
        fits = right & (group != group[a]) & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a]))
        if whole:
            fits[: a + 1] = False
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        about = estimate(sketches[a], sketches[near], int(sizes[a]), sizes[near])
        for b in near[np.argsort(-about)][: int((about >= floor).sum())]:
            if group[a] != group[b] and linked(sets[a], sets[b], percent):
                found.append((ids[a], ids[b]))
                group[group == group[b]] = group[a]
    return found


def sketch(docs: DataFrame, words: int, bands: int, rows: int, text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (16 bytes, null for an empty set) and bands of every row."""
    fields = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            sizes, keys, banded = [], [], []
            for t in batch.column(2).to_pylist():
                found = shingle_set(t, words)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                banded.append(band_keys(registers(found, bands * rows), bands) if len(found) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], schema=fields)

    return _texts(docs, text).withColumnRenamed("rep", "doc_id").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: A class goes by the least of its rows: its id, and its text's hash, since an id may come with several texts.
_CLASS = ["rep", "text_key"]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """rep (the id), text_key, text of every row."""
    given = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    return given.select("rep", F.xxhash64("text").alias("text_key"), "text")


def _met(banded: DataFrame) -> DataFrame:
    """rep, text_key, hub, hub_key: the least class of each bucket that the class is in, where that is another."""
    hubs = banded.groupBy("band").agg(F.min(F.struct(*_CLASS)).alias("h"), F.count("*").alias("n")).filter("n > 1").select("band", F.col("h.rep").alias("hub"), F.col("h.text_key").alias("hub_key"))
    return banded.join(hubs, "band").filter("rep <> hub or text_key <> hub_key").select(*_CLASS, "hub", "hub_key").distinct()


def star_links(docs: DataFrame, met: DataFrame, words: int, percent: int, cell: int, text: str) -> DataFrame:
    """a, b: the ids of the pairs of met (staged) that are true links. A hub's classes are dealt to cells; its own text goes to each."""
    hub = ["hub", "hub_key"]
    cells = met.groupBy(*hub).agg(F.ceil(F.count("*") / cell).cast("int").alias("chunks"))
    pairs = met.join(cells, hub).select(*_CLASS, *hub, F.pmod(F.xxhash64(*_CLASS), F.col("chunks")).cast("int").alias("chunk"))
    heads = cells.select(F.col("hub").alias("rep"), F.col("hub_key").alias("text_key"), *hub, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    wanted = stage(pairs.unionByName(heads), "pairs")
    given = _texts(docs, text).join(small(wanted), _CLASS)

    def compare(key: tuple, held: pa.Table) -> pa.Table:
        head, texts = (key[0].as_py(), key[1].as_py()), dict(zip(zip(held["rep"].to_pylist(), held["text_key"].to_pylist(), strict=True), held["text"].to_pylist(), strict=True))  # once, if rows repeat
        own = shingle_set(texts.pop(head), words)
        found = [rep for (rep, _), t in texts.items() if linked(shingle_set(t, words), own, percent)]
        return pa.table([pa.array(found, pa.int64()), pa.array([head[0]] * len(found), pa.int64())], schema=_LINKS)

    return given.groupBy(*hub, "chunk").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, cell: int = 512, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) and kept (doc_id = component_id) of every row of docs."""
    sketched = stage(sketch(docs, words, bands, rows, text), "sketches")
    known_rows = sketched.filter("set_key is not null and doc_id is not null")
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "text_key"))
    classes = stage(known_rows.groupBy("set_key").agg(least.alias("c"), F.first("bands").alias("bands")).select("set_key", "c.*", "bands"), "classes")
    several = known_rows.groupBy("doc_id").agg((F.min("set_key") < F.max("set_key")).alias("several")).filter("several").select("doc_id")
    of_one_id = stage(known_rows.select("doc_id", "set_key").join(several, "doc_id").join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links-of-one-id")
    every = classes.select(*_CLASS, F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    banded = stage(every.join(shared, "band"), "bands")
    stars = stage(star_links(docs, stage(_met(banded), "met"), words, percent, cell, text).unionByName(of_one_id), "star-links")
    joined = stage(components(stars), "star-components")

    named_bands = banded.join(small(joined), F.col("rep") == F.col("node"), "left").select(*_CLASS, "band", F.coalesce("component", "rep").alias("known"))
    open_bands = named_bands.groupBy("band").agg(F.min("known").alias("low"), F.max("known").alias("high")).filter("low < high").select("band")
    left = stage(named_bands.join(open_bands, "band"), "open-bands")
    of_family = stage(components(_met(left.select(*_CLASS, "band")).select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("family")), "families")
    sizes = of_family.groupBy("family").agg(F.ceil(F.count("*") / cell).cast("int").alias("chunks"))
    labels = left.select(*_CLASS, "known").distinct()
    chunked = stage(of_family.join(sizes, "family").join(labels, "rep").withColumn("chunk", F.pmod(F.xxhash64(*_CLASS), F.col("chunks")).cast("int")), "chunks")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = _texts(docs, text).join(small(chunked), _CLASS).withColumn("other", other).select("family", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", *_CLASS, "known", "text")
    count = bands * rows

    def compare(key: tuple, held: pa.Table) -> pa.Table:
        own = dict(zip(zip(held["rep"].to_pylist(), held["text_key"].to_pylist(), strict=True), zip(held["chunk"].to_pylist(), held["known"].to_pylist(), held["text"].to_pylist(), strict=True), strict=True))  # once, if rows repeat
        ids, chunk, known = [rep for rep, _ in own], np.array([c for c, _, _ in own.values()]), np.array([k for _, k, _ in own.values()])
        sets = [shingle_set(t, words) for _, _, t in own.values()]
        found = connecting_links(ids, sets, chunk == key[1].as_py(), chunk == key[2].as_py(), percent, count, known) if len(ids) > 1 else []
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_LINKS)

    links = cells.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")
    # A star's component stands for its links.
    settled = joined.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(settled.unionByName(links))
    named = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return sketched.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with all columns, without the documents that aren't the first of their component."""
    gone = stage(near_duplicates(docs, words, percent).filter("not kept").select("doc_id").distinct(), "copies")
    return docs.join(small(gone).alias("copies"), docs["doc_id"].cast("long") == F.col("copies.doc_id"), "left_anti")
