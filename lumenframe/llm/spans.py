"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed, runs are joined globally, and the
sentences covered by a run that isn't the first of its kind are removed.

A sentence ends with dots, question or exclamation marks before white space, or with a line. Two sentences are the same if their words
(between ASCII white space) are, A-Z lower-cased. Every run of `sentences` sentences is taken, and every shorter one that holds `words`
words, so each sentence of a passage of whole sentences that holds either lies in a run within the passage; a text with less of both is
one run. The order of runs is by doc_id (then by the text's hash, where an id has several texts), then by place.

A document's own repeats are found where it is read. Of the others, each document sends one row for a run: 128 bits of hash and its
keys. The first document of each run is a grouped minimum, combined before the shuffle; the runs that two documents share are joined
back, where Spark splits those that many share. Only a document's own places are ever gathered.

Defined results: null text is an empty text, without sentences; a text of white space is left as it is. Rows that repeat an id and text
count as one document, and each gets its result; different texts of one id, or without one, are documents each. Null ids come first.
White space after a removed sentence goes with it. Only doc_id and the text are read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import BROADCAST_ROWS, ROW_KEYS, batches, keyed, stage

_SPACE = "\t\n\f\r "
#: Pieces that make up the text: a sentence and the white space round it.
SENTENCE = r"[\t\n\f\r ]*(?:[^.!?\n]+|[.!?]+[^\t\n\f\r .!?])+[.!?]*[\t\n\f\r ]*|[.!?\t\n\f\r ]+"
_SENTENCE = re.compile(SENTENCE)
_WORDS = re.compile(f"[^{_SPACE}]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str | None) -> list[str]:
    """The sentences of a text, with the white space round them."""
    return _SENTENCE.findall(text) if text and text.strip(_SPACE) else []


def runs(parts: list[str], sentences: int, words: int) -> list[tuple[bytes, int, int]]:
    """The 16-byte hash, first sentence and number of sentences of each run."""
    found = [_WORDS.findall(p.translate(_LOWER)) for p in parts]
    sizes = [len(w) for w in found]
    signs = [blake2b(" ".join(w).encode(), digest_size=16).digest() for w in found]
    if len(parts) < sentences and sum(sizes) < words:
        return [(blake2b(b"".join(signs), digest_size=16).digest(), 0, len(parts))] if parts else []
    out = []
    for first in range(len(parts)):
        held = 0
        for size in range(1, min(sentences, len(parts) - first) + 1):
            held += sizes[first + size - 1]
            if size == sentences or held >= words:
                out.append((blake2b(b"".join(signs[first : first + size]), digest_size=16).digest(), first, size))
    return out


def _spans(rows: DataFrame, sentences: int, words: int) -> DataFrame:
    """id_key, text_key, high and low (the run's hash), first, size and own (whether it repeats an earlier run of its document)."""
    longs, ints = [*ROW_KEYS, "high", "low"], ["first", "size"]
    fields = pa.schema([*((c, pa.int64()) for c in longs), *((c, pa.int32()) for c in ints), ("own", pa.bool_())])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            ids, texts, signs, first, size, own = [], [], [], [], [], []
            for id_key, text_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: set[bytes] = set()
                for sign, at, n in runs(pieces(text), sentences, words):
                    ids.append(id_key)
                    texts.append(text_key)
                    signs.append(sign)
                    first.append(at)
                    size.append(n)
                    own.append(sign in seen)
                    seen.add(sign)
            halves = np.frombuffer(b"".join(signs), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(own, pa.bool_())], schema=fields)

    return rows.select(*ROW_KEYS, "text").mapInArrow(scan, "id_key long, text_key long, high long, low long, first int, size int, own boolean")


def repeats(docs: DataFrame, sentences: int = 3, words: int = 25, text: str = "text") -> DataFrame:
    """id_key, text_key, first, size (in sentences) and source (the id_key of the first document with that run) of every run of every
    document that isn't the first of its kind."""
    if sentences < 1 or words < 1:
        raise ValueError("sentences and words must be 1 or more")
    spans = stage(_spans(keyed(docs, text), sentences, words), "spans")
    sign, document = ["high", "low"], F.struct(*ROW_KEYS)
    shared = spans.filter("not own").groupBy(*sign).agg(F.min(document).alias("source"), F.max(document).alias("last")).filter("source < last").drop("last")
    found = spans.join(stage(shared, "shared-spans"), sign).filter(F.col("own") | (document > F.col("source")))
    alone = spans.filter("own").withColumn("source", document)
    return found.unionByName(alone.select(found.columns)).select(*ROW_KEYS, "first", "size", F.col("source.id_key").alias("source"))


def dedup(docs: DataFrame, sentences: int = 3, words: int = 25, text: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed, first_doc_id (the least document that holds something removed here first; null if nothing is) and
    text (what is kept) of every row of docs."""
    rows = keyed(docs, text)
    cuts = stage(repeats(docs, sentences, words, text).groupBy(*ROW_KEYS).agg(F.collect_set(F.struct("first", "size")).alias("cuts"), F.min("source").alias("source")), "span-cuts")
    if cuts.count() <= BROADCAST_ROWS:  # untouched texts stay where they are
        named = F.broadcast(cuts.select(*ROW_KEYS))
        nothing = [F.lit(None).cast(cuts.schema[c].dataType).alias(c) for c in ("cuts", "source")]
        held = rows.join(named, ROW_KEYS, "left_semi").join(cuts, ROW_KEYS).unionByName(rows.join(named, ROW_KEYS, "left_anti").select("*", *nothing))
    else:
        held = rows.join(cuts, ROW_KEYS, "left")
    fields = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("first_doc_id", pa.int64()), ("text", pa.string())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            total, removed, kept = [], [], []
            for given, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = pieces(given)
                gone = {k for x in places or () for k in range(x["first"], x["first"] + x["size"])}
                total.append(len(parts))
                removed.append(len(gone))
                kept.append("".join(p for k, p in enumerate(parts) if k not in gone) if gone else given or "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), batch.column(3), pa.array(kept, pa.string())], schema=fields)

    source = F.when(F.col("source") > -(2**63), F.col("source")).alias("source")
    return held.select("doc_id", "text", "cuts", source).mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, first_doc_id long, text string")
