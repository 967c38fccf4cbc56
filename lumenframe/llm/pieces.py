"""Encoding and decoding by a sentencepiece model through a table of distinct chunks.

No piece of the model crosses a white-space marker, so a text's ids are those of its marked words, one after another. The same holds
between letters and signs, if no piece holds both; chunks are then shorter and fewer distinct ones (cuts() looks at the model for both,
and refuses one whose pieces cross markers). Each distinct chunk of the corpus is segmented and decoded once, and the
ids are joined back by position.

Size: a task sums up its own chunks before the shuffle, so a common word costs one row a task. The table is held by every worker up to
`most_bytes` once packed, most frequent chunks first. Chunks beyond it are looked up by a join: their places are shuffled by chunk, come
back grouped by document, and the documents that have some are joined to them. A common word is never among those.

Defined results: null text counts as empty, and an empty text has no ids and decodes to the empty text. U+2581 in a text is a marker and
decodes to a blank, as in the library. Repeated rows are encoded each; a null doc_id stays null. Columns of the given names are replaced,
others, whatever their names, pass through. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lumenframe.llm.common import batches, stage
from lumenframe.llm.lookup import Packed, packed, split

MARK = "▁"
#: A worker's own dictionaries are given out or forgotten at this many entries.
MOST_HELD = 400_000
LONG = 256  # characters; longer chunks aren't remembered by a worker


@lru_cache(maxsize=2)
def processor(model: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=2)
def cuts(model: str | None) -> re.Pattern:
    """The pattern whose matches are the chunks of a text behind its first marker."""
    sp = processor(model)
    inner = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
    bare = [p.lstrip(MARK) for p in inner]
    if any(MARK in p for p in bare) or sp.encode("a  b \t") != [*sp.encode("a"), *_marked(sp, "  b"), *_marked(sp, " \t")]:
        raise ValueError("pieces of this model cross white-space markers, or it changes white space")
    joined = {*map(chr, range(128)), *"".join(p for p in bare if len(p) > 1)} - {" ", MARK}  # what joins nothing may go to either side
    signs = {c for c in joined if not c.isalpha() and unicodedata.category(c)[0] != "M"}
    if any(p and 0 < len(signs & set(p)) < len(set(p)) for p in bare):
        return re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
    other = "".join(re.escape(c) for c in sorted(signs))
    return re.compile(f"[ {MARK}]*[^ {MARK}{other}]+|[ {MARK}]*[{other}]+|[ {MARK}]+")


def _marked(sp, chunk: str) -> list[int]:
    """Ids of a chunk as it stands within a text."""
    if chunk[0] in (" ", MARK):  # the model itself puts the first marker there
        return sp.encode(chunk[1:]) if len(chunk) > 1 else [sp.piece_to_id(MARK)]
    lead = sp.encode("\n")  # the marker and a byte, which join nothing
    return sp.encode("\n" + chunk)[len(lead) :]


def _decoded(sp, ids: list[int]) -> str:
    """What the ids stand for behind other ids."""
    return sp.decode([*sp.encode("\n"), *ids])[1:]


def chunks_of(text: str | None, pattern: re.Pattern) -> list[str]:
    return pattern.findall(" " + text) if text else []


def _counted(docs: DataFrame, model: str | None) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, seen = cuts(model), Counter()

        def told() -> pa.RecordBatch:
            found = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["chunk", "n"])
            seen.clear()
            return found

        for batch in batches(it):
            for text in batch.column(0).to_pylist():
                seen.update(chunks_of(text, pattern))
            if len(seen) > MOST_HELD:
                yield told()
        yield told()

    return docs.mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """chunk, n, ids of every distinct chunk; the last id is -1 where they don't decode to the chunk itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches(it, 4096):
            ids = []
            for chunk in batch.column(0).to_pylist():
                found = _marked(sp, chunk)
                ids.append(found if _decoded(sp, found) == chunk.replace(MARK, " ") else [*found, -1])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "n", "ids"])

    counted = _counted(docs.select(F.col(f"`{text}`").cast("string").alias("text")), model)
    return stage(counted.mapInArrow(run, "chunk string, n long, ids array<int>"), "chunks")


def encode_decode(docs: DataFrame, model: str | None = None, text: str = "text", most_bytes: int = 96 << 20) -> DataFrame:
    """docs with ids (array<int>) and decoded (what the ids decode to) of its text. See the module's docstring."""
    head, tail = split(chunk_table(docs, model, text), "chunk", "ids", "n", most_bytes, 4)
    table = docs.sparkSession.sparkContext.broadcast(packed(head, np.int32))
    names = [c for c in docs.columns if c.lower() not in ("ids", "decoded") or c == text]
    kept = [c for c in names if c.lower() not in ("ids", "decoded")]
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text}`").cast("string").alias("text"))
    if tail is not None:
        keys = [F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key2")]  # equal texts have equal ids
        given = given.select("*", *keys)
        missing = given.select("key", "key2", "text").mapInArrow(_holes(table, model), "key long, key2 long, at int, chunk string")
        filled = missing.join(tail.select("chunk", "ids"), "chunk").groupBy("key", "key2").agg(F.collect_set(F.struct("at", "ids")).alias("filled"))
        given = given.join(stage(filled, "filled"), ["key", "key2"], "left")
    schema = given.select(*(F.col(f"c{names.index(c)}").alias(f"c{names.index(c)}") for c in kept)).schema.add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    made = given.mapInArrow(_whole(table, model, [f"c{names.index(c)}" for c in kept]), schema)
    return made.select(*(F.col(f"c{names.index(c)}").alias(c) for c in kept), "ids", "decoded")


def _looked_up(table, model: str | None):
    """chunk -> its ids (as bytes, and whether they decode to it), or None; what was asked is remembered."""
    held: dict[str, tuple[bytes, bool] | None] = {}
    known: Packed = table.value

    def of(chunk: str) -> tuple[bytes, bool] | None:
        try:
            return held[chunk]
        except KeyError:
            pass
        found = known.get(chunk)
        if found is not None:
            found = (found[:-1].tobytes(), False) if found[-1] < 0 else (found.tobytes(), True)
        if len(chunk) <= LONG:
            if len(held) >= MOST_HELD:
                held.clear()
            held[chunk] = found
        return found

    return cuts(model), of


def _holes(table, model: str | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, of = _looked_up(table, model)
        for batch in batches(it):
            rows, at, chunks = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for place, chunk in enumerate(chunks_of(text, pattern)):
                    if of(chunk) is None:
                        rows.append(k)
                        at.append(place)
                        chunks.append(chunk)
            row = pa.array(rows, pa.int32())
            yield pa.record_batch([batch.column("key").take(row), batch.column("key2").take(row), pa.array(at, pa.int32()), pa.array(chunks, pa.string())], names=["key", "key2", "at", "chunk"])

    return run


def _whole(table, model: str | None, kept: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, of = _looked_up(table, model)
        sp = processor(model)
        for batch in batches(it, 256):
            filled = batch.column("filled").to_pylist() if "filled" in batch.schema.names else [None] * batch.num_rows
            parts, lengths, decoded = [], [], []
            for text, more in zip(batch.column("text").to_pylist(), filled, strict=True):
                holes = {x["at"]: x["ids"] for x in more or ()}
                own, same = [], True
                for place, chunk in enumerate(chunks_of(text, pattern)):
                    found = of(chunk)
                    if found is None:
                        ids = holes[place]
                        found = (np.array(ids[:-1], np.int32).tobytes(), False) if ids[-1] < 0 else (np.array(ids, np.int32).tobytes(), True)
                    own.append(found[0])
                    same &= found[1]
                joined = b"".join(own)
                parts.append(joined)
                lengths.append(len(joined) // 4)
                decoded.append((text or "").replace(MARK, " ") if same else sp.decode(np.frombuffer(joined, np.int32).tolist()))
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids, pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return run
