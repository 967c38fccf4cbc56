"""Which tokens of one tokenizer stand where which of another do, over all documents.

Where tokens of both end, a text is cut into groups; tokens of one group are linked. Groups repeat: the distinct ones (ids of A, ids of
B) are few beside their occurrences. So groups are interned, each distinct one is expanded into its links once, and what the links are
worth is looked up by group:

1. Each document is tokenized once and written as its groups. From these, each task interns the distinct groups it meets and counts, for
   each id pair, the documents that hold it linked, and for each group its uses; sums by pair and by group are shuffled, not documents.
2. A pair's count and its A id's highest count are joined to the links of the distinct groups, and summed up by group.
3. Workers hold the groups' values, most used first, up to `most_bytes`; for groups beyond, documents send (row, group, uses) to a join
   and get back sums. Texts are not shuffled.

Texts are tokenized by chunks, which no token of either crosses and which both see alike wherever they stand (blanks before a word, and
between ASCII letters, digits and signs); a worker remembers the chunks it has met. Tokenizers of other kinds take a text as one chunk.

Defined results: texts that are null, empty, or not given back by the tokens of A or of B, have no tokens: zeros, and no groups. Repeated
rows are documents of their own. A null doc_id stays null; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import batches, small, stage
from lumenframe.llm.lookup import packed, split
from lumenframe.llm.packing import encode

LONG, MOST_HELD = 64, 100_000  # characters of a chunk that is remembered; entries of a worker's dictionaries

_L, _D, _O = "A-Za-zÀ-ÖØ-öø-ſ", "0-9", r"!-&(-/:-@\[-`{-~"
#: Blanks with letters, digits or signs, where what follows parts them for both tokenizers; a line feed before such; else all up to the next
#: blank that stands behind no white space.
_CHUNK = re.compile(rf" *[{_L}]+(?![^ \n{_O}{_D}'])| *[{_D}]+(?![^ \n{_O}{_L}'])| *[{_O}]+(?![^ \n{_L}{_D}])|(?<=[{_L}{_D}{_O}])\n(?=[{_L}{_D}{_O}])| *[^ ]+(?:(?<=[\s▁\x1c-\x1f]) +[^ ]+)*(?:(?<=[\s▁\x1c-\x1f]) +\Z)?| +\Z")

#: The neighbours between which texts are cut.
_PARTED = re.compile(rf"[{_L}][\n{_O}{_D}']|[{_D}][\n{_O}{_L}']|[{_O}][\n{_L}{_D}]|\n[{_L}{_D}{_O}]")


@lru_cache(maxsize=1)
def _byte_values() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the groups of a text."""

    def __init__(self, bpe_json: str | None = None, model: str | None = None):
        import json

        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.bpe_json, self.held, self.before = bpe_json, {}, {}
        self.a = Tokenizer.from_file(bpe_json or public_tokenizers.path("byte_bpe_50k.json"))
        self.b = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        letters = _byte_values()
        self.a_bytes = {k: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, k in self.a.get_vocab().items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        spec = json.loads(self.a.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        bare = [p.lstrip("▁") for k in range(self.b.get_piece_size()) if len(p := self.b.id_to_piece(k)) > 1 and not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        mixed = any("▁" in p or _PARTED.search(p) for p in bare)
        self.lossless = plain and set(letters) <= set(self.a.get_vocab())
        self.a_names, self.b_names = {k: str(k) for k in self.a_bytes}, [str(k) for k in range(len(self.b_bytes))]
        self.a_sizes, self.b_sizes = {k: len(t) for k, t in self.a_bytes.items()}, [len(t) for t in self.b_bytes]
        self.cut = plain and not mixed and self.b.encode("a\nb") == [*self.b.encode("a"), *self._b("\n"), *self._b("b")]

    def _b(self, chunk: str) -> list[int]:
        """B's ids of a chunk of a text with a blank before it."""
        if chunk[0] == " ":
            return self.b.encode(chunk[1:]) if len(chunk) > 1 else [self.b.piece_to_id("▁")]
        return self.b.encode("\n" + chunk)[len(self.b.encode("\n")) :]

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text) if self.cut else [" " + text]

    def groups(self, chunk: str) -> str | None:
        """The groups of a chunk as `a1,a2|b1;a3|b2,b3`; None where its tokens don't give it back."""
        own, a, b = chunk.encode(), encode(chunk, self.bpe_json, special=False), self._b(chunk)
        if b"".join([self.b_bytes[k] for k in b]) != own or not self.lossless and b"".join([self.a_bytes[k] for k in a]) != own:
            return None
        left, right = [self.a_names[k] for k in a], [self.b_names[k] for k in b]
        if len(a) == 1 or len(b) == 1:
            return f"{','.join(left)}|{','.join(right)}"
        sizes, other = self.a_sizes, self.b_sizes
        out, i, j, first_a, first_b, at_a, at_b = [], 1, 1, 0, 0, sizes[a[0]], other[b[0]]
        while True:
            if at_a == at_b:
                out.append(f"{left[first_a]}|{right[first_b]}" if i - first_a == j - first_b == 1 else f"{','.join(left[first_a:i])}|{','.join(right[first_b:j])}")
                if i == len(a):
                    return ";".join(out)
                first_a, first_b = i, j
            if at_a <= at_b:
                step_b = at_a == at_b
                at_a += sizes[a[i]]
                i += 1
                if not step_b:
                    continue
            at_b += other[b[j]]
            j += 1

    def of_text(self, text: str | None) -> str | None:
        """The groups of a text; null where it has no tokens. What short chunks gave is remembered, whatever the task."""
        if not text:
            return None
        parts, held = [], self.held
        for chunk in self.chunks(text):
            found = held.get(chunk)
            if found is None:
                found = self.before.pop(chunk, None) or self.groups(chunk)
                if found is None:
                    return None
                if len(chunk) <= LONG:
                    held[chunk] = found
                    if len(held) >= MOST_HELD:  # what wasn't asked for since the last change of generations goes
                        self.before, self.held = held, {}
                        held = self.held
            parts.append(found)
        return ";".join(parts)


@lru_cache(maxsize=1)
def _aligner(bpe_json: str | None, model: str | None) -> Aligner:
    return Aligner(bpe_json, model)


def links_of(group: str) -> dict[tuple[int, int], int]:
    """Each distinct id pair of a group and its occurrences."""
    a, _, b = group.partition("|")
    left, right = Counter(map(int, a.split(","))), Counter(map(int, b.split(",")))
    return {(x, y): n * m for x, n in left.items() for y, m in right.items()}


def _tokenized(docs: DataFrame, bpe_json: str | None, model: str | None) -> DataFrame:
    """doc_id, groups (their names, compressed: they would fill several times the text's memory in what Spark sends a worker at once)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(bpe_json, model)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches(it, 64):
            found = (aligner.of_text(t) for t in batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array([None if g is None else pack(g.encode()) for g in found], pa.binary())], names=["doc_id", "groups"])

    return docs.mapInArrow(run, "doc_id long, groups binary")


def _named(column: pa.Array) -> Iterator[str | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (None if g is None else unpack(g).decode() for g in column.to_pylist())


def _counted(made: DataFrame) -> DataFrame:
    """key, docs, uses: documents in which the id pair `a|b` is linked, and uses of the group of this name."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: Counter = Counter()
        pairs_of: dict[str, tuple[int, ...]] = {}
        numbers: dict[str, int] = {}  # of pairs
        held_by: list[int] = []

        def told() -> Iterator[pa.RecordBatch]:
            keys = [*uses, *numbers]
            docs, used = [*([0] * len(uses)), *held_by], [*uses.values(), *([0] * len(numbers))]
            for at in range(0, len(keys), 50_000):
                part = slice(at, at + 50_000)
                yield pa.record_batch([pa.array(keys[part], pa.string()), pa.array(docs[part], pa.int64()), pa.array(used[part], pa.int64())], names=["key", "docs", "uses"])
            for x in (uses, pairs_of, numbers, held_by):
                x.clear()

        for batch in batches(it, 128):
            for groups in _named(batch.column(0)):
                if groups is None:
                    continue
                found = Counter(groups.split(";"))
                uses.update(found)
                held = set()
                for g in found:
                    own = pairs_of.get(g)
                    if own is None:
                        own = pairs_of[g] = tuple(numbers.setdefault(f"{a}|{b}", len(numbers)) for a, b in links_of(g))
                        held_by.extend([0] * (len(numbers) - len(held_by)))
                    held.update(own)
                for p in held:
                    held_by[p] += 1
                if len(uses) + len(numbers) > 2 * MOST_HELD:
                    yield from told()
        yield from told()

    return made.select("groups").mapInArrow(run, "key string, docs long, uses long").groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))


def _expanded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("links", pa.int64())])
    for batch in batches(it, 2048):
        rows: list[tuple] = []
        for key in batch.column(0).to_pylist():
            rows += [(key, a, b, n) for (a, b), n in links_of(key).items()]
            if len(rows) > 50_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pair_counts(keys: DataFrame) -> DataFrame:
    """a, b, docs, best (docs is the highest of its a) of all linked id pairs."""
    pairs = keys.filter("docs > 0").select(F.split("key", "[|]").alias("k"), "docs").select(F.col("k")[0].cast("int").alias("a"), F.col("k")[1].cast("int").alias("b"), "docs")
    highest = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, bpe_json: str | None = None, model: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2,b3`, null without tokens) of every row of docs."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stage(_tokenized(given, bpe_json, model), "aligned")
    keys = stage(_counted(made), "groups-and-pairs")
    links = keys.filter("uses > 0").select("key").mapInArrow(_expanded, "key string, a int, b int, links long")
    pairs = stage(pair_counts(keys), "pairs")
    worth = links.join(small(pairs), ["a", "b"]).groupBy("key").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    used = keys.filter("uses > 0").select("key", "uses")
    values = stage(worth.join(used, "key").select("key", "uses", F.array("n_best", "count_sum").alias("worth")), "groups")
    head, tail = split(values, "key", "worth", "uses", most_bytes, 8)
    table = docs.sparkSession.sparkContext.broadcast(packed(head, np.int64))
    fields = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string()), ("rest", pa.map_(pa.string(), pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = table.value, {}

        def of(g: str) -> tuple[list[int], bool]:
            """n_a, n_b, n_groups, n_links, n_best, count_sum of a group, and whether the latter two are known."""
            left, _, right = g.partition("|")
            n, m, worth = left.count(",") + 1, right.count(",") + 1, known.get(g)
            if len(held) > MOST_HELD:
                held.clear()
            held[g] = found = ([n, m, 1, n * m, *((0, 0) if worth is None else worth.tolist())], worth is not None)
            return found

        for batch in batches(it, 64):
            out: list[list] = [[] for _ in fields]
            for doc, groups in zip(batch.column(0).to_pylist(), _named(batch.column(1)), strict=True):
                sums, rest = [0] * 6, []
                for g, times in (Counter(groups.split(";")) if groups is not None else {}).items():
                    own, whole = held.get(g) or of(g)
                    for k, x in enumerate(own):
                        sums[k] += x * times
                    if not whole:
                        rest.append((g, times))
                for to, value in zip(out, [doc, *sums, groups, rest or None], strict=True):
                    to.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, fields, strict=True)], schema=fields)

    made = made.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, rest map<string,long>")
    if tail is None:
        return made.drop("rest")
    made = stage(made.withColumn("row", F.monotonically_increasing_id()), "numbered")  # once written, a row keeps its number
    asked = made.filter("rest is not null").select("row", F.explode("rest").alias("key", "n"))
    more = asked.join(tail.select("key", "worth"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("worth")[0]).alias("best_more"), F.sum(F.col("n") * F.col("worth")[1]).alias("sum_more"))
    summed = made.join(more, "row", "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "best_more"), plus("count_sum", "sum_more"), "groups")
