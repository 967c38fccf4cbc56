"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated.

Terms are words (letters, lower-cased), and every word of an example is indexed. Its weight is its inverse document frequency, from all
documents, times its chi-square with the label if that is significant among the examples, near copies counted once. The examples are a
bounded sample of the labelled rows, so the index can be broadcast: at most `per_class` of each class, those with the least hash of their
id. A vote weighs 1 / (1.1 - similarity), and is weighted back to its class's true share.

The index keeps each term's postings by blocks of examples with the largest weight in each block that holds the term. A query sums these
maxima into a bound for every block, visits blocks from the highest bound, and stops when no bound reaches its k-th best similarity: the
result is exact. Examples are ordered by likeness before they are cut into blocks, so that a block's maxima come from like examples and
bounds of unlike ones stay low. The share of the votes for label 1 is calibrated by a logistic fit to the examples' own leave-one-out
shares.

Defined results: null and empty texts, and all texts without a word of any example, have no neighbours and get the
share of label 1 among such examples, drawn towards that among all labels as if by two examples more. Ties in similarity go to the smaller id. Null labels and labels of unknown documents are ignored; of repeated labels one counts, the greatest.
Without labels of both classes every score is the share of label 1 (0 without any). Rows that repeat are scored each; a null doc_id is
kept. An empty table gives no rows. Scores read the text alone. A labelled document that is an example finds itself among its neighbours, so
its score echoes its own label; only documents that weren't learnt from (op3's held_out) tell how good scores are.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import add_columns, batches, mixed, stage

_WORD = re.compile(r"[^\W\d_]+")
#: The chance of weighting up any term that has nothing to do with the label, shared out among all terms tried (Bonferroni).
ERROR = 0.05


def term_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def copy_signs(counts: Counter, letters: int = 8, least: int = 10, bands: int = 8, rows: int = 5) -> list[int]:
    """Hashes that near copies are likely to share: of each band's minima over the set of long words. Texts with too few have none."""
    long_words = [t for t in counts if len(t) >= letters]
    if len(long_words) < least:
        return []
    hashes = np.array([zlib.crc32(t.encode()) for t in long_words], np.uint64)
    minima = mixed(hashes[None, :] ^ mixed(np.arange(bands * rows, dtype=np.uint64) + np.uint64(1))[:, None]).min(axis=1).reshape(bands, rows)
    sign = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for column in minima.T:
        sign = mixed(sign ^ column)
    return sign.view(np.int64).tolist()


class Vocabulary:
    """The terms of the examples, by number."""

    def __init__(self, terms: list[str]):
        self.at = {t: n for n, t in enumerate(terms)}

    def __reduce__(self):
        return _unpacked, (zlib.compress("\n".join(self.at).encode()),)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """term_counts, of the examples' terms alone: their numbers and counts."""
        words, at = term_counts(text), self.at
        terms, n = np.array([at.get(w, -1) for w in words], np.int64), np.fromiter(words.values(), np.float64, len(words))
        return terms[terms >= 0], n[terms >= 0]

    def present(self, text: str | None) -> list[int]:
        """The numbers of the examples' terms that the text holds."""
        return [n for w in set(_WORD.findall((text or "").lower())) if (n := self.at.get(w)) is not None]


def _unpacked(terms: bytes) -> Vocabulary:
    found = zlib.decompress(terms).decode()
    return Vocabulary(found.split("\n") if found else [])


def _arrays(vector: dict[int, float] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return vector if isinstance(vector, tuple) else (np.fromiter(vector, np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector)))


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... for size[0] numbers, then the same of low[1], and so on."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]  # where each vector starts (and the end), terms (by number), weights


def stacked(vectors: list[dict[int, float]]) -> Vectors:
    cuts = np.cumsum([0, *map(len, vectors)])
    return cuts, np.fromiter(chain.from_iterable(vectors), np.int32, cuts[-1]), np.fromiter(chain.from_iterable(v.values() for v in vectors), np.float64, cuts[-1])


def likeness_order(vectors: Vectors, block: int, wide: int = 256) -> np.ndarray:
    """Numbers of the vectors, like ones together: halved again and again along the direction in which they differ most, seen in the
    `wide` terms that carry the most weight, until a part is one block."""
    cuts, term, weight = vectors
    mass = np.bincount(term, weight * weight, 1)
    column = np.full(len(mass), -1)
    heavy = np.argsort(-mass, kind="stable")[:wide]
    column[heavy] = np.arange(len(heavy))
    seen = np.flatnonzero(column[term] >= 0)
    dense = np.zeros((len(cuts) - 1, len(heavy)))
    dense[np.searchsorted(cuts, seen, "right") - 1, column[term[seen]]] = weight[seen]
    done, parts = [], [np.arange(len(dense))]
    while parts:
        part = parts.pop()
        if len(part) <= block:
            done.append(part)
            continue
        centred = dense[part] - dense[part].mean(axis=0)
        direction = centred[np.argmax((centred * centred).sum(axis=1))]
        for _ in range(8):
            direction = centred.T @ (centred @ direction)
            direction /= np.sqrt(direction @ direction) or 1.0
        ordered = part[np.argsort(centred @ direction, kind="stable")]
        half = -(-len(part) // (2 * block)) * block
        parts += [ordered[half:], ordered[:half]]
    return np.concatenate(done)


class BlockMaxIndex:
    """Postings of unit vectors, for exact top-k inner products of vectors without negative weights.

    Terms that more than one in 16 vectors hold (at most `common`) are kept as a matrix instead: their share of all similarities is one
    product for many queries, and makes the bounds of the blocks tighter, which add the maxima of the other terms to it. order: the
    numbers of the vectors in the order in which they are cut into blocks; likeness_order of them unless given."""

    def __init__(self, vectors: Vectors | list[dict[int, float]], terms: int, block: int = 64, order: np.ndarray | None = None, common: int = 256):
        cuts, term, weight = vectors = vectors if isinstance(vectors, tuple) else stacked(vectors)
        size = len(cuts) - 1
        self.block, self.blocks = block, max(1, -(-size // block))
        self.order = likeness_order(vectors, block) if order is None else order
        place = np.empty(size, np.int32)
        place[self.order] = np.arange(size, dtype=np.int32)
        place = np.repeat(place, np.diff(cuts))
        holders = np.bincount(term, minlength=terms)
        most = np.argsort(-holders, kind="stable")[:common]
        most = most[16 * holders[most] > size]
        self.column = np.full(terms, -1, np.int32)  # of the matrix of common terms
        self.column[most] = np.arange(len(most))
        self.common = np.zeros((len(most), self.blocks * block))
        column = self.column[term]
        dense = column >= 0
        self.common[column[dense], place[dense]] = weight[dense]
        rest = np.flatnonzero(~dense)
        del column, dense
        rest = rest[np.lexsort((place[rest], term[rest]))]
        self.place, self.weight, term = place[rest], weight[rest], term[rest]
        del rest, place
        at = self.place // block
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))  # where each term's block of postings starts; only blocks that hold the term
        self.low, self.length, self.at = first.astype(np.int32), np.diff(first, append=len(term)).astype(np.int32), at[first]
        self.highest = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.start = np.searchsorted(term[first], np.arange(terms + 1)).astype(np.int32)

    def search(self, query: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples with a positive similarity, best first, ties to the lower, and their similarities. without: an example left out."""
        return next(self.search_all([query], k, [without]))

    def search_all(self, queries: list[dict[int, float] | tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None, at_once: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """search for each query; the common terms of `at_once` queries are multiplied together."""
        for low in range(0, len(queries), at_once):
            some = [_arrays(q) for q in queries[low : low + at_once]]
            asked = np.zeros((len(some), len(self.common)))
            for row, (terms, weights) in zip(asked, some, strict=True):
                column = self.column[terms]
                row[column[column >= 0]] = weights[column >= 0]
            for n, ((terms, weights), shared) in enumerate(zip(some, asked @ self.common, strict=True), low):
                yield self._best(terms, weights, shared, k, without[n] if without else -1)

    def _best(self, terms: np.ndarray, weights: np.ndarray, shared: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        per = self.start[terms + 1] - self.start[terms]
        entries, asked = _ranges(self.start[terms], per), np.repeat(weights, per)
        at = self.at[entries]
        bounds = np.bincount(at, asked * self.highest[entries], self.blocks) + shared.reshape(self.blocks, self.block).max(axis=1)
        ids, values, floor = np.empty(0, np.int64), np.empty(0), 0.0
        left, step = bounds > 0, max(2, -(-2 * k // self.block))
        while left.any():
            # The blocks with the highest bounds first; then all whose bounds reach the k-th best of those.
            chosen = np.zeros(self.blocks, bool)
            chosen[np.flatnonzero(left) if len(ids) >= k else np.argsort(np.where(left, -bounds, 0), kind="stable")[:step]] = True
            chosen &= left
            here = np.flatnonzero(chosen[at])
            length = self.length[entries[here]]
            postings = _ranges(self.low[entries[here]], length)
            sums = np.bincount(self.place[postings], np.repeat(asked[here], length) * self.weight[postings], len(shared)) + shared
            hit = np.flatnonzero((sums > 0) & np.repeat(chosen, self.block))
            sums, hit = sums[hit], self.order[hit]
            if without >= 0:
                sums, hit = sums[hit != without], hit[hit != without]
            if len(hit) > 4 * k:
                near = sums >= np.partition(sums, len(hit) - k)[len(hit) - k] - 1e-11
                sums, hit = sums[near], hit[near]
            ids, values = np.r_[ids, hit], np.r_[values, sums]
            first = np.lexsort((ids, -np.round(values, 12)))[:k]
            ids, values = ids[first], values[first]
            left &= ~chosen
            if len(ids) >= k:
                floor = values[-1]
                left &= bounds >= floor - 1e-12
        return ids, values


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) of a weighted fit, lightly held to 0, by Newton's method."""
    a, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ a))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * a
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), max(0.0, float(a[1]))


class Model:
    """What is broadcast: terms with their weights, the index of the examples, their ids and labels, and the calibration.

    examples: ids, labels, and the terms (by number) and counts of each, one after another between `cuts`."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray], shares: tuple[float, float], k: int):
        self.weights, self.k, self.vocabulary, self.counts, self.ids, self.labels = weights, k, vocabulary, counts, ids, labels
        per = np.array([(labels == c).sum() for c in (0, 1)], np.float64)
        self.vote = (np.array(shares) / np.maximum(per, 1))[labels]  # what an example stands for
        self.prior, self.index, self.order, self.line = shares[1], None, None, None
        if not len(ids):
            return
        vectors = self._vectors()
        self.index = BlockMaxIndex(vectors, len(weights))
        self.order = self.index.order
        if (per > 0).all():
            cuts, terms, values = vectors
            each = [(terms[low:high], values[low:high]) for low, high in zip(cuts, cuts[1:], strict=False)]
            own = [self.share(*found) for found in self.index.search_all(each, k, list(range(len(each))))]
            known, scale = np.array([x is not None for x in own]), len(ids)
            if len(set(labels[known])) == 2:
                self.line = _logistic(np.array([x for x in own if x is not None]), labels[known].astype(float), self.vote[known] * scale)
            rest = ~known
            pull = 2 * self.vote.mean()  # so that one odd example doesn't decide over all texts without known words
            self.prior = float(((self.vote * labels)[rest].sum() + pull * shares[1]) / (self.vote[rest].sum() + pull))

    def _vectors(self) -> Vectors:
        cuts, terms, n = self.counts
        raw = (1 + np.log(n)) * self.weights[terms]
        size = np.diff(cuts)
        norm = np.bincount(np.repeat(np.arange(len(size)), size), raw * raw, len(size))
        return cuts, terms, raw / np.repeat(np.sqrt(norm), size)

    def __getstate__(self) -> bytes:
        """Without the index, which is larger than what it's built from: a broadcast is kept on every executor's disk."""
        return zlib.compress(pickle.dumps(self.__dict__ | {"index": None}), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__ |= pickle.loads(zlib.decompress(state))
        self.index = BlockMaxIndex(self._vectors(), len(self.weights), order=self.order) if len(self.ids) else None

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of (1 + log tf) * weight: the numbers of its terms, and their values."""
        terms, n = counts
        raw = (1 + np.log(n)) * self.weights[terms]
        return terms, raw / np.sqrt((raw * raw).sum()) if len(raw) else raw

    def share(self, ids: np.ndarray, similarity: np.ndarray) -> float | None:
        votes = self.vote[ids] / (1.1 - similarity)
        return float((votes * self.labels[ids]).sum() / votes.sum()) if len(ids) else None

    def scores(self, texts: list[str | None]) -> tuple[list[float], list[list[dict]]]:
        """The calibrated scores, and their evidence: the neighbours' ids, labels and similarities."""
        found = self.index.search_all([self.vector(self.vocabulary.counts(t)) for t in texts], self.k) if self.index else [(np.empty(0, np.int64), np.empty(0))] * len(texts)
        scores, evidence = [], []
        for ids, similarity in found:
            share = self.share(ids, similarity)
            scores.append(self.prior if share is None or self.line is None else float(1 / (1 + np.exp(-(self.line[0] + self.line[1] * share)))))
            evidence.append([{"doc_id": i, "label": y, "similarity": x} for i, y, x in zip(self.ids[ids].tolist(), self.labels[ids].tolist(), similarity.tolist(), strict=True)])
        return scores, evidence


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, k: int = 15) -> Model:
    """docs: doc_id, text; all of them count for document frequencies. labels: doc_id, label (0 or 1), the rows to learn from."""
    known = labels.filter("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    both = sum(totals.values())
    shares = (totals.get(0, 0) / both, totals.get(1, 0) / both) if both else (1.0, 0.0)
    first = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * per_class rows
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    counts_type = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))
    fields = [pa.field("counts", counts_type), pa.field("signs", pa.list_(pa.int64()))]

    def count(texts: list) -> list[list]:
        found = [term_counts(x) for x in texts]
        return [[[{"term": t, "n": n} for t, n in c.items()] for c in found], [copy_signs(c) for c in found]]

    counted = add_columns(given.join(sample, "doc_id"), ["text"], fields, count)
    examples = stage(counted.select("doc_id", "label", "counts", "signs"), "examples")
    examples = stage(_one_of_copies(examples), "distinct-examples")
    kept, ids, known_labels, counts, chi = _counted(examples.toArrow().sort_by("doc_id"))  # at most 2 * per_class rows
    pa.default_memory_pool().release_unused()  # else the driver keeps what the table took, through all that follows
    if len(set(known_labels)) < 2:
        return Model(Vocabulary([]), np.empty(0), ids[:0], known_labels[:0], (np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)), shares, k)
    words = Vocabulary(kept)
    vocabulary = docs.sparkSession.sparkContext.broadcast(words)

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(len(vocabulary.value.at), np.int64), 0
        for batch in batches(it):
            for text in batch.column(0).to_pylist():
                found[vocabulary.value.present(text)] += 1
                texts += 1
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[texts, found[at]], pa.int64())], names=["term", "n"])

    summed = given.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(kept) + 1, np.int64)
    frequency[summed["term"].to_numpy()] = summed["n"].to_numpy()  # the last counts the texts
    least = NormalDist().inv_cdf(1 - ERROR / (2 * max(1, len(kept)))) ** 2
    weights = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1) * np.where(chi >= least, np.maximum(chi, 1), 1)
    return Model(words, weights, ids, known_labels, counts, shares, k)


def _counted(held: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Of examples in the order of their ids: their terms, the examples' ids, labels and counts (see Model), and the terms' chi-squares
    with the label (0 for terms in all examples). Rows that repeat an id are one example, with the greatest counts."""
    ids, first, row = np.unique(held["doc_id"].to_numpy(), return_index=True, return_inverse=True)
    labels = held["label"].to_numpy()[first].astype(np.int64)
    counts = held["counts"].combine_chunks()
    flat = counts.flatten()
    coded = flat.field("term").dictionary_encode()
    terms = coded.dictionary.to_pylist()
    order = sorted(range(len(terms)), key=terms.__getitem__)
    number = np.empty(len(terms), np.int64)
    number[order] = np.arange(len(terms))
    example = np.repeat(row, counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    term, n = number[coded.indices.to_numpy(zero_copy_only=False)], flat.field("n").to_numpy(zero_copy_only=False)
    by = np.lexsort((-n, term, example))
    by = by[np.flatnonzero(np.diff(example[by] * len(terms) + term[by], prepend=-1))]
    example, term, n = example[by], term[by].astype(np.int32), n[by]
    cuts = np.searchsorted(example, np.arange(len(ids) + 1))
    n1, total = float(labels.sum()), float(len(ids))
    n0 = total - n1
    a = np.bincount(term, labels[example], len(terms))
    b = np.bincount(term, minlength=len(terms)) - a
    some = (a + b < total) & (n0 > 0) & (n1 > 0)
    chi = np.where(some, total * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.where(some, (a + b) * (total - a - b) * n0 * n1, 1), 0)
    return [terms[t] for t in order], ids, labels, (cuts, term, n), chi


def _one_of_copies(examples: DataFrame) -> DataFrame:
    """Examples (a bounded sample) without those that share a sign with an earlier one."""
    first = F.min("doc_id").over(Window.partitionBy("sign"))
    copies = examples.select("doc_id", F.explode("signs").alias("sign")).select("doc_id", (first < F.col("doc_id")).alias("later")).filter("later")
    return examples.join(copies.select("doc_id").distinct(), "doc_id", "left_anti").drop("signs")


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """docs with a score (0 to 1) and its evidence (array of doc_id, label, similarity), under the given names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    return add_columns(docs, ["text"], [pa.field(names[0], pa.float64()), pa.field(names[1], evidence)], lambda texts: held.value.scores(texts))
