"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is `window` consecutive words of an item (all of them, if it has fewer). Of every run of k-grams as long as a window, the least
hash is kept as a fingerprint, so any text that holds a window holds one of its fingerprints. Documents' fingerprints that some item
shares mark places; a hit is extended to the windows around its place, and these windows' own words are held against those of the items.
Items shorter than a window have too few k-grams for that guarantee: the grams of their own length are looked for.

Size: fingerprints are about two in seven words, of three numbers each; they are tested against the items' distinct ones, so a k-gram that
many items share costs a document no more than one of a single item. Windows are made for marked places alone, each once, and items are
joined to a document's distinct windows: work is linear in a document's words, however often it repeats itself. Items are broadcast only
after a count; beyond it the joins shuffle, where Spark splits hot keys.

Defined results: null text has no words, and such a document no hits. Rows that repeat (same id and text) get the same result each. A
null doc_id is kept. Items without an id or words are skipped; an id that repeats counts once. An empty benchmark leaves all documents
clean; no documents give no rows. Positions take 26 bits: a document may have 67 million words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower, small, stage

#: Letters, digits and all that is not ASCII; told as what it holds, since Java searches the negation twenty times more slowly.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_BITS = 26
_NO_ID = -(2**63)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _folded(text: Column) -> Column:
    """words_of, with other alphabets lower-cased too: as many words, and equal ones stay equal. Spark's lower() is far quicker than
    folding A-Z alone, so this is what fingerprints are made of; the words themselves are compared for hits only. lower() looks at the
    neighbours of a capital sigma, and in some languages' settings at I and J; these are replaced before, so that no word's form depends
    on what stands around it."""
    for capital, letter in (("\u03a3", "\u03c3"), ("I", "i"), ("J", "j")):
        text = F.replace(text, F.lit(capital), F.lit(letter))
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _starts(values: Column, size: int) -> Column:
    """The values at which a run of `size` values starts."""
    return F.slice(values, 1, F.greatest(F.size(values) - (size - 1), F.lit(0)))


def _grams(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words; none, if there are fewer words."""
    return F.transform(_starts(words, size), lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, size))))


def _packed(hashes: Column) -> Column:
    """Each hash's upper bits, then its position in _BITS bits: the order by hash breaks ties by position."""
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, _BITS), _BITS).bitwiseOR(i.cast("long")))


def _minima(packed: Column, run: int) -> Column:
    """The distinct least values of each `run` consecutive ones."""
    if run == 1:
        return packed
    return F.array_distinct(F.transform(_starts(packed, run), lambda p, i: F.least(p, *(F.get(packed, i + j) for j in range(1, run)))))


def _fingerprints(df: DataFrame, keys: list[str], k: int, run: int) -> DataFrame:
    """keys, pos, fp of a frame with keys and words. Each step is a projection of its own: what a lambda reads is then a column."""
    hashed = df.select(*keys, _grams(F.col("words"), k).alias("hashes"))
    packed = hashed.select(*keys, _packed(F.col("hashes")).alias("packed"))
    each = packed.select(*keys, F.explode(_minima(F.col("packed"), run)).alias("p"))
    return each.select(*keys, F.col("p").bitwiseAND(F.lit(2**_BITS - 1)).cast("int").alias("pos"), F.shiftright("p", _BITS).alias("fp"))


def _windows(words: Column, starts: Column, size: Column) -> Column:
    """The runs of `size` words at these starts, as texts: words hold no blanks, so equal texts are equal runs."""
    return F.transform(starts, lambda s: F.struct(s.alias("start"), size.alias("size"), F.array_join(F.slice(words, s + 1, size), " ").alias("gram")))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id (a string), size, gram of the distinct windows of the items that have an id and words."""
    named = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sized = stage(named.select("item_id", "words", F.least(F.lit(window), F.size("words")).alias("size")), "items")
    each = sized.select("item_id", F.explode(_windows(F.col("words"), F.sequence(F.lit(0), F.size("words") - F.col("size")), F.col("size"))).alias("w"))
    return each.select("item_id", "w.size", "w.gram").distinct()


_KEYS = ["id_key", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"), "text")


def marked_places(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """id_key, text_key, size, at: the places of a document whose fingerprint (of items of `window` words or more) or gram of `size` words
    (of shorter ones) some item has. The keys name the row of docs: its id (null made a number), its text's hash."""
    worded = _keyed(docs).select(*_KEYS, _folded(F.col("text")).alias("words"))
    folded = stage(items.filter(F.col("item_id").isNotNull()).select(_folded(F.col("text")).alias("words")).filter(F.size("words") > 0), "folded-items")
    prints = stage(_fingerprints(folded.filter(F.size("words") >= window), [], k, window - k + 1).select("fp").distinct(), "item-prints")
    found = _fingerprints(worded, _KEYS, k, window - k + 1).join(small(prints), "fp", "left_semi").select(*_KEYS, "pos", F.lit(window).alias("size"))
    for row in folded.filter(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect():  # below `window` rows
        whole = stage(folded.filter(F.size("words") == row["n"]).select(_grams(F.col("words"), row["n"])[0].alias("fp")).distinct(), "short-items")
        grams = worded.select(*_KEYS, F.posexplode(_grams(F.col("words"), row["n"])).alias("pos", "fp"))
        found = found.unionByName(grams.join(small(whole), "fp", "left_semi").select(*_KEYS, "pos", F.lit(row["n"]).alias("size")))
    return found.groupBy(*_KEYS, "size").agg(F.collect_set("pos").alias("at"))


def hits(docs: DataFrame, items: DataFrame, known: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """id_key, text_key, start, size, gram of every place of a document at which a window of some item stands. known: item_windows."""
    if not 1 <= k <= window:
        raise ValueError("k must lie in 1..window")
    places = stage(marked_places(docs, items, window, k).groupBy(*_KEYS).agg(F.collect_list(F.struct("size", "at")).alias("marked")), "places")
    worded = stage(_keyed(docs).join(small(places), _KEYS).dropDuplicates(_KEYS).select(*_KEYS, words_of(F.col("text")).alias("words"), "marked"), "marked-documents")
    lead = lambda m: F.when(m["size"] == window, F.lit(window - k)).otherwise(F.lit(0))
    spread = lambda m: F.array_distinct(F.flatten(F.transform(m["at"], lambda p: F.sequence(F.greatest(p - lead(m), F.lit(0)), p))))
    placed = F.transform("marked", lambda m: F.struct(m["size"].alias("size"), F.filter(spread(m), lambda s: s <= F.size("words") - m["size"]).alias("starts")))
    apart = stage(worded.select(*_KEYS, "words", placed.alias("placed")), "marked-windows")
    each = apart.select(*_KEYS, F.explode(F.flatten(F.transform("placed", lambda p: _windows(F.col("words"), p["starts"], p["size"])))).alias("w"))
    return each.select(*_KEYS, "w.start", "w.size", "w.gram").join(small(stage(known.select("size", "gram").distinct(), "windows")), ["size", "gram"], "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_words, n_hit (words within a window that occurs), items (their ids as strings,
    sorted) and contaminated (n_hit > 0)."""
    known = stage(item_windows(items, window), "item-windows")
    found = stage(hits(docs, items, known, window, k), "hits")
    spans = found.groupBy(*_KEYS).agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grown = lambda x, s: F.struct(F.greatest(x["end"], s["start"] + s["size"]).alias("end"), (x["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(x["end"], s["start"]))).alias("n"))
    covered = spans.select(*_KEYS, F.aggregate("spans", nothing, grown)["n"].alias("n_hit"))
    held = found.select(*_KEYS, "size", "gram").distinct().join(small(known), ["size", "gram"]).groupBy(*_KEYS).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    by_doc = stage(covered.join(held, _KEYS), "decontaminated")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(small(by_doc), _KEYS, "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    known = stage(item_windows(items, window), "item-windows")
    dirty = stage(hits(docs, items, known, window, k).select(*_KEYS).distinct(), "contaminated")
    named = {"id_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "text_key": F.xxhash64("text")}
    same = [named[c] == F.col(f"dirty.{c}") for c in _KEYS]
    return docs.join(small(dirty).alias("dirty"), same, "left_anti")
