"""Text as features: cleaning, tokens, n-grams, padding, vocabularies and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Full-width forms of the printable ASCII characters, and the ideographic space.
_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def strip_html(c: Column) -> Column:
    """Each tag becomes a space."""
    return F.regexp_replace(c, "<[^>]*>", " ")


def normalise(c: Column) -> Column:
    """Half-width, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, _WIDE, _NARROW)), r"\s+", " "))


def truncate(c: Column, size: int = 100) -> Column:
    """The first `size` characters."""
    return F.substring(c, 1, size)


def clean_text(c: Column, size: int = 100) -> Column:
    return truncate(normalise(strip_html(c)), size)


def one_line(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def tokens(c: Column) -> Column:
    """Between white space, in lower case; none of null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "")


def ngrams(a: Column, n: int, skip: int = 0) -> Column:
    """Runs of n tokens with `skip` tokens left out between neighbours, joined by spaces. Shifted slices are zipped, so that the tokens
    are made once for each of the n places, not once for each run."""
    step = skip + 1
    size = F.greatest(F.size(a) - (n - 1) * step, F.lit(0))
    out = F.slice(a, 1, size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(a, 1 + k * step, size), lambda x, y: F.concat_ws(" ", x, y))
    return F.coalesce(out, F.array().cast("array<string>"))


def pad(a: Column, size: int, token: str) -> Column:
    """Exactly `size` tokens: cut, or filled up with `token`."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(token), size)), 1, size)


def title_vector(title: Column, size: int = 72) -> Column:
    """Tokens of the title, a mark, tokens of the normalised title, padded."""
    return pad(F.concat(tokens(title), F.array(F.lit("<tpad/>")), tokens(normalise(title))), size, "<tcpad/>")


def content_vector(content: Column, size: int = 102, chars: int = 100) -> Column:
    bare = truncate(strip_html(content), chars)
    return pad(F.concat(tokens(bare), F.array(F.lit("<cpad/>")), tokens(normalise(bare))), size, "<cepad/>")


#: What Spark itself encodes; other character sets go through Python's codecs, in Arrow batches.
_NATIVE = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def decoded(binary: Column, charset: str = "GBK") -> Column:
    """Text of bytes; what can't be decoded becomes a replacement character."""
    if charset.lower() in _NATIVE:
        return F.decode(binary, charset)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(v).decode(charset, "replace"))

    return run(binary)


def encoded(c: Column, charset: str = "GBK") -> Column:
    """Bytes of text; what the character set lacks becomes a question mark."""
    if charset.lower() in _NATIVE:
        return F.encode(c, charset)

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v.encode(charset, "replace") if isinstance(v, str) else None)

    return run(c)


def score_prefix(score: Column, threshold: Column, content: Column) -> Column:
    return F.format_string("[score:%s thre:%s]%s", score.cast("string"), threshold.cast("string"), content)


def tagged_prefix(parts: list[Column], content: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" ", *(p.cast("string") for p in parts)), F.lit("]"), content)


def time_of(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def vocabulary(df: DataFrame, text: str, size: int) -> DataFrame:
    """word, id, cnt: id 0 is UNK, which stands for all words beyond the size - 1 most frequent (ties by word), and has their count."""
    counts = word_counts(df, text)
    top = counts.orderBy(F.desc("cnt"), "word").limit(size - 1)
    ranked = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("cnt"), "word")).cast("int"))  # size - 1 rows
    known = ranked.select("word", "id", "cnt")
    rest = counts.agg(F.sum("cnt").alias("a")).crossJoin(known.agg(F.sum("cnt").alias("b"))).select(F.lit("UNK").alias("word"), F.lit(0).alias("id"), (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("long").alias("cnt"))
    return known.unionByName(rest)


def encode(df: DataFrame, key: str, words: str, vocab: DataFrame, offset: int = 0) -> DataFrame:
    """key, pos, word, id: ids of an array's words, plus the offset; unknown words have id 0 (plus the offset)."""
    long = df.select(F.col(key), F.posexplode(words).alias("pos", "word"))
    joined = long.join(vocab.filter("id > 0").select("word", "id"), "word", "left")
    return joined.select(key, "pos", "word", (F.coalesce("id", F.lit(0)) + offset).cast("int").alias("id"))


def id_lists(df: DataFrame, key: str, text: str, vocab: DataFrame, unknown: int = 0, keep: tuple[str, ...] = (), most: int = 32 << 20) -> DataFrame:
    """key, the columns to keep, and ids: those of a text's tokens, in their order, `unknown` for those that the vocabulary lacks; none of a null text. A
    vocabulary of up to `most` bytes is sent to the workers and texts stay where they are; else words are joined to it, and keys must
    tell rows apart."""
    known = vocab.filter("id > 0").select("word", F.col("id").cast("int").alias("id"))
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if 16 * n + size > most:
        ids = encode(df.select(key, tokens(F.col(text)).alias("words")), key, "words", vocab).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("ids"))
        ids = ids.select(key, F.transform("ids", lambda x: F.when(x["id"] > 0, x["id"]).otherwise(F.lit(unknown))).alias("ids"))
        return df.select(key, *keep).join(ids, key, "left").select(key, *keep, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    table = known.toArrow()  # of a checked size
    sent = df.sparkSession.sparkContext.broadcast((table["word"].combine_chunks(), table["id"].to_numpy()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = sent.value
        numbers = np.append(numbers, unknown).astype(np.int32)
        for batch in it:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                split = pc.ascii_split_whitespace(part.column(part.num_columns - 1))  # as \\s+ of tokens()
                found, ends = split.flatten(), split.offsets.to_numpy()
                some = pc.not_equal(found, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
                at = pc.index_in(found, value_set=words).fill_null(len(numbers) - 1).to_numpy()
                ends = np.r_[0, np.cumsum(some)][ends - ends[0]].astype(np.int32)
                yield pa.record_batch([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[at[some]]))], names=[key, *keep, "ids"])

    held = df.select(key, *keep)
    lower = df.select(key, *keep, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    return lower.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema) + ", ids array<int>")


def skipgrams(df: DataFrame, key: str, words: str, window: int) -> DataFrame:
    """key, pos, center, context: all pairs of words at most `window` positions apart in a text; nothing wraps round."""
    if window < 1:
        raise ValueError("the window must be 1 or more")
    a = F.col(words)

    def apart(d: int) -> list[Column]:
        """Pairs d positions apart, each word once as the center."""
        size = F.greatest(F.size(a) - d, F.lit(0))
        pairs = F.zip_with(F.slice(a, 1, size), F.slice(a, 1 + d, size), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        first = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["x"].alias("center"), p["y"].alias("context")))
        return [first, F.transform(pairs, lambda p, i: F.struct((i + d).alias("pos"), p["y"].alias("center"), p["x"].alias("context")))]

    parts = [part for d in range(1, window + 1) for part in apart(d)]
    return df.select(F.col(key), F.explode(F.concat(*parts)).alias("p")).select(key, "p.pos", "p.center", "p.context")


def skipgram_counts(df: DataFrame, words: str, window: int) -> DataFrame:
    """center, context, n: how often skipgrams() has each pair. Pairs are symmetric, so each is made once, with the lower word first, and
    turned round when all are counted. Tasks count the pairs of some millions of words, deal them out by hash, and write what goes to a
    bucket in one piece: its words once, and the pairs by their numbers, sorted and compressed. So a pair takes a few bytes of the one
    shuffle, not two texts. A bucket's different pairs are held by one task: set spark.sql.shuffle.partitions to fit."""
    if window < 1:
        raise ValueError("the window must be 1 or more")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    pieces = df.select(F.col(words).cast("array<string>").alias("words")).mapInArrow(_pieces(window, parts), "bucket int, piece binary")
    return pieces.repartitionById(parts, "bucket").mapInArrow(_summed, "center string, context string, n bigint")


_WORDS = 2_000_000  # of which a task counts the pairs at once
_OUT = 200_000


def _pieces(window: int, parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(0)
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy())]
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + _WORDS, "right")) - 1)
                yield from _pieces_of(texts.slice(low, high - low), np.diff(ends[low : high + 1]), window, parts)
                low = high

    return run


def _pieces_of(texts: pa.ListArray, sizes: np.ndarray, window: int, parts: int) -> Iterator[pa.RecordBatch]:
    found = texts.flatten().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(found.dictionary, null_placement="at_start")
    known = found.dictionary.take(order)
    rank = np.empty(len(known), np.int64)
    rank[order.to_numpy()] = np.arange(len(known))
    x, row = rank[found.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
    codes = [np.empty(0, np.int64)]
    for d in range(1, min(window, max(0, len(x) - 1)) + 1):
        near = row[:-d] == row[d:]
        a, b = x[:-d][near], x[d:][near]
        codes.append(np.minimum(a, b) * len(known) + np.maximum(a, b))
    code, times = np.unique(np.concatenate(codes), return_counts=True)
    if not len(code):
        return
    lower, higher = np.divmod(code, len(known))
    sign = pd.util.hash_array(np.array([x or "" for x in known.to_pylist()], dtype=object), categorize=False)  # the same in every task
    sign[: known.null_count] = 1
    mixed = (sign[lower] * np.uint64(0x9E3779B97F4A7C15) + sign[higher]) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(bucket, minlength=parts))]
    for k in np.flatnonzero(np.diff(ends)).tolist():
        at = order[ends[k] : ends[k + 1]]
        used, local = np.unique(np.concatenate([lower[at], higher[at]]), return_inverse=True)
        low, high = local[: len(at)], local[len(at) :]
        texts = known.take(pa.array(used))
        _, starts, letters = texts.buffers()  # as taken: from their beginning
        starts = np.frombuffer(starts, np.int32)[: len(texts) + 1]
        letters = np.frombuffer(letters or b"", np.uint8)[: starts[-1]]
        sizes = np.where(texts.is_null().to_numpy(zero_copy_only=False), -1, np.diff(starts))
        columns = [letters, *map(_planes, (sizes, np.diff(low, prepend=0), high, times[at]))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]
        sink, piece = pa.BufferOutputStream(), pa.record_batch(lists, names=["letters", "sizes", "step", "high", "times"])
        with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as out:
            out.write_batch(piece)
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "piece"])


def _planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of 32-bit numbers, then the second ones, and so on, which compress better apart."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return planes.reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)


def _summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of the pieces in a partition, which holds all of a bucket's."""
    held: list[list] = [[], [], [], []]
    before = 0
    for batch in it:
        for piece in batch.column(1):
            found = pa.ipc.open_stream(piece.as_buffer()).read_next_batch()
            letters, *planes = (c.flatten().to_numpy() for c in found.columns)
            sizes, step, high, times = map(_numbers, planes)
            ends = np.r_[0, np.cumsum(np.maximum(sizes, 0))].astype(np.int32)
            words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters), pa.py_buffer(np.packbits(sizes >= 0, bitorder="little")))
            for own, value in zip(held, (words, np.cumsum(step) + before, high + before, times), strict=True):
                own.append(value)
            before += len(words)
    if not held[0]:
        return
    found = pa.concat_arrays(held[0]).dictionary_encode(null_encoding="encode")
    at, known = found.indices.to_numpy().astype(np.int64), found.dictionary
    code, times = at[np.concatenate(held[1])] * len(known) + at[np.concatenate(held[2])], np.concatenate(held[3])
    held.clear()
    order = np.argsort(code)
    code, times = code[order], times[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    low, high = np.divmod(code[first], len(known))
    times = np.add.reduceat(times, first)
    for k in range(0, len(low), _OUT):
        a, b, n = low[k : k + _OUT], high[k : k + _OUT], times[k : k + _OUT]
        two = a != b
        center, context = (known.take(pa.array(np.concatenate(v))) for v in ((a, b[two]), (b, a[two])))
        yield pa.record_batch([center, context, pa.array(np.concatenate([np.where(two, n, 2 * n), n[two]]))], names=["center", "context", "n"])


def skipgram_samples(df: DataFrame, key: str, words: str, window: int, num_skips: int, seed: int = 0) -> DataFrame:
    """skipgrams, of which each center keeps num_skips contexts, drawn by hash."""
    if num_skips > 2 * window:
        raise ValueError("num_skips must be at most 2 * window")
    pairs = skipgrams(df, key, words, window).withColumn("__draw", F.xxhash64(key, "pos", "context", F.lit(seed)))
    return pairs.withColumn("__place", F.row_number().over(Window.partitionBy(key, "pos").orderBy("__draw", "context"))).filter(F.col("__place") <= num_skips).drop("__place", "__draw")
