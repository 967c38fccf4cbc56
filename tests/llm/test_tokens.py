"""Encoding by chunks, alignment and phrases against plain versions over whole texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import alignment, lookup, phrases, pieces, queries


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def bpe():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


PARTS = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "▁", "▁▁", "a", "The", "word", "don't", "I'll", "'", "''", "'s", "é", "ſ", "Ünï", "ß", "中文", "Ω", "ο", "🙂", " ", " ", "　", "\x1c", "\x00", "\x85", "1", "23", "4567", ".", "...", ",", "!?", "(", ")", "-", "_", "/", "%%%", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "é", "²", "٣", "हिन्दी", "x" * 70, "�", "﻿", "؟"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return ["", " ", "  ", "▁", " ▁", "\n", *PARTS, *(f"{p} " for p in PARTS), *made]


def test_chunks_have_the_ids_of_whole_texts(sp):
    pattern = pieces.cuts(None)
    for text in odd_texts(6000):
        chunks = pieces.chunks_of(text, pattern)
        assert "".join(chunks) == (" " + text if text else "")
        assert [k for c in chunks for k in pieces._marked(sp, c)] == sp.encode(text), repr(text)


def whole(sp, text):
    ids = sp.encode(text or "")
    return ids, sp.decode(ids)


@pytest.mark.parametrize("most", [96 << 20, 2000, 0])
def test_encode_decode(spark, sp, odd, odd_rows, none, most):
    """With the whole table in the workers, a part of it, and none of it."""
    rows = [(k if k % 9 else None, t, f"x{k}", k) for k, t in enumerate([None, *odd_texts(150), "copy of a row", "copy of a row"])]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, IDS string, decoded long").repartition(4)
    got = pieces.encode_decode(df, most_bytes=most)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id or -1, r.text or "", r["ids"], r.decoded) for r in got.collect()) == sorted((i or -1, t or "", *whole(sp, t)) for i, t, *_ in [*rows, rows[-1]])
    more = pieces.encode_decode(odd, most_bytes=most)
    assert more.columns == [*odd.columns, "ids", "decoded"] and sorted(repr(tuple(r)) for r in more.collect()) == sorted(repr((*x, *whole(sp, x[1]))) for x in odd_rows)
    assert pieces.encode_decode(none, most_bytes=most).count() == 0


def test_the_query_of_pieces(spark, sf, sp):
    got = {tuple(r) for r in queries.op11_sentencepiece(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, text = whole(sp, r.text)
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want


def plain_alignment(docs, bpe, sp):
    """Over whole texts: offsets in bytes, groups, and counts of documents by id pair."""
    letters = alignment._byte_values()
    out, held = [], Counter()
    for doc, text in docs:
        groups = []
        if text:
            a, b = bpe.encode(" " + text, add_special_tokens=False), sp.encode(text)
            a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
            b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, sp.id_to_piece(k)) for k in b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                at_a, at_b = {0: 0}, {0: 0}
                for ends, parts in ((at_a, a_bytes), (at_b, b_bytes)):
                    at = 0
                    for k, x in enumerate(parts):
                        at += len(x)
                        ends[at] = k + 1
                both = sorted(at_a.keys() & at_b.keys())
                groups = [(a.ids[at_a[x] : at_a[y]], b[at_b[x] : at_b[y]]) for x, y in zip(both, both[1:], strict=False)]
        out.append((doc, groups))
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    rows = []
    for doc, groups in out:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        told = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        rows.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    return sorted(rows, key=repr)


def aligned(df, **more):
    found = alignment.align(df, **more)
    return sorted((tuple(r) for r in found.select(*found.columns[:-1], F.coalesce(F.sha2("groups", 256), F.lit(""))).collect()), key=repr)


@pytest.mark.parametrize("most", [64 << 20, 1500, 0])
def test_alignment(spark, bpe, sp, odd, odd_rows, none, most):
    docs = list(enumerate([None, *odd_texts(400, 2)]))
    docs += [docs[-1], (None, "no id's text here"), (7, "another text of an id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_a string").repartition(4)
    assert aligned(df, most_bytes=most) == plain_alignment(docs, bpe, sp)
    assert aligned(odd, most_bytes=most) == plain_alignment([(x[0], x[1]) for x in odd_rows], bpe, sp)
    assert aligned(none, most_bytes=most) == []


def test_chunks_have_the_groups_of_whole_texts(bpe, sp):
    aligner = alignment.Aligner()
    assert aligner.cut
    for text in odd_texts(6000, 3):
        chunks = aligner.chunks(text)
        assert "".join(chunks) == " " + text
        assert [k for c in chunks for k in bpe.encode(c, add_special_tokens=False).ids] == bpe.encode(" " + text, add_special_tokens=False).ids, repr(text)
        if "▁" not in text and text:
            assert [k for c in chunks for k in aligner._b(c)] == sp.encode(text), repr(text)


def test_the_query_of_alignment(spark, sf, bpe, sp):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, sf).collect()), key=repr) == plain_alignment(docs, bpe, sp)


def plain_phrases(docs, longest, least, share, top):
    f = defaultdict(Counter)
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, runs in f.items():
        n, rows = sum(v for x, v in runs.items() if len(x) == 1), []
        many = {x: v for x, v in runs.items() if len(x) > 1 and v >= least}
        held = Counter()
        for x, v in many.items():
            for k in range(2, len(x)):
                for i in range(len(x) - k + 1):
                    held[x[i : i + k]] = max(held[x[i : i + k]], v)
        for x, a in many.items():
            score, k = min((1_000_000 * a * a // (runs[x[:k]] * runs[x[k:]]), k) for k in range(1, len(x)))
            if 100 * held[x] < share * a:
                rows.append((-score, -a, " ".join(x).encode(), runs[x[:k]], runs[x[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "top"), [(3, 30), (4, None), (2, 1000)])
def test_phrases(spark, odd, odd_rows, none, longest, top, monkeypatch):
    rng = random.Random(7)
    words = ["a", "B", "cc", "É", "é", "d'e", "(f)", "x y", "ſ", "🙂", "\x00"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", "", "und", None])) for _ in range(300)]
    docs += [docs[0]] * 20 + [(None, "en"), ("", "xx"), ("one two three " * 3000, "long")]
    df = spark.createDataFrame([(t, g, "1") for t, g in docs], "text string, lang string, n string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, longest, 5, 50, top, slices=3).collect())
    assert got == plain_phrases(docs, longest, 5, 50, top) and got
    monkeypatch.setattr(phrases, "MOST_BYTES", 500)
    assert sorted(tuple(r) for r in phrases.collocations(odd, longest, 2, 50, top, memory="64MB").collect()) == plain_phrases([(x[1], x[2]) for x in odd_rows], longest, 2, 50, top)
    assert phrases.collocations(none, longest).count() == 0


def test_a_hash_that_two_strings_share_is_left_to_the_join(spark, monkeypatch):
    table = spark.createDataFrame([("a", [1, 2], 5), ("b", [], 3), ("c", [7], 3), ("d", [4], 1)], "k string, v array<int>, n long")
    head, tail = lookup.split(table, "k", "v", "n", 10_000, 4)
    found = lookup.packed(head, int)
    assert tail is None and [None if (x := found.get(k)) is None else x.tolist() for k in "abcde"] == [[1, 2], [], [7], [4], None]
    head, tail = lookup.split(table, "k", "v", "n", 60, 4)
    assert sorted(r.k for r in tail.collect()) == ["d"] and lookup.packed(head, int).get("d") is None
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    head, tail = lookup.split(table, "k", "v", "n", 10_000, 4)
    assert head.count() == 0 and tail.count() == 4
