"""Record files, the polled set, the set of the seen, the calibrator that adds up, and repaired readers."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.models import histogram
from lumenframe.models.registry import calibrate
from lumenframe.sources import formats, sorted_set, tfrecord
from lumenframe.streaming import seen


def plain_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    texts = [b"", b"a", b"123456789", *(rng.randbytes(rng.randint(0, 300)) for _ in range(40))]
    assert plain_crc(b"123456789") == 0xE3069283  # the published check value
    want = [((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF for c in map(plain_crc, texts)]
    assert tfrecord.checksums(texts).tolist() == want and tfrecord.checksums([]).tolist() == []


def test_messages():
    row = {"label": (3, [-1, 0, 2**63 - 1, -(2**63), 300]), "value": (2, [0.5, -1.25]), "name": (1, [b"", b"\xff\x00", "é".encode()]), "none": (3, [])}
    assert tfrecord.decode(tfrecord.encode(row)) == row
    # An integer list that isn't packed, a field that isn't known, and the published bytes of a small message.
    assert tfrecord.encode({"a": (3, [1])}) == b"\x0a\x0c\x0a\x0a\x0a\x01a\x12\x05\x1a\x03\x0a\x01\x01"
    loose = b"\x0a\x0d\x0a\x0b\x0a\x01a\x12\x06\x1a\x04\x08\x05\x08\x07" + b"\x10\x01"
    assert tfrecord.decode(loose) == {"a": (3, [5, 7])}


SCHEMA = "label bigint, index array<bigint>, value array<float>, name string, raw binary, words array<string>, small int, wide double"


def test_records_go_round(spark, tmp_path):
    tfrecord.register(spark)
    rows = [(k, list(range(k % 4)), [x / 2 for x in range(k % 3)], f"é{k}", bytes([k % 256]), ["a", "", f"b{k}"], -k, k / 4) for k in range(2500)] + [(None, [], [], None, None, [], None, None)]
    df, path = spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/r"
    df.write.format("tfrecord").mode("append").option("path", path).save()
    again = spark.read.format("tfrecord").schema(SCHEMA).option("path", path).load()
    assert sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))
    assert again.select("label").agg(F.sum("label")).first()[0] == sum(range(2500))
    df.limit(5).coalesce(1).write.format("tfrecord").mode("overwrite").option("path", path).save()
    again = spark.read.format("tfrecord").schema(SCHEMA).option("path", path).load()  # files are listed by load()
    assert again.count() == 5 and not [f for f in (tmp_path / "r").iterdir() if f.name.startswith(".writing")]
    some = spark.read.format("tfrecord").schema("name string, missing int, none array<float>").option("path", path).load().collect()
    assert all(r.missing is None and r.none == [] for r in some)
    (tmp_path / "empty").mkdir()
    assert spark.read.format("tfrecord").option("path", f"file://{tmp_path}/empty").load().collect() == []


@pytest.mark.parametrize("harm", ["length", "message", "cut", "sum"])
def test_broken_files_are_refused(spark, tmp_path, harm):
    tfrecord.register(spark)
    spark.createDataFrame([(1, [1, 2], [0.5])], "label bigint, index array<bigint>, value array<float>").coalesce(1).write.format("tfrecord").mode("append").option("path", f"file://{tmp_path}/r").save()
    file = next(f for f in (tmp_path / "r").iterdir() if f.stat().st_size)
    data = bytearray(file.read_bytes())
    assert struct.unpack("<Q", data[:8])[0] == len(data) - 16
    if harm == "cut":
        data = data[:-3]
    else:
        data[{"length": 0, "message": 20, "sum": len(data) - 1}[harm]] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="ends within a record" if harm == "cut" else "checksum"):
        spark.read.format("tfrecord").option("path", f"file://{tmp_path}/r").load().collect()


def test_wrong_kinds_are_refused(spark, tmp_path):
    tfrecord.register(spark)
    path = f"file://{tmp_path}/r"
    spark.createDataFrame([(1, [1, 2], [0.5])], "label bigint, index array<bigint>, value array<float>").write.format("tfrecord").mode("append").option("path", path).save()
    for schema, why in (("label float", "another kind"), ("index bigint", "2 values"), ("label map<string,int>", "no feature")):
        with pytest.raises(Exception, match=why):
            spark.read.format("tfrecord").schema(schema).option("path", path).load().collect()


def plain_head(lines, size):
    held = {}
    for what, score, member in lines:
        held.pop(member, None)
        if what == "add":
            held[member] = score
    return sorted((s, m) for m, s in held.items())[:size]


def test_polls_replay_and_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    sorted_set.register(spark)
    folder, out, changes = f"file://{tmp_path}/set", str(tmp_path / "out"), []
    polls = {}

    def run(fail=False):
        def keep(batch, _):
            if fail:
                raise RuntimeError("lost")
            sorted_set.rows(batch, 7).write.mode("append").parquet(out)

        source = spark.readStream.format("sorted_set").option("path", folder).option("size", 7).option("parts", 3).load()
        source.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for k in range(4):
        own = [(rng.choice(["add", "add", "remove"]), rng.randint(0, 9) / 2, f"m{rng.randint(0, 20)}") for _ in range(15)]
        changes += own
        df = spark.createDataFrame([(n, *x, f"c-{k}") for n, x in enumerate(own)], "n int, what string, score double, member string, file string").repartition(3)
        sorted_set.append_changes(df, folder, "file", "n")
        if k == 1:  # a poll that is lost, and done again after more has come
            with pytest.raises(Exception, match="lost"):
                run(fail=True)
            polls["c-1"] = plain_head(changes, 7)
            continue
        polls[f"c-{k}"] = plain_head(changes, 7)
        run()
        run()  # nothing new
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.poll, []).append((r["rank"], r.score, r.member))
    assert {p: [x[1:] for x in sorted(v)] for p, v in got.items()} == polls
    assert sorted_set.head(folder, "c-1", 7) == polls["c-1"]
    (tmp_path / "set" / "c-9").write_text("add\tnan\tx\n")
    with pytest.raises(ValueError, match="c-9"):
        sorted_set.head(folder, "c-9", 7)


def plain_seen(keys, capacity):
    held, out = set(), []
    for k, key in enumerate(keys):
        if key not in held:
            out.append(k)
            held.add(key)
            if len(held) > capacity:
                held.clear()
    return out


@pytest.mark.parametrize("capacity", [1, 5, 1000])
def test_a_full_set_is_emptied(spark, tmp_path, capacity):
    """Two runs over two files: the state outlives the restart."""
    rng, kept = random.Random(capacity), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen.with_store(spark)
    keys = [rng.choice([None, *range(12)]) for _ in range(120)]
    try:
        for part in (0, 1):
            rows = [(k, keys[k]) for k in range(part * 60, part * 60 + 60)]
            spark.createDataFrame(rows, "n long, key long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema("n long, key long").parquet(str(tmp_path / "in"))
            passed = seen.unseen(source, "key", "n", capacity, 1)
            passed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["n", "key"] and sorted(r.n for r in got.collect()) == plain_seen(keys, capacity)
    with pytest.raises(ValueError, match="shards"):
        seen.unseen(spark.readStream.format("rate").load(), "value", "value", 3, 4)


def test_histograms_add_up(spark):
    rng = random.Random(5)
    rows = [(k, s := rng.choice([rng.random(), round(rng.random(), 1)]), int(rng.random() < s * s)) for k in range(900)] + [(900, None, 1), (901, 0.5, None), (902, float("nan"), 1), (903, -3.0, 0), (904, 7.0, 1)]
    df = spark.createDataFrame(rows, "k long, score double, label int").repartition(4)
    whole = histogram.Online(bins=40).add(df)
    parts = [histogram.Online(bins=40).add(df.filter(F.col("k") % 3 == k)) for k in range(3)]
    added = parts[0] + parts[1] + parts[2]
    assert (added.n == whole.n).all() and (added.positives == whole.positives).all() and whole.n.sum() == 903
    assert histogram.merged(*(histogram.histogram(df.filter(F.col("k") % 2 == k), "score", "label", bins=40) for k in (0, 1))).agg(F.sum("n")).first()[0] == 903
    shares = whole.shares()
    assert (np.diff(shares) >= 0).all() and 0 <= shares.min() and shares.max() <= 1
    # The isotonic fit of the bins, by Spark ML over one row for each.
    held = np.flatnonzero(whole.n)
    binned = [(float(b), 1) for b in held for _ in range(int(whole.positives[b]))] + [(float(b), 0) for b in held for _ in range(int(whole.n[b] - whole.positives[b]))]
    fitted = calibrate(spark.createDataFrame(binned, "score double, label int"), "score", "label", "isotonic")
    assert np.allclose(shares[held], np.interp(held, fitted.bounds, fitted.values))
    got = {r.k: r.score for r in whole.calibrator().apply(df, "score").collect()}
    at = lambda s: 39 if s != s else min(max(int(s * 40 // 1), 0), 39)
    assert got[900] is None and all(got[k] == pytest.approx(shares[at(s)]) for k, s, _ in rows if s is not None and k != 902 and abs(s * 40 - round(s * 40)) > 1e-9)
    assert set(histogram.Online(bins=4).shares()) == {0.5}
    with pytest.raises(ValueError, match="different bins"):
        histogram.Online(bins=4) + histogram.Online(bins=5)


def test_only_first_lines_are_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, lines in (("a", ["7 8", "1 2.5", "7 8", "0 1.5"]), ("b", ["", "7 8", "1 0.5"]), ("c", ["1 3.5"])):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    found = formats.read_instances(spark, str(tmp_path / "in"), kind="dense", header=True)
    assert sorted((r.label, *r.features) for r in found.df.collect()) == [(0.0, 1.5), (1.0, 0.5), (1.0, 2.5), (1.0, 3.5), (7.0, 8.0)]


def test_a_cache_knows_rewritten_files(spark, tmp_path):
    source, cache = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    calls = []

    def parse(session, path):
        calls.append(path)
        return session.read.text(path)

    of = lambda: sorted(r.value for r in formats.cached_parse(spark, str(source), cache, parse).collect())
    (source / "a").write_text("one\n")
    assert of() == of() == ["one"] and len(calls) == 1
    (source / "a").write_text("two!\n")
    assert of() == ["two!"] and len(calls) == 2
    (source / "b").write_text("three\n")
    assert of() == ["three", "two!"] and len(calls) == 3


def test_words_of_many_files_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    words = [f"w{k}" for k in range(400)]
    for k in range(4):
        (tmp_path / "in" / f"part-{k}").write_text("\n".join(" ".join(words[k * 100 + j : k * 100 + j + 10]) for j in range(0, 100, 10)) + "\n")
    assert [r.word for r in formats.read_words(spark, str(tmp_path / "in")).orderBy("pos").collect()] == words
