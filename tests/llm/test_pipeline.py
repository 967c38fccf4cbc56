"""run() against the stages' brute-force versions, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import packing, pii
from lumenframe.llm.common import stage

from .test_copies import groups
from .test_decontaminate import brute


def test_each_stage_takes_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = docs.collect()
        after = step(spark, docs, sf)
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns, name
        ids = [r.doc_id for r in rows]
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
            assert len(set(ids)) == len(ids) and len(set(clean) & set(ids)) >= 0.97 * len(clean)
        elif name == "near_duplicates":
            want = groups([(r.doc_id, r.text) for r in before], 5)
            assert sorted(ids) == sorted(i for i, (_, c) in want.items() if c == i)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert sorted(ids) == sorted(x[0] for x in brute([(r.doc_id, r.text) for r in before], items) if not x[4])
        elif name == "personal_data":
            assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {r.doc_id: ((t := pii.redact(r.text, pii.find(r.text))), len(t)) for r in before}
        else:
            tokens = {r.doc_id: len(packing.encode(r.text)) + 1 for r in before}
            assert {d: sum(r.length for r in rows if r.doc_id == d) for d in tokens} == tokens
        docs = spark.createDataFrame(rows, after.schema)


CLASHES = ["gone", "_toxicity", "_toxicity_evidence", "id_key", "text_key", "pii", "rep", "family", "label", "copies"]


def folder(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_through_every_stage(spark, odd, odd_rows, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with those used inside."""
    texts = {r[0]: r[1] for r in odd_rows}
    labels = [(k, None, int(k % 3 == 0)) for k in list(texts)[15:30]] + [(3, 1, None), (None, 1, 1)]
    items = [(1, " ".join(texts[9].split()[31:45])), (2, None), (None, "ab cd"), (3, "")]
    docs = odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    sf = folder(spark, tmp_path, docs, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = step(spark, docs, sf)
        rows = after.collect()
        assert after.columns == names and after.dtypes == docs.dtypes, name
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES), name
        assert sum(r.text is None for r in rows) == sum(r.text is None for r in before), name
        if name == "near_duplicates":
            want = groups([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5)
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(r.doc_id for r in before if r.doc_id is not None and want[r.doc_id][1] == r.doc_id)
        elif name == "decontamination":
            assert sorted(map(str, rows)) == sorted(str(r) for r in before if not brute([(r.doc_id, r.text)], items)[0][4])
        elif name == "personal_data":
            assert sorted((r.text or "") for r in rows) == sorted((pii.redact(r.text, pii.find(r.text)) or "") for r in before)
        docs = spark.createDataFrame(rows, after.schema)
    left = docs.collect()
    packed = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in packed) == sum(len(packing.encode(r.text or "")) + 1 for r in left)


def test_run_of_an_empty_table(spark, none, tmp_path):
    sf = folder(spark, tmp_path, none, [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), "test")
    told = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    got = corpus_pipeline.run(spark, sf)
    assert told(got) == told(docs) and max(r[0] for r in got.groupBy("sequence_id").agg(F.sum("length")).select("sum(length)").collect()) <= 2048
