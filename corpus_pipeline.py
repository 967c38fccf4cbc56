"""From documents to packed training sequences: toxic documents go, one of each group of near copies stays, documents that hold
benchmark passages go, personal data is replaced by tags, and what is left is tokenised and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.

Defined results: null and empty texts have the toxicity of texts without known words, which goes by the share of toxic ones among labelled
texts of that kind; they are near copies of nothing, hold no passage, pass redaction unchanged and are packed as the separator alone. A null doc_id is
kept and stays null. Rows that repeat an id and text get one decision each in the toxicity, decontamination and packing stages; the
near-duplicate stage decides by id, so rows of one id stay or go together. Columns beyond doc_id and text, nulls in them included, pass
through whatever their names, until packing, which reads these two alone. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, neardup, packing, pii, toxicity
from lumenframe.llm.common import stage, table

#: Documents that score this or more are toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    given, name = {c.lower() for c in docs.columns}, "_toxicity"
    while name in given or f"{name}_evidence" in given:
        name += "_"
    scored = toxicity.score(docs, toxicity.fit(docs, labels), (name, f"{name}_evidence"))
    return scored.filter(F.col(name) < TOXIC).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redacted(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(redacted.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Tokenising and packing, among others, can't be told in SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all stages over the documents of sf_dir, each stage written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
