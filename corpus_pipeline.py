"""A training-data pipeline over documents, in stages that each write a table for the next.

Toxic documents go, one document of each near-duplicate class stays, documents with a benchmark item go, secrets
are replaced in the texts that stay, and what is left is encoded by byte-level BPE and decoded again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.bpe import digests, vocabulary_path
from tapeline.llm.decontamination import leaks
from tapeline.llm.jaccard_join import jaccard_classes
from tapeline.llm.secrets_scan import fit_forest, redacted
from tapeline.llm.shared import held_out, scratch
from tapeline.llm.toxicity import toxicity_scorer, with_toxicity
from tapeline.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of an Arrow batch of the join, whose rows are pairs of whole sets.
BATCH = "8m"


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of this size for the jobs within; a longer row is a batch by itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is below a half, by a model of the labelled ones outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity_scorer(docs, labels, train=~held_out(5, 0))
    return with_toxicity(docs.select(COLUMNS), scorer).where("toxicity < 0.5").select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and `key`, 64 bits of doc_id and text, null or not: rows equal in both have the same, other rows not."""
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("key"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts, that of smallest doc_id, of several of that doc_id the one of
    smallest key; rows equal in doc_id and text are one. A document without doc_id stays if no other of its class has
    one, and texts without words are classes of their own."""
    rows = keyed(docs)
    with batches_of(spark, BATCH):
        classes = jaccard_classes(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    heads = classes.distinct().join(rows.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(first.alias("first"))
    return rows.join(heads.select(F.col("first.key").alias("key")), "key", "left_semi").select(COLUMNS).dropDuplicates(["doc_id", "text"])


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item, decided for each text by itself."""
    rows = keyed(docs)
    found = leaks(rows.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    clean = redacted(docs.select(COLUMNS), fit_forest(spark), path_column="source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoded_and_decoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", not_leaked),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", encoded_and_decoded),
]

#: SQL can express neither the models nor the alignments and encodings; tests hold each stage against brute force on
#: small rows, some without doc_id or with a repeated one, the two models by their scores of each text alone.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's table in the shared folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
