"""Training-data pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of `documents`. Stages are written as Parquet and read again in between.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladetally.llm import mixing, packing, queries, secret_scan, set_join, site_quality
from cladetally.session import remove, shared_dir, stored_tables

QUALITY_LEAST = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, by their own and their site's evidence, is at least one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality.keep(docs, labels, QUALITY_LEAST)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return set_join.keep_first(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    paths = docs.select(F.col("source").alias("path"), "text")
    model = secret_scan.train(secret_scan.label_by_rule(paths), paths)
    clean = secret_scan.redact(docs, model)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each time words of them are taken, with those words."""
    _, _, pieces = mixing.mix(docs)
    return mixing.render(docs, pieces).select(*docs.columns)


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, packed into sequences."""
    return packing.pack(packing.tokenize_pieces(docs, queries.ranks_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("packing", vector_packing),
]

# A classifier, a forest and a tokenizer are not stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage stores goes when its output is written, and that when the next one's
    is; the last output stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    try:
        for number, (_, stage) in enumerate(STAGES):
            path = f"{folder}/{number}"
            with stored_tables(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if number:
                remove(spark, f"{folder}/{number - 1}")
    except Exception:
        remove(spark, folder)
        raise
    return docs
