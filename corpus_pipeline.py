"""A corpus from raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signet.llm import classifier, jaccard_join, mixing, packing, suffix_dedup
from signet.llm.common import Table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.fit(docs, labels).keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard indices of 0.8 or more one row: the smallest id, nulls last, and of rows that
    repeat id and text one. Texts without words link with nothing and stay."""
    found = jaccard_join.join(docs, keys=True).filter("n_shingles > 0")
    kept = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("m")).select("m.k").distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = docs.filter(worded).withColumn("k", jaccard_join.row_key("doc_id", "text")).join(kept, "k", "left_semi")
    return some.dropDuplicates(["k", "doc_id", "text"]).select(*COLUMNS).union(docs.filter(~worded).select(*COLUMNS))


def _decoded(kept: pd.Series) -> pd.Series:
    """Text of bytes; where a cut left part of a character, that part goes."""
    return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller ids have too; documents with nothing left go."""
    found = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    found = found.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    decoded = F.pandas_udf(_decoded, StringType())  # made here: a module must load without a session
    return found.withColumn("text", decoded("kept")).select(F.col("id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, packing.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier and the tokenizer can't be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = None
    for name, stage in STAGES[:-1]:
        table, last = Table(stage(spark, docs, sf_dir), f"stage-{name}"), table
        if last is not None:
            last.drop()
        docs = table.df
    return STAGES[-1][1](spark, docs, sf_dir)
