"""The corpus pipeline: each stage takes what the one before it kept.

1. ``quality``: documents that the co-trained classifier rejects go.
2. ``near_duplicates``: of each group of near copies (five-word shingles, similarity 0.8) the document
   with the smallest doc_id stays.
3. ``repeated_passages``: passages of 50 bytes and more that an earlier document holds are cut out;
   a document of which nothing is left but white space goes.
4. ``mix``: documents are drawn with probabilities that bring the mix to the target weights.
5. ``tokens``: the texts become SentencePiece ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bucket_refinement import remove_repeats
from parlance.llm.cotraining import keep_good
from parlance.llm.minhash_hamming import near_duplicates
from parlance.llm.raking import mix
from parlance.llm.session import prepare, release, settle
from parlance.llm.wfst import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a doc_id stay, and so do rows of a doc_id that stays; rows equal in all columns are one."""
    gone = settle(near_duplicates(docs, similarity=0.8).where(~F.col("kept")).select("doc_id").distinct())
    release(spark)
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(docs.columns).dropDuplicates()
    return named.unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs, text=True)
    some = cut.where(r"text RLIKE '[^\\x20\\x09-\\x0D]'")
    return some.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("sampled").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", first_of_group),
    ("repeated_passages", repeated_passages),
    ("mix", mixed),
    ("tokens", tokens),
]
#: No SQL: the classifier's fit and the tokens can't be expressed; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others kept is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{prepare(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
