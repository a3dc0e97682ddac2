"""From raw documents to encoded training text: the stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlens.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from gridlens.llm.queries import tokenizer_path
from gridlens.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; the rules are learned from ``labels``."""
    rules = quality_rules.learn_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.apply_rules(docs, rules).where("kept").select(*docs.columns)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; documents that had no other line go."""
    left = line_dedup.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 80 % common shingles."""
    return ngram_join.one_of_each_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; parts of a document count by halves and up."""
    plan = mixing.mix_sources(docs)
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    copies = F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")
    return plan.select(*docs.columns, copies).drop("_copy")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix."""
    return bpe.coded(docs.select("doc_id", "text"), tokenizer_path(), digests=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_repeats),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: Learned rules and the tokenizer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        if number:
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
