"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from augury.llm import exact_dedup, mixing, neardup, packing, quality
from augury.llm.common import scratch_table

#: The mix's tree. Sources with a number of 10 or more are curated, all others web crawls.
LEVELS = {"domain": "CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) >= 10 THEN 'curated' ELSE 'web' END", "lang": "lang", "source": "source"}
#: Target weights; languages and sources without one have equal parts of their parent's.
WEIGHTS = {("web",): 0.5, ("curated",): 0.5, ("web", "en"): 3.0, ("curated", "en"): 3.0}
#: Share of the tokens that enter the mix which the pipeline keeps, each document at most once.
SHARE = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, LEVELS, WEIGHTS, share=SHARE, epoch_col=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mix),
    ("packing", pack),
]
#: Links of near copies, budgets and packing are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
