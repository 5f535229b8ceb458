"""The training-data pipeline: documents to packed token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockflow.llm.common import reach_workers, store
from stockflow.llm.decontaminate import remove_contaminated
from stockflow.llm.mixing import mix_sources, source_rates
from stockflow.llm.near_dup import drop_near_duplicates
from stockflow.llm.packing import pack_tokens
from stockflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score under 0.7). Null and
    empty texts stay; without labels every document does."""
    reach_workers(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5 words, 0.8), of equal
    rows one. Null and empty texts and rows with a null id stay."""
    reach_workers(spark)
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item. Null and empty
    texts stay, and without items every document does."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson draws: shares of sources grow as the
    square root of their sizes, and the whole keeps its size. A null source is
    a source; rows of one id and source are repeated alike."""
    return mix_sources(docs, source_rates(docs, temperature=0.5)).drop("copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in rows of 2048. Null and empty texts have none."""
    reach_workers(spark)
    return pack_tokens(docs, capacity=2048)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("packing", packing)]

# The classifier, the sketches and the tokenizer have no SQL form; the stages are
# held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. An empty table passes through all of them; texts
    of any length are read whole; further columns are kept up to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
