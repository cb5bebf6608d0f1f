"""A training-data pipeline over ``documents``: each stage works on all that the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next one's docs. All but the last return the columns of
documents.

1. language_id: documents go whose language can't be told: those without a
   letter, and those alike to no language.
2. line_dedup: lines of templates that recur across documents go from all
   documents but the first; documents stay.
3. near_dedup: one document of each class of near duplicates stays.
4. decontamination: documents that cover half or more of a benchmark item go.
5. packing: what is left becomes sequences of 2048 tokens.

SQL can express neither the random vectors of the first stage nor the
sampling of the third, so there is no ORACLE_SQL; tests compare the stages
with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proxigraph.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from proxigraph.llm.common import small_batches, table, through_files


#: Pre-tokens that a worker keeps for packing: fewer than op6 keeps, as the memory of all stages adds up in a worker.
PACKING_MEMO = 60_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return line_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.distinct_documents(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.digest(docs, PACKING_MEMO)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = through_files(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
