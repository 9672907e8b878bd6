"""From raw documents to packed training sequences, in stages written to Parquet.

Quality rules reject documents, one document of each near-duplicate group stays, passages that an earlier document has
are cut, personal data is masked, and what remains is packed. Every stage works on all rows of the stage before.
"""

from pyspark.sql import DataFrame, SparkSession

from ionweave.llm import chosen_path, packing, pii, quality, suffixes
from ionweave.llm.store import stored
from ionweave.plans.registry import query


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail the base rule or diverge from every language reference."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group; rows without doc_id stay."""
    gone = chosen_path.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages of 50 words or more that an earlier document has."""
    return suffixes.without_repeats(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data by its kind."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of all documents into sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("private_data", private_data), ("packing", packed)]
#: Minimum hashes, trained labelers and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
