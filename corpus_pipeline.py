"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. Between stages the documents
are written as Parquet to the shared folder, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kawara.llm import minhash, packing, quality, substrings, toxicity
from kawara.llm.common import keyed, table, without_ids, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each near-duplicate class. Rows that share a doc_id count one by one."""
    rows = keyed(docs)
    if rows is None:
        others = minhash.classes(docs).where("doc_id <> class_id").select("doc_id")
        return without_ids(docs, written(others, "others"))
    found = minhash.classes(rows.select(F.col("row_key").alias("doc_id"), "text"))
    others = found.where("doc_id <> class_id").select(F.col("doc_id").alias("row_key"))
    return without_ids(rows, written(others, "others"), "row_key").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of earlier ones. Of rows that share a doc_id, each counts as a document."""
    rows = keyed(docs)
    if rows is None:
        return substrings.cut(docs)
    cut = substrings.cut(rows.withColumnsRenamed({"doc_id": "own_id", "row_key": "doc_id"}))
    return cut.drop("doc_id").withColumnRenamed("own_id", "doc_id").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("packing", pack_sequences),
]

#: Signatures, learned weights and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
