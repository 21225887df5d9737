"""From raw documents to encoded training text: quality, exact copies, near copies, source mixture, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read again as the next
stage's docs. All stages but the last return the columns of documents. Mixing takes a document of a source with
more than one epoch several times, so doc_id can repeat after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import drop_tables, kept_table, written
from threadloom.llm.exact_dedup import drop_exact_copies
from threadloom.llm.mixing import mixed_documents
from threadloom.llm.ngram_join import drop_near_copies
from threadloom.llm.pieces import encode_pieces
from threadloom.llm.quality import fit_quality, keep_quality

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, fit_quality(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a document comes once for each epoch that takes it."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as ids, with the scores of its best segmentations."""
    return encode_pieces(docs)


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("mixture", mixture), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. When a stage's table is written, all that it was made of goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = len(written)
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, written[mark:-1])
        del written[mark:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
