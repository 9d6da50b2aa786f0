"""A corpus pipeline: documents of good quality, without repeated lines, near copies and benchmark passages, as pieces."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.dialect import strip
from loomsift.llm import classify, decontaminate, forest, lines, pieces
from loomsift.llm.common import kept_columns, stored
from loomsift.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the folder, does not reject; each row by itself, with a null id or text too."""
    return classify.good_documents(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; one of which nothing but white space is left goes, one that was blank before stays."""
    found = lines.drop_repeated_lines(docs, carry=True)
    left = found.filter((F.col("n_removed") == 0) | (strip(F.col("text")) != ""))
    same = kept_columns(left, docs)
    if "n_chars" in docs.columns:
        same = same.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows with equal or null ids are documents of their own, blank ones have no copies."""
    return forest.first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; documents without words, and all of them if the benchmark is empty."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, ids, score, lossless, scores, others)``: the best segmentation, little-endian 32-bit ids, and whether it decodes to the text; and the scores of the best three and the ids of the second and third."""
    coded = pieces.encode(docs)
    return coded.select("doc_id", "n_pieces", "ids", F.col("scores")[0].alias("score"), "lossless", "scores", "others")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_ids", piece_ids),
]

#: A trained classifier and piece lattices are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written to the shared folder and read by the next; no documents give no rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
