"""From raw documents to packed training sequences: STAGES, each written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenfield.llm import common, decontaminate, lines, ordinal, packing, similar

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return ordinal.quality(docs, common.table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document that loses all its lines goes. n_chars follows the text."""
    out = lines.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts at a 5-word Jaccard similarity of 0.8 or more stays: that of the smallest doc_id; rows of a null one count like others.

    SimHash fingerprints in a covering code give the pairs, which are verified; an exact way finds the links that fingerprints leave.
    """
    return similar.firsts(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go, each row by its own text, also of a null or repeated doc_id."""
    rows = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return rows.where("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, and the sequence and offset that each has."""
    return packing.packed(packing.tokenized(docs, numbered=True))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("best-fit packing", pack)]

#: The classifier, fingerprints and tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
