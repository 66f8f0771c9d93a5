"""From raw documents to packed sequences, in stages of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelith.llm import line_dedup, near_copies, packing, quality, scratch, toxicity
from voxelith.llm.queries import read, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more for toxicity, by a model of the labelled rows among them.

    Null and empty texts stay; repeated rows go or stay alike; without labels only the words known beforehand count; an
    empty table stays empty. Returns the columns of ``docs``, whatever their names.
    """
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that fail the base rules or a learned rule of low quality.

    Null and empty texts fail; repeated rows go or stay alike; without labels the base rules alone hold; an empty table
    stays empty. Returns the columns of ``docs``, whatever their names.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with each line that is on three sources or more left in its lowest doc_id; texts that lost all lines go.

    Null texts stay null; a null source is no site; repeated rows are treated alike; an empty table stays empty. Returns
    the columns of ``docs``, n_chars following the text and others untouched, whatever their names.
    """
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lowest doc_id of each group of near copies: five-word shingles, Jaccard likeness of 0.8 or more, connected.

    Null and blank texts are one group; rows without a doc_id stay; repeated rows of the one that stays all stay; an empty
    table stays empty. Returns the columns of ``docs``, whatever their names.
    """
    return near_copies.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, cut and packed into sequences of at most 4096 tokens: a row for each piece, as ``packing.pack``.

    Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives an empty table.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line_dedup", spread_lines),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: No stage with a learned model can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again, and the one before deleted."""
    docs = read(spark, sf_dir, "documents")
    before: DataFrame | None = None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(spark, before)
        before = docs
    return docs
