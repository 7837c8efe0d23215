"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

All but the last keep the columns of ``docs``, whatever they are called, and their order. Texts of any length are
read whole, and no rows in give no rows out. What each does with nulls, empty texts, repeated rows and ties it says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright import shipping
from tidewright.llm import decontam, linededup, neardup, packing, toxicity
from tidewright.llm.common import held_out, load, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the rest go. What is learned comes from the labels of documents that are still there.

    A score that equals the threshold goes. Null and empty texts, which match nothing, stay. Repeated rows and rows
    without doc_id are judged one by one, by their texts alone; a doc_id without a label teaches nothing.
    """
    model = toxicity.train(docs, load(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out("doc_id", 4, 2)))
    return toxicity.clean(docs, model)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated chunks of lines taken out of their texts; n_chars follows the text.

    No row goes: a text of which nothing is left is empty. Null and empty texts and rows without doc_id stay as they
    are; a null n_chars stays null. Of equal chunks that of the smallest (doc_id, hash of the text, offset) stays, and
    rows that repeat a doc_id and its text lose the same.
    """
    from pyspark.sql import functions as F

    return linededup.line_dedup(docs).drop("removed_chunks").withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null, empty and blank texts are like nothing and stay, and so do rows without doc_id. Rows that repeat a kept
    doc_id all stay, those of one that goes all go.
    """
    return neardup.one_of_each(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Items that are null, blank or without item_id match nothing. Null and empty texts and rows without doc_id stay;
    of rows that repeat a doc_id all go if one holds an item.
    """
    return decontam.decontaminated(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens.

    A null or empty text is one piece, the id 0 alone. Every row is packed, repeated ones and those without doc_id too.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", shipping(stage_toxicity)),
    ("line_dedup", shipping(stage_line_dedup)),
    ("near_dedup", shipping(stage_near_dedup)),
    ("decontamination", shipping(stage_decontamination)),
    ("packing", shipping(stage_packing)),
]

#: Learned models, rolling hashes and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{place}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
