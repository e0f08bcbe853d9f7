"""A training corpus from raw documents, stage by stage; each stage works on all that the one before kept.

Decisions are taken row by row, so that rows which share a doc_id, or have none, are judged by their own texts: a rejected
row takes no other with it, and a row without doc_id is rejected like any other. Null and empty texts are neither toxic nor
contaminated nor copies of one another; the last stage packs their end tokens. Repeated rows are near duplicates, of which one stays.
Texts of any length are judged whole. Of rows that tie (one doc_id, or none, in a group of
copies) the one that was read first stays. Further columns of ``documents`` are left out whatever their names; an empty table gives no rows; labels and benchmark may
be empty, which rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.llm.shared import fresh_path, remove, settle, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't toxic."""
    from marketgrain.llm import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels), carry=COLUMNS[1:]).where("not toxic").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id, of several rows with it the first."""
    from marketgrain.llm import neardups

    return neardups.near_duplicates(docs, carry=COLUMNS[1:]).where("first").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur earlier in the corpus."""
    from marketgrain.llm import substrings

    cleaned = substrings.remove_repeats(docs, carry=("lang", "source")).withColumnRenamed("kept_text", "text")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items make up less than the contaminated share."""
    from marketgrain.llm import decontaminate

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items, carry=COLUMNS[1:]).where("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the kept documents with its sequence and place."""
    import public_tokenizers

    from marketgrain.llm import packing

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", pack)]

#: SQL can express neither the regression nor the tokenizer; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again as the next one's input. What it wrote on the
    way is deleted, and a stage's rows are once the next one's are there: the last stage's rows are left."""

    def stages() -> DataFrame:
        docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
        for name, stage in STAGES[:-1]:
            path = fresh_path(spark, name)
            docs = settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), path)
            if before is not None:
                remove(spark, before)
            before = path
        return STAGES[-1][1](spark, docs, sf_dir)

    return settled(spark, stages, "pipeline")
