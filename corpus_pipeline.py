"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns the columns of documents, but for the last, which returns packed pieces.
`run` writes each stage's result as Parquet to the shared folder and reads it again.

Null texts pass every stage as empty ones do and stay null; an empty table passes as
one; columns besides those of documents are dropped by `run` and ignored by the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, near, packing, quality, repeats, simhash, toxicity
from tesserae.llm._fit import held_out
from tesserae.llm._tables import read, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, model, COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id.

    SimHash takes the closest copies; of what stays, all of five-word Jaccard similarity 0.8 or more go.
    """
    return near.keep_first(docs, radius=simhash.RADIUS).select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur twice go from every document; whole characters stay whole."""
    cut = repeats.remove_repeats(docs, characters=True)
    text = F.when(~F.col("absent"), F.decode("kept", "UTF-8"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_items(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs, _ = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, fingerprints and a tokenizer's ids are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None
