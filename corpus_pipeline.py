"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, each with
the values that it had but text and n_chars, which line dedup changes, whatever names the operators use for columns of
their own. A stage works on all that its predecessor kept.

Null texts are never toxic, hold no lines and no benchmark item, are near nothing, and encode to null; so are empty ones,
which encode to no ids. Rows of a null doc_id are never dropped as copies and lose no line. Rows that repeat a doc_id are
one document: near duplicates go or stay together, and lines go from each of them. Of equal lines and of near duplicates
the one of smallest doc_id stays. Very long texts are whole texts like others. Empty tables pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import common, decontaminate, lines, minhash, pieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it is fitted on labelled ones among docs."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return common.beside(docs, lambda d: toxicity.score(d, model).where("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less lines that repeat an earlier one; those with nothing left go."""
    out = common.beside(docs, lambda d: lines.dedup_lines(d).where("n_removed = 0 or trim(text) <> ''"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest doc_id."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of each document."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.saved(docs)
    return docs
