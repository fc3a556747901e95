"""A corpus pipeline over documents: each stage is one operator and works on all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm import jaccard_join, mixing, quality_rules, sentence_pieces, substring_dedup
from sitemill.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (then the smallest hash of its text); of rows with
    one doc_id and text, one. Texts that share a doc_id are judged each by itself; documents without a doc_id or without words stay."""
    keyed = docs.withColumn("_mark", F.xxhash64("text")).withColumn("_key", F.xxhash64("doc_id", "text"))
    named = keyed.where("doc_id IS NOT NULL")
    found = jaccard_join.jaccard_components(named.select(F.col("_key").alias("doc_id"), "text")).where("n_shingles > 0")
    places = named.select("_key", F.struct("doc_id", "_mark").alias("place")).distinct()
    groups = cut_lineage(found.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(places, "_key"))
    first = groups.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = groups.join(first, "component_id").where("place <> first").select("_key")
    left = named.join(gone, "_key", "left_anti")
    # of rows alike in both, which one stays follows from their other columns
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = left.groupBy("doc_id", "_mark").agg(F.min_by(whole, F.xxhash64(whole)).alias("_row")).select("_row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences and passages that an earlier document or place has."""
    # few copies are left here, so small buckets give few rows more and need less memory
    return substring_dedup.dedup_substrings(docs, per_bucket=16 << 20)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the mix, a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids (SentencePiece ids of the text) and n_tokens of every row of the mix."""
    rows = sentence_pieces.encode(docs.select("doc_id", "source", "lang", "text"))
    return rows.selectExpr("doc_id", "source", "lang", "ids", "cast(size(ids) as long) AS n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoded),
]

#: The cuts of several stages need programs, not SQL: tests compare run() with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents; what a stage gives is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
