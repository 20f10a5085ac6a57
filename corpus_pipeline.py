"""Corpus pipeline: quality, exact and near duplicates, mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import exact_dedup, mixing, ngram_join, packing, quality
from lamina.llm.common import stored
from lamina.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more; it is trained on labelled documents that are not held out."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of equal texts."""
    # written before it is summed: a join right below an aggregate cannot be split where a digest is hot
    found = stored(exact_dedup.exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "decisions")
    dropped = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    dropped = dropped.where("not kept or rows > 1").select(F.col("doc_id").alias("its_id"), F.col("text_sha256").alias("its_digest"), "kept")
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), exact_dedup.text_digest(F.col("text")).alias("digest"))
    joined = marked.join(dropped.hint("merge"), F.col("id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left")
    # rows that are repeated whole: one of them stays
    once = joined.where("kept").dropDuplicates(["id", "digest"])
    return joined.where("kept is null").select("row.*").unionByName(once.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8."""
    found = ngram_join.similar_documents(docs.select("doc_id", "text"))
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, in the order of mixture blocks.

    Equal rows are shown alike, at the places of the first of them.
    """
    shown = mixing.mixture(docs).where("copy = 0").select(F.col("doc_id").alias("its_id"), F.col("source").alias("its_source"), F.col("digest").alias("its_digest"), F.struct("block_id", "block_order").alias("place"))
    places = shown.groupBy("its_id", "its_source", "its_digest").agg(F.collect_list("place").alias("places"))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"), mixing.text_key(F.col("text")).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("its_id")) & F.col("from").eqNullSafe(F.col("its_source")) & (F.col("digest") == F.col("its_digest"))
    rows = marked.join(places.hint("merge"), same).select("row", F.explode("places").alias("place"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "place").sortWithinPartitions("place").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
