"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a Parquet table bucketed and sorted by digest in a shared folder: one row per
distinct text with the document that stays. A batch is first reduced to one row per digest,
then a sort-merge anti-join against the index leaves the digests never seen before, and those
are appended. The index side needs no shuffle because of its buckets; the batch side carries one
row per digest whatever the size of a group of copies.

Defined results: a null text counts as empty, and empty texts equal each other. A null doc_id
sorts after all others, so it stays only where its whole group has none. Repeated rows are
members of one group; of rows that bear the smallest doc_id one is kept. Other columns of the
input are ignored. An empty table gives an empty result and an empty index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import SPACE, fresh_path, stored

BUCKETS = 64


def text_digest(text) -> F.Column:
    """Lowercase hex SHA-256 of a text whose white-space runs are single spaces."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


class DigestIndex:
    """A digest index at `path`; opening a folder that has one continues it.

    `buckets` should be chosen so that one bucket of digests (about 80 bytes each) sorts in an
    executor's memory. It is kept in the table's definition, so it must stay the same for a path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (keep_id BIGINT, group_size BIGINT, batch STRING, text_sha256 STRING) "
            f"USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Take the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def unseen(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """The rows of groups (one per text_sha256) whose digest no other batch has brought into the index."""
        others = self.rows().where(F.lit(not batch) | (F.col("batch") != batch))
        return groups.join(others.select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def add(self, docs: DataFrame, batch: str = "") -> DataFrame:
        """Deduplicate docs(doc_id, text) against the index and within itself, append the new digests.

        Returns doc_id, keep_id, group_size, kept, text_sha256. For a digest from an earlier batch
        keep_id is that batch's document and no row of this batch is kept; group_size counts the
        copies of the batch that brought the digest in. A batch with a name can be added again after
        a failure: digests that it brought in before count as new, and are not appended twice.
        """
        rows = stored(docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("rid")), "digests")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
        groups = rows.groupBy("text_sha256").agg(first, F.count("*").alias("group_size")).select(
            F.col("first.doc_id").alias("keep_id"), "group_size", "text_sha256", F.col("first.rid").alias("keep_rid"))
        fresh = stored(self.unseen(groups, batch).select("keep_id", "group_size", "text_sha256", "keep_rid"), "fresh")
        seen = self.rows().where(F.lit(not batch) | (F.col("batch") != batch)).select("keep_id", "group_size", "text_sha256", F.lit(None).cast("long").alias("keep_rid"))
        before = stored(seen.join(groups.select("text_sha256").hint("merge"), "text_sha256", "left_semi"), "before")
        new = self.unseen(fresh) if batch else fresh
        new = new.select("keep_id", "group_size", F.lit(batch).alias("batch"), "text_sha256")
        new.repartition(self.buckets, "text_sha256").write.insertInto(self.table)
        # One row a digest on this side and both sides shuffled, so a hot digest's rows can be split.
        stays = fresh.unionByName(before)
        return rows.join(stays.hint("merge"), "text_sha256").select(
            "doc_id", "keep_id", "group_size",
            F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept"), "text_sha256",
        )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) against a fresh index: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    found = index.add(docs)
    index.close()
    return found
