"""Extendible hashing into shards under a byte limit (DataFrame functions only).

A row's address is the leading bits of SHA-256 of its key. The directory starts with one bucket
of no bits; a bucket over the limit, and only that, splits on its next bit. Bucket sizes come from
a histogram of address prefixes, aggregated before the shuffle, so no text is moved and the
directory's size follows the number of shards, not of rows. One round resolves ROUND_BITS bits;
rows of buckets that are still too large go into another round, up to MAX_BITS.

Rows that no bit separates (the same key again and again) leave a bucket that hashing cannot split;
as in the classic scheme it gets overflow pages. Pages follow the running sum of bytes, computed in
two levels so that no bucket is gathered in one task.

Defined results: a null key is the key ''; a null text has 0 bytes. A single row over the limit has
a shard of its own, marked by shard_bytes above the limit. An empty table gives an empty result.
Columns besides key and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import stored

LIMIT_BYTES = 64 << 20
ROUND_BITS = 12
MAX_BITS = 60


def address(key) -> F.Column:
    """60 bits of SHA-256 of the key, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 15), 16, 2), MAX_BITS, "0")


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Buckets (prefix, shard_bytes) within the limit, and those of MAX_BITS that are over it.

    rows: bits, bytes. Each round sums the rows of open buckets by their next ROUND_BITS bits,
    rolls those sums up to every shorter prefix, and closes the shortest prefix that fits.
    """
    spark = rows.sparkSession
    done, open_at, depth = None, None, 0
    while depth < MAX_BITS:
        to = min(MAX_BITS, depth + ROUND_BITS)
        part = rows if open_at is None else rows.withColumn("prefix", F.substring("bits", 1, depth)).join(open_at.select("prefix"), "prefix", "left_semi")
        leaves = part.groupBy(F.substring("bits", 1, to).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        first = depth if open_at is None else depth + 1
        levels = leaves.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(to))))
        sums = levels.groupBy(F.col("d").alias("depth"), F.expr("substring(leaf, 1, d)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"))
        fits = stored(sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == to)), "buckets")
        # A prefix is a bucket if its parent was too large, or if it has none in this round.
        over = sums.where(F.col("shard_bytes") > limit).select(F.col("prefix").alias("parent"))
        here = fits.withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        top = here.where(F.col("depth") == first).drop("parent")
        under = here.where(F.col("depth") > first).join(over, "parent", "left_semi").drop("parent")
        found = stored(top.unionByName(under), "directory")
        closed = found.where(F.col("shard_bytes") <= limit)
        done = closed if done is None else done.unionByName(closed)
        open_at = found.where(F.col("shard_bytes") > limit)
        depth = to
        if open_at.isEmpty():
            break
    empty = spark.createDataFrame([], "depth int, prefix string, shard_bytes long")
    return (done if done is not None else empty), (open_at if open_at is not None else empty)


def _rows(docs: DataFrame, key: str, text: str, rid) -> DataFrame:
    return docs.select(F.col(key).alias("id"), address(F.col(key)).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), rid.alias("rid"))


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows(id, bits, bytes, rid) -> id, rid, shard_id, depth, shard_bytes."""
    closed, full = directory(rows, limit)
    # Every row has exactly one bucket among its prefixes; the depths in use are few.
    depths = sorted(r[0] for r in closed.select("depth").distinct().collect())
    at = F.array(*[F.substring("bits", 1, d) if d else F.lit("") for d in depths]) if depths else F.array().cast("array<string>")
    out = rows.select("id", "rid", F.explode(at).alias("prefix")).join(closed, "prefix").select(
        "id", "rid", F.when(F.col("prefix") == "", "-").otherwise(F.col("prefix")).alias("shard_id"), F.col("depth").cast("int").alias("depth"), "shard_bytes")
    return out if full.isEmpty() else out.unionByName(_pages(rows, full, limit))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """Returns key, shard_id (the bucket's bits, '-' for none, with '+page' for overflow), depth, shard_bytes.

    Rows of one key share a shard, but for overflow pages; which row is on which page follows the order of the input.
    """
    rows = stored(_rows(docs, key, text, F.monotonically_increasing_id()), "addresses")
    return placed(rows, limit).select(F.col("id").alias(key), "shard_id", "depth", "shard_bytes")


def _pages(rows: DataFrame, full: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of at most half the limit plus a row; rows over half the limit are pages themselves."""
    deep = stored(rows.withColumn("prefix", F.substring("bits", 1, MAX_BITS)).join(full.select("prefix"), "prefix", "left_semi"), "overflow")
    deep = deep.withColumn("part", F.shiftright("rid", 33))
    half = limit // 2
    big = deep.where(F.col("bytes") > half).select("id", "rid", "prefix", F.concat(F.lit("r"), F.col("rid").cast("string")).alias("page"), "bytes")
    small = deep.where(F.col("bytes") <= half)
    sums = small.groupBy("prefix", "part").agg(F.sum("bytes").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    run = F.sum("bytes").over(Window.partitionBy("prefix", "part").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    paged = small.join(before, ["prefix", "part"]).withColumn("page", F.floor((run + F.col("before")) / F.lit(max(1, half))).cast("string"))
    paged = paged.select("id", "rid", "prefix", "page", "bytes").unionByName(big)
    sizes = paged.groupBy("prefix", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.drop("bytes").join(sizes, ["prefix", "page"]).select(
        "id", "rid", F.concat_ws("+", "prefix", "page").alias("shard_id"), F.lit(MAX_BITS).alias("depth"), "shard_bytes"
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write docs, all rows and columns, as one folder per shard (shard_id=b and its bits).

    The rows are written once with a number, by which shards are joined to them, so null and repeated keys stay whole.
    """
    number = "rid"
    while number in docs.columns:
        number += "_"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = stored(_rows(numbered, key, text, F.col(number)), "addresses")
    # a letter before the bits, or readers would take them for a number
    plan = placed(rows, limit).select(F.col("rid").alias(number), F.concat(F.lit("b"), "shard_id").alias("shard_id"))
    numbered.join(plan.hint("merge"), number).drop(number).repartition("shard_id").write.partitionBy("shard_id").parquet(path)
