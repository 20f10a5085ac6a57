"""Derived identifiers and the content store, as column expressions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lamina/threads")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based UUID of version 5: SHA-1 of namespace and name with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def braced(value: Column) -> Column:
    return F.concat(F.lit("{"), F.upper(value), F.lit("}"))


def thread_id(author: Column, created: Column, salt: Column | None = None) -> Column:
    """Id of a thread from its author and time; salt, where it is not 0, tells threads of one author and time apart."""
    seed = F.concat_ws("|", author, created)
    if salt is not None:
        seed = F.when(salt != 0, F.concat_ws("|", seed, salt.cast("string"))).otherwise(seed)
    return braced(uuid5(seed))


def reply_id(parent: Column, author: Column, created: Column) -> Column:
    """Id of a reply, seeded by its thread's."""
    return braced(uuid5(F.concat_ws("|", parent, author, created)))


def content_name(content, suffix: str):
    """The first 12 hex digits of SHA-1, with a suffix."""
    return F.concat(F.substring(F.sha1(content), 1, 12), F.lit(suffix))


def store_content(rows: DataFrame, content: str, suffix: str, path: str) -> DataFrame:
    """Add content to a store of (name, content) at path, each name once; returns the names that were new.

    Content that is there already is not written again, so a run after a failure only adds what is missing.
    """
    spark = rows.sparkSession
    named = rows.select(content_name(F.col(content), suffix).alias("name"), F.col(content).alias("content")).dropDuplicates(["name"])
    try:
        known = spark.read.parquet(path).select("name")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], "name string")
    batch = path.rstrip("/") + "/batch=" + uuid.uuid4().hex
    named.join(known, "name", "left_anti").write.parquet(batch)
    return spark.read.parquet(batch).select("name")
