"""Temperature mixing of sources.

Token shares p of the sources are raised to an exponent and normalised: w = p^a / sum p^a. The
exponent is bisected in [0, 1] to the smallest one whose largest repetition stays within a limit,
and whose weights' entropy stays at or below a target. The token budget is the least that shows every
document once, so nothing is dropped: source s is shown budget * w[s] / tokens[s] times, at least
once and at most the limit.

Each source becomes a stream of epochs; an epoch is a permutation of its documents by a seeded
hash, and the last one stops where the source's budget is met. A mixture block holds block_tokens
tokens, and w[s] * block_tokens of them are source s: a document is in the block in which its
stream position falls, and blocks are ordered inside by another part of the hash.

The result is a function of the table: hashes are of doc_id, text digest, a number among equal rows
and the epoch, never of a row's place in files. Sums that decide the weights are exact (decimals),
so the order of adding changes nothing.

Sources stay a table of any length: the repetition limit needs the largest and the least total, and the
entropy is found by rounds of aggregates over PARTS exponents at once. The weights are joined by
source; the join broadcasts them only where their written size is below the session's limit, and a
large source's rows can be split otherwise. Running sums take two levels, with as many buckets as the root
of a source's rows, so no source is in one task.

Defined results: a null source is a source of its own (null). Null and empty texts have no tokens;
they appear once, in their first epoch. Repeated rows are documents of their own. An empty table
gives an empty result. Columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import stored

REPEAT_LIMIT = 2.0
BLOCK_TOKENS = 1 << 16
PARTS = 16
STEPS = 60
COPIES = 1024
SEED = 17


def bisect(fits: Callable[[float], bool], steps: int = STEPS) -> float:
    """The least exponent in [0, 1] that fits, where all above it fit; 1 if none below does."""
    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def repetition(low: float, high: float, exponent: float) -> float:
    """How often a source of `low` tokens is shown if one of `high`, the largest, is shown once."""
    return (high / low) ** (1 - exponent)


def _share(exponent, high: float):
    """The share of a source's total before it is normalised, as an exact decimal."""
    return F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(high), exponent)).otherwise(F.lit(0.0)).cast("decimal(28,18)")


def entropy_exponent(totals: DataFrame, high: float, target: float) -> float:
    """The least exponent in [0, 1] whose weights have at most the target entropy; the entropy falls as it grows.

    Each round cuts the range into PARTS by one aggregate over the sources.
    """
    low, top = 0.0, 1.0
    for _ in range(math.ceil(STEPS / math.log2(PARTS))):
        at = sorted({low + (top - low) * i / PARTS for i in range(PARTS + 1)})
        log = F.when(F.col("total") > 0, F.ln(F.col("total") / F.lit(high))).otherwise(F.lit(0.0))
        each = totals.select("total", F.explode(F.array(*map(F.lit, at))).alias("a"))
        share = _share(F.col("a"), high)
        sums = {r.a: (float(r.z), float(r.s)) for r in each.groupBy("a").agg(F.sum(share).alias("z"), F.sum((share.cast("double") * log).cast("decimal(28,18)")).alias("s")).collect()}
        entropy = [math.log(z) - a * s / z for a, (z, s) in ((a, sums[a]) for a in at)]
        first = next((i for i, h in enumerate(entropy) if h <= target), len(at) - 1)
        if first == 0:
            return at[0]
        low, top = at[first - 1], at[first]
        if low == top or (low + top) / 2 in (low, top):
            break
    return top


def token_count(text) -> F.Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key(text) -> F.Column:
    """What tells the texts of rows with one doc_id apart: half of a SHA-256, null as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def sources(rows: DataFrame, repeat_limit: float | None, target_entropy: float | None) -> DataFrame:
    """rows(source, tokens, copies) -> source, total, n, weight, budget for every source."""
    totals = stored(rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("total"), F.sum("copies").alias("n")), "totals")
    some = F.when(F.col("total") > 0, F.col("total"))
    low, high = totals.agg(F.min(some), F.max(some)).first()
    if low is None:
        return totals.withColumns({"weight": F.lit(0.0), "budget": F.lit(0).cast("long")})
    exponent = 1.0
    if low < high:
        exponent = max(
            bisect(lambda a: repetition(low, high, a) <= repeat_limit) if repeat_limit is not None else 0.0,
            entropy_exponent(totals, float(high), target_entropy) if target_entropy is not None else 0.0)
    z = float(totals.agg(F.sum(_share(F.lit(exponent), float(high)))).first()[0])
    shown = F.pow(F.lit(float(high)) / F.col("total"), F.lit(1 - exponent))
    budget = F.when(F.col("total") > 0, F.greatest(F.col("total"), F.round(shown * F.col("total")).cast("long"))).otherwise(F.lit(0).cast("long"))
    return totals.withColumns({"weight": _share(F.lit(exponent), float(high)).cast("double") / F.lit(z), "budget": budget})


def numbered(rows: DataFrame) -> DataFrame:
    """rows(..., copies) -> a row for each copy, numbered; copies of one row are dealt out before they are made."""
    many = rows.where("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    many = many.repartition("doc_id", "digest", "part")
    last = F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1
    many = many.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last))).drop("part", "copies")
    return rows.where("copies = 1").withColumn("copy", F.lit(0).cast("long")).drop("copies").unionByName(many)


def mixture(
    docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
) -> DataFrame:
    """One row per showing: doc_id, source, tokens, epoch, weight, block_id, block_order, copy, digest.

    copy numbers equal rows; digest is text_key(). block_order is a hash, as hexadecimal digits.
    """
    read = docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens"), text_key(F.col("text")).alias("digest"))
    rows = stored(read.groupBy("doc_id", "source", "digest").agg(F.max("tokens").alias("tokens"), F.count("*").alias("copies")), "tokens")
    plan = stored(sources(rows, repeat_limit, target_entropy), "plan").withColumnRenamed("source", "s")
    at = numbered(rows).join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("total"))).otherwise(F.lit(1)).cast("int")
    at = at.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"), F.col("epoch").cast("string"), F.lit(str(seed)))
    at = at.withColumn("key", F.sha2(name, 256))
    # buckets follow the order of keys, as many as the root of the source's rows
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.sqrt("n"))
    at = at.withColumn("bucket", F.shiftright(spread, 32)).withColumn("g", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sums = at.groupBy("g", "epoch", "bucket").agg(F.sum("tokens").alias("sum"))
    first = Window.partitionBy("g", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "epoch", "bucket", F.coalesce(F.sum("sum").over(first), F.lit(0)).alias("before"))
    inside = Window.partitionBy("g", "epoch", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("run", F.sum("tokens").over(inside) - F.col("tokens")).join(sums, ["g", "epoch", "bucket"])
    out = out.withColumn("start", F.col("epoch") * F.col("total") + F.col("before") + F.col("run"))
    out = out.where((F.col("epoch") == 0) | (F.col("start") < F.col("budget")))
    quota = F.greatest(F.col("weight") * F.lit(float(block_tokens)), F.lit(1.0))
    return out.select(
        "doc_id", "source", "tokens", "epoch", "weight",
        F.when(F.col("weight") > 0, F.floor(F.col("start") / quota)).otherwise(F.lit(0)).cast("long").alias("block_id"),
        F.substring("key", 33, 16).alias("block_order"), "copy", "digest",
    )
