"""Look-ups, merges, numbering and change capture on DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import stored


def duplicate_manifest(rows: DataFrame, content: str, key: str) -> DataFrame:
    """Groups of identical content: digest, n, keep (least key), members (sorted keys)."""
    return rows.groupBy(F.sha2(content, 256).alias("digest")).agg(
        F.count("*").alias("n"), F.min(key).alias("keep"), F.sort_array(F.collect_list(key)).alias("members"))


def duplicate_members(rows: DataFrame, content: str, key: str) -> DataFrame:
    """digest, n, keep, member: a row for each member of a group of identical content, so no group is one row."""
    marked = rows.select(F.sha2(content, 256).alias("digest"), F.col(key).alias("member"))
    groups = marked.groupBy("digest").agg(F.count("*").alias("n"), F.min("member").alias("keep")).where("n > 1")
    return marked.join(groups, "digest").select("digest", "n", "keep", "member")


def fallback_lookup(facts: DataFrame, defaults: DataFrame, tiers: list[list[str]], value: str) -> DataFrame:
    """Left join by the first tier of keys that has a value; a tier's rows have null in all other key columns.

    Each tier is an equi-join on its own keys, so no theta join is needed. Of several values of a key the least counts.
    """
    keys = sorted({k for tier in tiers for k in tier})
    out, found = facts, []
    for i, tier in enumerate(tiers):
        only = reduce(lambda a, b: a & b, [F.col(k).isNotNull() if k in tier else F.col(k).isNull() for k in keys])
        part = defaults.where(only).groupBy(*tier).agg(F.min(value).alias(f"_{i}"))
        out = out.join(part, tier, "left")
        found.append(F.col(f"_{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"_{i}" for i in range(len(tiers))])


def lookup(facts: DataFrame, dimension: DataFrame, on: dict[str, str], values: list[str], fallback: Column | None = None, how: str = "left") -> DataFrame:
    """facts with values of the dimension's row whose keys equal; on maps fact columns to key columns.

    how="inner" drops misses. With a fallback, which may use the fact's columns, the first value of a miss, or a null one, is that.
    """
    side = dimension.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(on.values())], *values)
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{i}") for i, k in enumerate(on)])
    out = facts.join(side, match, how).drop(*[f"_{i}" for i in range(len(on))])
    return out.withColumn(values[0], F.coalesce(values[0], fallback)) if fallback is not None else out


def hops(facts: DataFrame, *steps: tuple[DataFrame, str, str, list[str]]) -> DataFrame:
    """Inner look-ups one after another; a step is (table, column so far, its key, columns to take)."""
    for dimension, left, key, values in steps:
        facts = lookup(facts, dimension, {left: key}, values, how="inner")
    return facts


def present_ends(edges: DataFrame, nodes: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Edges whose end columns are null where no node has that key; an edge without any end goes."""
    for column, (table, key) in nodes.items():
        known = table.select(F.col(key).alias("_key")).distinct()
        edges = edges.join(known, F.col(column) == F.col("_key"), "left").withColumn(column, F.col("_key")).drop("_key")
    return edges.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in nodes]))


def reconcile(left: DataFrame, right: DataFrame, key: str, only_left: str, only_right: str) -> DataFrame:
    """key, problem: keys of one side that the other lacks. Two anti-joins, so a null key lacks its partner and hides nothing."""
    sides = [(left, right, only_left), (right, left, only_right)]
    found = [a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit(name)) for a, b, name in sides]
    return found[0].unionByName(found[1])


def split_errors(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, the others with `reason`, the first rule broken)."""
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in a group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("int"))


def target_set(changed: DataFrame, pending: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that changed or are pending, without those that are done."""
    wanted = changed.select(key).unionByName(pending.select(key)).distinct()
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def layered(*layers: Column) -> Column:
    """The first layer that is not null, most specific first."""
    return F.coalesce(*layers)


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """All rows of both sides; where both have a key, new non-null values win."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    return o.join(n, on, "full_outer").select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key], *[F.coalesce(f"n.{v}", f"o.{v}").alias(v) for v in values])


def snapshot_diff(old: DataFrame | None, new: DataFrame, position: str, digest: str) -> DataFrame:
    """Changed positions: none without a baseline, all if the counts differ, else those whose digests differ."""
    if old is None:
        return new.select(position).limit(0)
    counts = old.agg(F.count("*").alias("n_old")).crossJoin(new.agg(F.count("*").alias("n_new")))  # one row each
    pairs = new.select(position, F.col(digest).alias("_new")).join(old.select(position, F.col(digest).alias("_old")), position, "left")
    return pairs.crossJoin(F.broadcast(counts)).where((F.col("n_old") != F.col("n_new")) | ~F.col("_new").eqNullSafe(F.col("_old"))).select(position)


def slot_plan(existing: DataFrame, index: str, delete: list[int], reserve: list[int]) -> DataFrame:
    """Survivors, in order, fill the slots 1.. that are not reserved: old, new.

    Plans are for one ordered list (a deck's slides), so the ordered numbering is of bounded size.
    """
    for name, values in (("delete", delete), ("reserve", reserve)):
        if any(v <= 0 for v in values) or len(set(values)) != len(values):
            raise ValueError(f"{name} positions must be distinct and positive")
    if set(delete) & set(reserve):
        raise ValueError("a position is both deleted and reserved")
    stay = existing.where(~F.col(index).isin(delete)) if delete else existing
    rank = stay.select(F.col(index).alias("old"), F.row_number().over(Window.orderBy(index)).alias("k"))
    total = existing.agg((F.count("*") - len(delete) + len(reserve)).cast("int").alias("n"))
    slots = total.select(F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("new"))
    slots = slots.where(~F.col("new").isin(reserve)) if reserve else slots
    slots = slots.withColumn("k", F.row_number().over(Window.orderBy("new")))
    return rank.join(slots, "k").select("old", "new")


def clobbers(renames: DataFrame, survivors: DataFrame) -> DataFrame:
    """Targets that several sources get, or that a row not renamed already has: target, problem."""
    twice = renames.groupBy("new").agg(F.count("*").alias("n")).where("n > 1").select(F.col("new").alias("target"), F.lit("duplicate").alias("problem"))
    taken = renames.where("old <> new").join(survivors.select(F.col("index").alias("new")), "new", "left_semi")
    return twice.unionByName(taken.select(F.col("new").alias("target"), F.lit("occupied").alias("problem")).distinct())


def dense_ids(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """key, new_id: 1..n in key order, without a sort in one task: range partitions and their running counts.

    The partition of each key is written, as another sampling of ranges could set other bounds.
    """
    placed = rows.select(key).distinct().repartitionByRange(parts, key)
    placed = stored(placed.withColumn("part", F.spark_partition_id()), "dense-ids")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # at most `parts` rows
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select(key, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(key))).alias("new_id"))


def unique_names(rows: DataFrame, base: str, order: str, first_suffix: int, separator: str) -> Column:
    """base, then base with separator and a number from first_suffix on, in order; a number counts the rows of its base only."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return F.when(k == 1, F.col(base)).otherwise(F.concat_ws(separator, base, (k - 2 + first_suffix).cast("string")))


def distinct_names(rows: DataFrame, group: list[str], base: str, order: str, separator: str, first_suffix: int) -> DataFrame:
    """rows with `name`, distinct in a group: in order, base or base with the first number from first_suffix on that is free.

    A name with a number may itself be a base, so all bases that differ by such endings are numbered together, by
    one task; where they are all the same, by place.
    """
    ending = f"({re.escape(separator)}[0-9]+)+$"
    marked = rows.withColumn("root_", F.regexp_replace(base, ending, ""))
    roots = Window.partitionBy(*group, "root_")
    marked = marked.withColumn("mixed_", F.min(base).over(roots) != F.max(base).over(roots))
    k = F.row_number().over(Window.partitionBy(*group, "root_").orderBy(order))
    simple = marked.where("not mixed_").withColumn("name", F.when(k == 1, F.col(base)).otherwise(F.concat_ws(separator, base, (k - 2 + first_suffix).cast("string"))))

    def number(frame):
        used, names = set(), []
        frame = frame.sort_values("seq_")
        for b in frame[base]:
            name, n = b, first_suffix
            while name in used:
                name, n = f"{b}{separator}{n}", n + 1
            used.add(name)
            names.append(name)
        return frame.assign(name=names)

    mixed = marked.where("mixed_").withColumn("seq_", F.row_number().over(Window.partitionBy(*group, "root_").orderBy(order)))
    mixed = mixed.groupBy(*group, "root_").applyInPandas(number, mixed.withColumn("name", F.lit("")).schema).drop("seq_")
    return simple.unionByName(mixed).drop("root_", "mixed_")


def range_select(text: str, total: int) -> list[int]:
    """'all', 'n', 'a-b' and comma lists as sorted distinct numbers within 1..total; reversed ranges are empty."""
    if text.strip() == "all":
        return list(range(1, total + 1))
    found: set[int] = set()
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        found |= set(range(int(low), int(high) + 1)) if dash else {int(low)}
    return sorted(v for v in found if 1 <= v <= total)


def all_equal(column: str) -> Column:
    """The value if it is the same and not null in every row of a group, else null."""
    return F.when((F.count(column) == F.count("*")) & (F.min(column) == F.max(column)), F.min(column))


def carry_over(pending: DataFrame, built: DataFrame, keys: list[str]) -> DataFrame:
    """Pending rows that no built row has."""
    return pending.join(built.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(f"_k <= {n}").drop("_k")


def insert_on_miss(facts: DataFrame, dimension: DataFrame, key: str, derive: Column) -> DataFrame:
    """The dimension and a derived row for each key of facts that it lacks: key, name."""
    new = facts.select(key).distinct().join(dimension, key, "left_anti").select(key, derive.alias("name"))
    return dimension.select(key, "name").unionByName(new)


def resolve(facts: DataFrame, dimension: DataFrame, key: str, name: str, derive: Column) -> tuple[DataFrame, DataFrame]:
    """(facts whose key is resolved, the dimension with new rows).

    A key that is given stays. Else it is the least key of the dimension with that name, else derive(), which may use the
    name; keys that the dimension lacks become rows of it.
    """
    by_name = dimension.where(F.col(key).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.min(key).alias("_key"))
    out = facts.join(by_name, F.col(name) == F.col("_name"), "left").withColumn(key, F.coalesce(key, "_key", derive)).drop("_name", "_key")
    new = out.select(key, name).join(dimension.select(key), key, "left_anti").groupBy(key).agg(F.min(name).alias(name))
    return out, dimension.select(key, name).unionByName(new)
