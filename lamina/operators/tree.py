"""Hierarchies: recursive flattening, ancestor selection and folds along paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.relational import dense_ids
from lamina.session import stored

#: Above every ordinal of a sort_path.
LAST = (1 << 31) - 1


def flatten(nodes: DataFrame) -> DataFrame:
    """nodes(id, parent_id, ord) -> id, depth, path (ids from the root), sort_path (ordinals, for pre-order).

    One join a level, until a level is empty; each level is a written table, so no level is computed twice.
    A cycle never reaches a root and is left out, as are rows whose parent is missing.
    """
    level = nodes.where("parent_id is null").select("id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.array("ord").alias("sort_path"))
    levels = []
    while True:
        level = stored(level, "tree-level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels, level)
        levels.append(level)
        level = nodes.alias("n").join(level.alias("l"), F.col("n.parent_id") == F.col("l.id")).select(
            F.col("n.id").alias("id"), (F.col("l.depth") + 1).alias("depth"), F.concat("l.path", F.array("n.id")).alias("path"), F.concat("l.sort_path", F.array("n.ord")).alias("sort_path"))


def preorder(paths: DataFrame, parts: int = 64) -> DataFrame:
    """flatten()'s rows with z, from 1: children in order, a node after all that is below it.

    The order is that of sort_path with a last ordinal above all others, so a node follows its subtree.
    """
    at = paths.withColumn("at_", F.concat("sort_path", F.array(F.lit(LAST).cast(paths.schema["sort_path"].dataType.elementType))))
    ids = dense_ids(at, "at_", parts)
    return at.join(ids, "at_").withColumnRenamed("new_id", "z").drop("at_")


def below(paths: DataFrame, flagged: DataFrame) -> DataFrame:
    """The rows of flatten() that have an ancestor among flagged(id); a node is not its own ancestor."""
    above = paths.select("id", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("above"))
    hit = above.join(flagged.select(F.col("id").alias("above")).distinct(), "above", "left_semi").select("id").distinct()
    return paths.join(hit, "id", "left_semi")


def subtree(paths: DataFrame, selected: DataFrame) -> DataFrame:
    """keep_with_ancestors(), but an error that names the selected ids which do not exist."""
    lost = [str(r[0]) for r in missing(paths, selected).orderBy("id").limit(20).collect()]
    if lost:
        raise ValueError("no such nodes: " + ", ".join(lost))
    return keep_with_ancestors(paths, selected)


def keep_with_ancestors(paths: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected ids and all their ancestors, from flatten()'s paths."""
    return paths.join(selected.select("id"), "id", "left_semi").select(F.explode("path").alias("id")).distinct()


def missing(paths: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected ids that are in no path."""
    return selected.select("id").distinct().join(paths.select("id"), "id", "left_anti")


def fold_frames(chain):
    """Compose an array of struct(x, y, w, h, cx, cy, cw, ch, turn), outermost group first, to the last box on the slide.

    A box's centre goes through each group's scale, w / cw and h / ch of what the group is shown at; a box at a
    quarter turn takes the other axis's scale. Turns add up.
    """

    def step(a, t):
        sx = F.when(a["cw"] != 0, a["w"] / a["cw"]).otherwise(1.0)
        sy = F.when(a["ch"] != 0, a["h"] / a["ch"]).otherwise(1.0)
        quarter = F.abs(F.pmod(t["turn"], F.lit(180.0)) - 90) < 0.5
        w, h = F.when(quarter, t["w"] * sy).otherwise(t["w"] * sx), F.when(quarter, t["h"] * sx).otherwise(t["h"] * sy)
        x = a["x"] + (t["x"] + t["w"] / 2 - a["cx"]) * sx - w / 2
        y = a["y"] + (t["y"] + t["h"] / 2 - a["cy"]) * sy - h / 2
        kept = [t[k].alias(k) for k in ("cx", "cy", "cw", "ch")]
        return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), *kept, (a["turn"] + t["turn"]).alias("turn"))

    slide = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "w", "h", "cx", "cy", "cw", "ch", "turn")])
    return F.aggregate(chain, slide, step)
