"""Near-duplicate embeddings by sorted projection passes.

Equal vectors are one class. Each pass draws random hyperplanes, a class's key is the signs of its
projections one after another, and classes are sorted by it. A class's window in that order is the run
of classes with an equal key; keys have as many signs as make runs of BLOCK classes on average. A window of
a fixed number of neighbours would lose most links of a dense group, so a run that is longer is compared
whole: it is dealt into tiles of BLOCK, and each two tiles are one product. A pair at the threshold has
equal keys in a pass with probability (1 - angle / pi) ^ signs; the passes are as many as make the
probability that it is in no window at most MISS, so they grow with the number of classes, and a pair's
chance depends on no other vector. Up to BLOCK classes there is one window. Comparisons are in double
precision. A pair is counted in the first pass that compares it (each row carries its keys of all
passes), so nothing is emitted pair by pair: two tiles give the number of new links of each row and a
spanning forest of them. The links of all passes are united by connected components.

A row is copied once for each tile of its run in each pass. Runs of more than one tile are counted, at
most one for BLOCK classes and pass, and joined. The comparisons in a dense group grow with the square of
its size, as the links do.

Defined results: null and zero vectors, and those with null or non-finite components, link with
nothing (n_links 0, component_id their own vec_id). Vectors of different lengths are never compared.
Vectors are scaled before they are compared, so very large and very small ones count as any other.
Repeated rows are copies: all link with each other. A null vec_id links and counts as a row but names
a component only if no other row can. Columns besides vec_id and embedding are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import components, stored

COSINE = 0.95
BLOCK = 4096
MISS = 1e-4
SEED = 11


def usable(v) -> F.Column:
    return F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def bits_and_passes(n: int, threshold: float, block: int, miss: float = MISS) -> tuple[int, int]:
    """Signs of a key and passes for n classes of one dimension; no signs is one window of all of them."""
    bits = max(0, math.ceil(math.log2(n / block)))
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    if together in (0, 1):
        return (0, 1) if not together else (bits, 1)
    return bits, math.ceil(math.log(miss) / math.log1p(-together))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that products neither overflow nor vanish."""
    return x / np.abs(x).max(1)[:, None]


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype("<f4")
    same = (short.astype(np.float64) == x).all(1)
    return [(short[i] if same[i] else x[i]).tobytes() for i in range(len(x))]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim))
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8")
    return out


def keys(classes: DataFrame, plan: dict[int, tuple[int, int]], seed: int) -> DataFrame:
    """class_id, dim, copies, x, keys: the vector's bytes and the signs of its projections in each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, copies, vectors = batch.column("class_id").to_numpy(), batch.column("copies").to_numpy(), batch.column("v")
            flat, ends = vectors.flatten().to_numpy(), np.cumsum(pc.list_value_length(vectors).to_numpy())
            dims = np.diff(ends, prepend=0)
            for dim in np.unique(dims):
                own = dims == dim
                x = flat[(ends - dims)[own][:, None] + np.arange(dim)]
                bits, passes = plan[int(dim)]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).normal(size=(int(dim), passes * bits))
                signs = ((scaled(x) @ planes[dim]) > 0).reshape(len(x), passes, bits)
                key = signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(np.full(len(x), dim, np.int32)), pa.array(copies[own]), pa.array(packed(x), pa.binary()), pa.array(key.tolist(), pa.list_(pa.int64()))],
                    names=["class_id", "dim", "copies", "x", "keys"])

    return classes.select("class_id", "v", "copies").mapInArrow(run, "class_id long, dim int, copies long, x binary, keys array<long>")


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the links that a matrix marks."""
    label, rows, columns = np.arange(near.shape[1]), [], []
    for i in np.flatnonzero(near.any(1)):
        j = np.flatnonzero(near[i])
        own = label[j]
        if (own == own[0]).all():
            j = j[:1]
        else:
            own, first = np.unique(own, return_index=True)
            j, joined = j[first], np.zeros(len(label), bool)
            joined[own] = True
            label[joined[label]] = own[0]
        rows.append(np.full(len(j), i))
        columns.append(j)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, int), np.empty(0, int))


def compare(vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray, copies: np.ndarray, first: np.ndarray, same: bool, this: int, threshold: float):
    """Links first compared in pass `this` within one tile, or between the tile that `first` marks and the other.

    Returns (class, links in vectors) and the ends of a spanning forest.
    """
    unit = scaled(vectors)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    a, b = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
    near, links = np.zeros((len(a), len(b)), bool), np.zeros(len(ids))
    many, other = copies.astype(np.float64), unit[b].T.copy()
    for at in range(0, len(a), 512):
        own = a[at : at + 512]
        part = unit[own] @ other >= threshold
        if same:
            part &= np.arange(len(b)) > np.arange(at, at + len(own))[:, None]
        if not part.any():
            continue
        for p in range(this):
            part &= keys[own, p][:, None] != keys[b, p]
        near[at : at + len(own)] = part
        whole = part.astype(np.float64)
        links[own] += whole @ many[b]
        links[b] += many[own] @ whole
    i, j = spanning(near)
    return links.astype(np.int64), (ids[a[i]], ids[b[j]])


def near_links(signed: DataFrame, block: int, threshold: float) -> DataFrame:
    """a, b, n: a spanning edge (n null) or the number of new links of class a (b null)."""
    run_of = ["dim", "pass", "run"]
    large = signed.select("dim", F.posexplode("keys").alias("pass", "run")).groupBy(*run_of).agg(F.ceil(F.count("*") / block).alias("tiles")).where("tiles > 1")
    rows = signed.select("*", F.posexplode("keys").alias("pass", "run")).join(large, run_of, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class_id", "pass"), F.col("tiles"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("class_id", "copies", "x", "keys", "own", *run_of, F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))

    def run(batch: pa.Table) -> pa.Table:
        dim, this, low, high = (batch.column(c)[0].as_py() for c in ("dim", "pass", "low", "high"))
        ids = batch.column("class_id").to_numpy()
        links, (a, b) = compare(
            unpacked(batch.column("x").to_pylist(), dim), ids, np.array(batch.column("keys").to_pylist()), batch.column("copies").to_numpy(),
            batch.column("own").to_numpy() == low, low == high, this, threshold)
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], a])), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]),
            "n": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(a), pa.int64())])})

    return rows.groupBy(*run_of, "low", "high").applyInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, passes: int | None = None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding).

    passes replaces the number that MISS asks for where not all pairs are compared.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    good = rows.where(usable(F.col("v")))
    text = F.sha2(F.to_json(F.struct("v")), 256)
    named = stored(good.select("vec_id", "v", text.alias("digest"), F.monotonically_increasing_id().alias("rid")), "vectors")
    groups = stored(named.groupBy("digest").agg(F.min("rid").alias("class_id"), F.min("vec_id").alias("low"), F.count("*").alias("copies")), "classes")
    classes = stored(named.join(groups, F.col("rid") == F.col("class_id")).select("class_id", "v", "copies", "low"), "class-vectors")
    plan = {r.dim: bits_and_passes(r.n, threshold, block) for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if passes:
        plan = {dim: (bits, passes if bits else 1) for dim, (bits, _) in plan.items()}
    found = stored(near_links(stored(keys(classes, plan, seed), "keys"), block, threshold), "links")
    parts = components(found.where("b is not null").select("a", "b"))
    degree = found.where("n is not null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
    joined = groups.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    joined = joined.withColumn("component", F.coalesce("component", "class_id"))
    names = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    joined = stored(joined.join(names, "component").select("digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "answers")
    linked = named.select("vec_id", "digest").join(joined.hint("merge"), "digest").select("vec_id", "n_links", "component_id")
    single = rows.where(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
