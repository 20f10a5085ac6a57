"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word shingles; two link if their Jaccard similarity reaches a
threshold given in hundredths. Every pair of classes of equal sets is decided, none is sampled: the
result is that of all links between classes, but for collisions of hashes. A set is counted by 64-bit
hashes and known by one 64-bit hash of them, and overlaps are counted on 40-bit fingerprints, so for sets
of n and m shingles one too many is counted with a probability of n m / 2^40 (1e-6 for a thousand each),
which decides only a pair that is one shingle off the threshold.

1. Sets are built once and stored as sorted 40-bit fingerprints. Equal sets are one class.
2. A sketch of fixed size counts shingles over all documents. It gives a global order, rare shingles
   first, in which every link shares a shingle among the first n - ceil(t n) + 1 of both sides.
3. Similar classes are partitioned into groups of GROUP classes on average by their least shingles. Groups with
   several classes are opened once against themselves, so a large group of near copies falls into few
   pieces before anything is compared across groups.
4. The matrix: for each range of shingles a task holds which groups contain each of them (the union of
   their leading shingles). Queries are the classes of the smaller piece; the number of leading shingles
   that a query shares with a group bounds its overlap with all members, and only groups whose bound
   reaches the threshold are opened. Classes of one piece are not compared again.
5. Links and pieces are united by connected components.

All rows between tasks are one per class, per (class, shingle range of a batch) in packed form, or per
(query, group): never per pair of a group. Sets travel only for groups that are opened.

Defined results: a text with fewer words than a shingle is one shingle of the whole sequence; null,
empty and white-space texts have none, link with nothing and keep their own id. Rows with one doc_id
are one document: their texts share its component. A null doc_id never names a component; a class
of only such rows has a null one. Columns besides doc_id and text are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import components, remove_table, stored

WORDS = 5
PERCENT = 80
GROUP = 256
KEYS = 3
SLOTS = 1 << 22
SLICE = 1 << 16
CACHE_WORDS = 100_000
RANGE_TOKENS = 2_000_000
GROUP_TOKENS = 4_000_000
QUERIES = 256
HOT = 4096
BITMAP = 1 << 25
MASK = np.uint64((1 << 40) - 1)
# Odd multipliers, one for each word of a shingle or key of a class; any will do.
ODD = [int(x) | 1 for x in np.random.default_rng(3).integers(1 << 62, 1 << 63, 32)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. bytes.split() parts at the six ASCII white-space characters,
    and bytes.lower() changes A-Z only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = len(w) - words + 1
    h = w[:n] * np.uint64(ODD[0])
    for i in range(1, words):
        h += mixed(w[i : i + n] + np.uint64(ODD[i]))
        h *= np.uint64(ODD[i])
    return np.unique(mixed(h))


def packed(prints: np.ndarray) -> bytes:
    """Sorted 40-bit values as a plane of high bytes (long runs, so it compresses) and one of 32-bit words."""
    return (prints >> np.uint64(32)).astype(np.uint8).tobytes() + prints.astype(np.uint32).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return (np.frombuffer(raw, np.uint8, n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(raw, np.uint32, n, n)


def sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, sig, prints for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, ns, sigs, prints = batch.column("doc_id"), [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words, hashes)
                ns.append(len(s))
                sigs.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                prints.append(packed(np.unique(s >> np.uint64(24))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "n", "sig", "prints"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, sig long, prints binary")


def sketch(table: DataFrame) -> np.ndarray:
    """A level for each of SLOTS: eight times the binary logarithm of its count over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            raw = [unpacked(p.as_py()) for p in batch.column("prints")]
            if raw:
                slots += np.bincount((np.concatenate(raw) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        if slots.any():
            slots = np.minimum(slots, 65535).astype(np.uint16)
            for i in range(SLOTS // SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([slots[i * SLICE : (i + 1) * SLICE].tobytes()])], names=["slice", "counts"])

    def level(t: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.uint64)
        for raw in t.column("counts"):
            total += np.frombuffer(raw.as_py(), np.uint16)
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "levels": pa.array([np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8).tobytes()])})

    levels = np.zeros(SLOTS, np.uint8)
    for r in table.select("prints").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(level, "slice int, levels binary").collect():
        levels[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["levels"], np.uint8)
    return levels


def leading(table: DataFrame, levels, percent: int) -> DataFrame:
    """doc_id, m, keys, lead: the first shingles in the global order (48 bits each) and KEYS grouping keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            ms, keys, leads = [], [], []
            for raw in batch.column("prints"):
                s = unpacked(raw.as_py())
                m = len(s)
                order = (level[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | s
                p = m - -(-percent * m // 100) + 1
                first = np.sort(np.partition(order, p - 1)[:p]) if p < m else np.sort(order)
                ms.append(m)
                keys.append([int(((first & MASK) * np.uint64(ODD[8 + j]) >> np.uint64(8)).min()) for j in range(KEYS)])
                leads.append(first.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ms, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(leads, pa.binary())], names=["doc_id", "m", "keys", "lead"])

    return table.where("n > 0").select("doc_id", "prints").mapInArrow(run, "doc_id long, m long, keys array<long>, lead binary")


def sets_of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, prints for a superset of ids(doc_id), chosen by a bitmap of fixed size before any shuffle."""
    spark = table.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    parts = ids.select(place.alias("h")).groupBy(F.shiftright("h", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(32767)).alias("bits")).collect()
    bits = np.zeros(BITMAP // 8, np.uint8)
    for r in parts:
        bits[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            keep = (held.value[h >> 3] >> (h & 7)) & 1
            yield batch.select(["doc_id", "prints"]).filter(pa.array(keep.astype(bool)))

    return table.where("doc_id is not null and n > 0").select("doc_id", "prints", place.alias("h")).mapInArrow(run, "doc_id long, prints binary")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of a with each of b: a product of incidence matrices, in slices of values."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a] + [len(x) for x in b])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.empty(len(flat), bool)
    new[:1] = True
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    # values of one owner only add nothing
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(flat)))
    many = np.repeat(size > 1, size)
    owner, value = owner[many], (np.cumsum(new) - 1)[many]
    out = np.zeros((len(a), len(b)))
    if not len(value):
        return out
    value = np.unique(value, return_inverse=True)[1]
    for at in range(0, int(value[-1]) + 1, 16384):
        own = slice(*np.searchsorted(value, [at, at + 16384]))
        m = np.zeros((len(a) + len(b), 16384), np.float32)
        m[owner[own], value[own] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


class Forest:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def open_groups(rows: DataFrame, percent: int) -> DataFrame:
    """rows(grp, doc_id, prints) -> a, b: a spanning forest of the links inside each group."""

    def run(t: pa.Table) -> pa.Table:
        ids, s = t.column("doc_id").to_pylist(), [unpacked(p.as_py()) for p in t.column("prints")]
        common, size = overlaps(s, s), np.array([len(x) for x in s])
        i, j = np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1))
        forest = Forest()
        edges = [(ids[x], ids[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(ids[x], ids[y])]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy("grp").applyInArrow(run, "a long, b long")


def _pairs(run_of: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) inside runs of a sorted run number, in portions."""
    start = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
    size = np.diff(np.append(start, len(run_of)))
    for d in np.unique(size[size > 1]):
        x, y = np.triu_indices(int(d), 1)
        own = start[size == d]
        step = max(1, most // len(x))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            yield (base + x).ravel(), (base + y).ravel()


def matrix(nodes: DataFrame, percent: int, ranges: int) -> DataFrame:
    """nodes(doc_id, m, piece, piece_size, grp, lead) -> q, mq, grp, shared, lo, hi.

    One row for a query and a group with shared leading shingles, and its number in one range of shingles.
    A shingle that the sketch counts more than HOT times is in no range: its classes are dealt into parts of
    half of HOT, and each two parts are a task of their own. What stands in one part is met in several
    of these tasks and counted by each, so the shared shingles of a pair are then too many, never too few.
    """
    fields = ["doc_id", "m", "piece", "piece_size", "grp"]
    hot_level = int(8 * np.log2(1 + HOT)) + 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("lead").to_pylist()
            if not raw:
                continue
            six = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
            token = np.zeros((len(six), 8), np.uint8)
            token[:, :6] = six
            token = token.view(np.uint64)[:, 0]
            owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) // 6 for r in raw])
            where = (mixed(token) % np.uint64(ranges)).astype(np.int64)
            info = [batch.column(c).to_numpy() for c in fields]
            level = (token >> np.uint64(40)).astype(np.int64)
            hot = np.flatnonzero(level >= hot_level)
            which, entry = [where[level < hot_level]], [np.flatnonzero(level < hot_level)]
            if len(hot):
                # parts follow the shingle's level, which is the same wherever the shingle stands
                parts = np.ceil(2 * 2 ** (level[hot] / 8) / HOT).astype(np.int64)
                part = (mixed(info[0].astype(np.int64).view(np.uint64)[owner[hot]]) % parts.astype(np.uint64)).astype(np.int64)
                each = np.repeat(np.arange(len(hot)), parts)
                other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
                pair = np.minimum(part[each], other) * (1 << 20) + np.maximum(part[each], other)
                code = mixed(token[hot][each] * np.uint64(ODD[0]) + pair.astype(np.uint64)) >> np.uint64(2)
                which.append(code.astype(np.int64) + ranges)
                entry.append(hot[each])
            which, entry = np.concatenate(which), np.concatenate(entry)
            order = np.argsort(which, kind="stable")
            which, entry = which[order], entry[order]
            cut = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
            rows = []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                docs, local = np.unique(owner[entry[a:z]], return_inverse=True)
                rows.append((int(which[a]), six[entry[a:z]].tobytes(), local.astype(np.int32).tobytes(), np.stack([c[docs] for c in info]).astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["range", "tokens", "owners", "docs"])

    def look_up(t: pa.Table) -> pa.Table:
        tokens, owners, infos, base = [], [], [], 0
        for raw, own, docs in zip(*(t.column(c).to_pylist() for c in ("tokens", "owners", "docs")), strict=True):
            info = np.frombuffer(docs, np.int64).reshape(len(fields), -1)
            tokens.append(np.frombuffer(raw, np.uint8).reshape(-1, 6))
            owners.append(np.frombuffer(own, np.int32) + base)
            infos.append(info)
            base += info.shape[1]
        six = np.concatenate(tokens)
        token = np.zeros((len(six), 8), np.uint8)
        token[:, :6] = six
        token, owner = token.view(np.uint64)[:, 0], np.concatenate(owners)
        doc, m, piece, piece_size, grp = np.concatenate(infos, axis=1)
        # rows of the matrix: shingles that several pieces have
        order = np.lexsort((doc[owner], grp[owner], piece[owner], piece_size[owner], token))
        token, owner = token[order], owner[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, int)
        size = np.diff(np.append(start, len(token)))
        last = start + size - 1
        many = np.repeat(piece[owner[start]] != piece[owner[last]], size) if len(start) else np.empty(0, bool)
        owner, row = owner[many], np.repeat(np.arange(len(start)), size)[many]
        out: list[tuple[np.ndarray, ...]] = []

        def keep(q: np.ndarray, s_grp: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> None:
            """Queries with the groups that share a shingle; each shingle counts once for a group."""
            # a group whose sizes are all out of reach is no candidate
            fit = (100 * hi >= percent * m[q]) & (percent * lo <= 100 * m[q])
            q, s_grp, lo, hi, at = q[fit], s_grp[fit], lo[fit], hi[fit], at[fit]
            if not len(q):
                return
            order = np.lexsort((at, s_grp, q))
            q, s_grp, lo, hi, at = q[order], s_grp[order], lo[order], hi[order], at[order]
            new = np.append(True, (q[1:] != q[:-1]) | (s_grp[1:] != s_grp[:-1]))
            first = np.flatnonzero(new)
            fresh = (new | np.append(True, at[1:] != at[:-1])).astype(np.int64)
            out.append((doc[q[first]], m[q[first]], s_grp[first], np.add.reduceat(fresh, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)))

        if len(owner):
            length = np.bincount(row)
            small = length[row] <= 48
            own, r = owner[small], row[small]
            # entries of a row are sorted by (size of piece, piece), so the first of a pair is the query
            for i, j in _pairs(r) if len(r) else ():
                q, s = own[i], own[j]
                apart = piece[q] != piece[s]
                apart &= (100 * np.minimum(m[q], m[s]) >= percent * np.maximum(m[q], m[s]))
                q, s = q[apart], s[apart]
                keep(q, grp[s], m[s], m[s], r[i[apart]])
            for at in np.flatnonzero(length > 48):
                own = owner[np.searchsorted(row, at) : np.searchsorted(row, at, "right")]
                # the members of one piece in one group stand together
                new = np.append(True, (piece[own[1:]] != piece[own[:-1]]) | (grp[own[1:]] != grp[own[:-1]]))
                first = np.flatnonzero(new)
                lo, hi = np.minimum.reduceat(m[own], first), np.maximum.reduceat(m[own], first)
                # of a query all groups of later pieces
                _, ends = np.unique(np.stack([piece_size[own], piece[own]]), axis=1, return_index=True)
                ends = np.sort(np.append(ends, len(own)))
                after = ends[np.searchsorted(ends, np.arange(len(own)), "right")]
                skip = np.searchsorted(first, after)
                for part in range(0, len(own), max(1, 2_000_000 // len(first))):
                    who = np.arange(part, min(len(own), part + max(1, 2_000_000 // len(first))))
                    n = len(first) - skip[who]
                    q = np.repeat(who, n)
                    g = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(skip[who], n)
                    keep(own[q], grp[own[first[g]]], lo[g], hi[g], np.full(len(q), at))
        if len(out) > 1:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            order = np.lexsort((cols[2], cols[0]))
            cols = [c[order] for c in cols]
            first = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])))
            cols = [cols[0][first], cols[1][first], cols[2][first], np.add.reduceat(cols[3], first), np.minimum.reduceat(cols[4], first), np.maximum.reduceat(cols[5], first)]
        else:
            cols = list(out[0]) if out else [np.empty(0, np.int64)] * 6
        return pa.table(dict(zip(["q", "mq", "grp", "shared", "lo", "hi"], [pa.array(c.astype(np.int64)) for c in cols], strict=True)))

    rows = nodes.select(*fields, "lead").mapInArrow(spread, "range long, tokens binary, owners binary, docs binary")
    return rows.groupBy("range").applyInArrow(look_up, "q long, mq long, grp long, shared long, lo long, hi long")


def need_least(percent: int) -> str:
    """SQL for a lower bound of the shared leading shingles that a query of mq needs with a set of any k in [lo, hi].

    a(k) - ceil(t m) rises with k up to m, and a(k) - ceil(t k) falls from there on but for rounding, which
    can raise or lower it by one between any two k. So the least of the ends less one holds for all k, and
    the ends themselves where they are the only ones.
    """
    need = lambda k: f"(({percent} * (mq + {k}) + {99 + percent}) div {100 + percent}) - greatest(({percent} * mq + 99) div 100, ({percent} * {k} + 99) div 100) + 1"
    return f"(least({need('lo')}, {need('hi')}) - if(hi - lo > 1, 1, 0))"


def within_bound(found: DataFrame, percent: int) -> DataFrame:
    """q, grp whose shared leading shingles allow some member of the group to reach the threshold.

    For sets of m and k shingles the overlap must reach a = ceil(t (m + k) / (1 + t)); it is at most the
    shared leading shingles plus max(ceil(t m), ceil(t k)) - 1. The gap between both, without rounding, is
    least for the least or the largest k; with it, need_least() takes a bound below that of every k.
    """
    total = found.groupBy("q", "grp").agg(F.first("mq").alias("mq"), F.sum("shared").alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = total.withColumn("lo", F.expr(f"greatest(lo, ({percent} * mq + 99) div 100)")).withColumn("hi", F.expr(f"least(hi, 100 * mq div {percent})"))
    return total.where(F.expr(f"shared >= {need_least(percent)}")).select("q", "grp")


def open_queries(rows: DataFrame, percent: int) -> DataFrame:
    """rows(grp, salt, query, doc_id, piece, piece_size, prints) -> a, b: links of queries with members of later pieces."""

    def run(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy(zero_copy_only=False)
        ids, piece, size_of = (t.column(c).to_numpy() for c in ("doc_id", "piece", "piece_size"))
        s = [unpacked(p.as_py()) for p in t.column("prints")]
        qi, si = np.flatnonzero(query), np.flatnonzero(~query)
        edges: list[tuple[int, int]] = []
        if len(qi) and len(si):
            common, size = overlaps([s[i] for i in qi], [s[i] for i in si]), np.array([len(x) for x in s])
            good = 100 * common >= percent * (size[qi][:, None] + size[si][None, :] - common)
            later = (size_of[qi][:, None] < size_of[si]) | ((size_of[qi][:, None] == size_of[si]) & (piece[qi][:, None] < piece[si]))
            forest = Forest()
            for x, y in zip(*np.nonzero(good & later), strict=True):
                a, b = piece[qi[x]], piece[si[y]]
                if forest.join(int(a), int(b)):
                    edges.append((int(a), int(b)))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy("grp", "salt").applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    table = stored(sets(docs, words), "sets")
    classes = stored(table.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    shape = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = spark.sparkContext.broadcast(sketch(table))
    reps = classes.where("class_id is not null").select(F.col("class_id").alias("doc_id")).distinct()
    lead = stored(leading(table.where("doc_id is not null"), levels, percent).join(reps.hint("merge"), "doc_id", "left_semi"), "leads")

    # groups of similar classes, by each key
    keyed = lead.select("doc_id", "m", F.posexplode("keys").alias("j", "key"))
    sizes = keyed.groupBy("j", "key").agg(F.count("*").alias("c"), F.sum("m").alias("s")).where("c > 1")
    sizes = sizes.select("j", "key", F.greatest(F.ceil(F.col("c") / GROUP), F.ceil(F.col("s") / GROUP_TOKENS)).alias("parts"), "c")
    grouped = keyed.join(sizes.hint("merge"), ["j", "key"]).select("doc_id", "j", F.xxhash64("j", "key", F.pmod(F.xxhash64("doc_id", "j"), F.col("parts"))).alias("grp"), "c")
    grouped = stored(grouped.distinct(), "groups")
    opened = grouped.join(grouped.groupBy("grp").count().where("count > 1").select("grp").hint("merge"), "grp", "left_semi")
    inside = sets_of(table, grouped).join(opened.hint("merge"), "doc_id").select("grp", "doc_id", "prints")
    first = stored(open_groups(inside, percent), "inner-links")
    pieces = stored(components(first), "pieces")
    piece_sizes = pieces.groupBy("component").agg(F.count("*").alias("piece_size"))
    pieces = pieces.join(piece_sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("piece"), "piece_size")
    # the largest of a class's groups is its row in the matrix, so that near copies with a rare key stand with the others
    home = grouped.groupBy("doc_id").agg(F.max_by("grp", F.struct("c", "grp")).alias("grp"))
    nodes = lead.select("doc_id", "m", "lead").join(pieces.hint("merge"), "doc_id", "left").join(home.hint("merge"), "doc_id", "left").select(
        "doc_id", "m", F.coalesce("piece", "doc_id").alias("piece"), F.coalesce("piece_size", F.lit(1)).alias("piece_size"),
        F.coalesce("grp", F.xxhash64(F.lit("alone"), "doc_id")).alias("grp"), "lead")
    nodes = stored(nodes, "nodes")
    remove_table(lead)

    # across groups
    ranges = max(1, -(-shape * (100 - percent) // 100 // RANGE_TOKENS))
    opens = stored(within_bound(matrix(nodes, percent, ranges), percent), "opens")
    salts = opens.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))
    asked = opens.join(salts.hint("merge"), "grp").select("grp", F.pmod(F.xxhash64("q"), F.col("salts")).alias("salt"), F.col("q").alias("doc_id"), F.lit(True).alias("query"))
    narrow = nodes.drop("lead", "m")
    members = narrow.join(salts.hint("merge"), "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "doc_id", F.lit(False).alias("query"))
    parts = stored(asked.unionByName(members).distinct(), "opened")
    rows = parts.join(narrow.select("doc_id", "piece", "piece_size").hint("merge"), "doc_id").join(sets_of(table, parts).hint("merge"), "doc_id")
    second = stored(open_queries(rows, percent), "outer-links")

    whole = components(first.unionByName(second).unionByName(pieces.where("doc_id <> piece").select(F.col("doc_id").alias("a"), F.col("piece").alias("b"))))
    named = classes.join(whole.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select("sig", "n", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = table.select("doc_id", "n", "sig").join(named.hint("merge"), ["sig", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class_id")
    out = stored(out, "similar")
    remove_table(table)
    return out
