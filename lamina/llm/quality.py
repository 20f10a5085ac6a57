"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte becomes a
learned vector; learned filters slide over a chunk in steps of STRIDE bytes, so a passage can give
other features at an odd than at an even place; a text is padded by spaces to whole steps. They go
through a rectifier and are max-pooled over short stretches. Of the stretches of the whole document the
mean, the maximum and the minimum of each filter are taken (where passages repeat, the last two are
close), and a logistic layer combines them into one probability. Training is by Adam on the logistic loss,
with the same pooling over the same chunks.

Fitting takes a bounded sample: at most TRAIN_DOCS labelled documents, those with the least hash of
doc_id, as long as their texts have at most TRAIN_BYTES together, and of each the whole text. Of texts
with one doc_id the one with the least digest is taken. Scoring reads every byte. The score never sees
labels, lang, source or doc_id.

Defined results: null and empty texts are scored as a text of one space. Rows with null doc_id are
scored, as not held out. Repeated rows are scored alike. If no label can be learned from, or all are
equal, every score is the share of label 1 (0.5 without any). An empty table gives an empty result.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 1500
TRAIN_BYTES = 64 << 20
TRAIN_STEPS = 200
THRESHOLD = 0.7
CHUNK = 1 << 13
STRETCH = 64  # positions pooled together
STRIDE = 2
WIDTH = 8
DIM = 8
FILTERS = 16
SEED = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def chunks(text: str | None) -> Iterator[np.ndarray]:
    """Overlapping pieces of a text's bytes that cover all of it, padded to whole steps."""
    raw = np.frombuffer((text or " ").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw), CHUNK):
        b = raw[at : at + CHUNK + WIDTH - STRIDE]
        if at and len(b) <= WIDTH - STRIDE:
            return  # the piece before holds it
        if short := max(WIDTH - len(b), -len(b) % STRIDE):
            b = np.concatenate([b, np.full(short, 32, np.uint8)])
        yield b


class Network:
    def __init__(self, rng: np.random.Generator):
        n = WIDTH * DIM
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": (rng.normal(0, 1, (n, FILTERS)) / np.sqrt(n)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": (rng.normal(0, 1, 3 * FILTERS) * 0.1).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def table(self) -> np.ndarray:
        """What each pair of bytes adds to the filters at every offset."""
        if not hasattr(self, "_table"):
            f = self.p["filters"].reshape(WIDTH // STRIDE, STRIDE, DIM, FILTERS)
            one = np.einsum("vd,ksdf->svkf", self.p["embed"], f).reshape(STRIDE, 256, -1)
            self._table = (one[0][None, :, :] + one[1][:, None, :]).reshape(1 << 16, -1).astype(np.float32)  # little-endian: the first byte is the low one
        return self._table

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def filtered(self, b: np.ndarray) -> np.ndarray:
        """The filters at every step of a chunk."""
        x = self.table().take(np.ascontiguousarray(b).view("<u2"), 0)
        steps = len(x) - WIDTH // STRIDE + 1
        y = x[:steps, :FILTERS] + self.p["bias"]
        for k in range(1, WIDTH // STRIDE):
            y += x[k : k + steps, k * FILTERS : (k + 1) * FILTERS]
        return y

    def pooled(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest rectified value of each filter in each stretch of a chunk, and the step that has it."""
        y = self.filtered(b)
        # a last stretch under half a stretch belongs to the one before
        cut = np.arange(0, max(1, len(y) - STRETCH // 2 + 1), STRETCH)
        ends = np.append(cut[1:], len(y))
        whole = len(cut) - 1
        best = np.empty((len(cut), FILTERS), np.int64)
        best[:whole] = y[: whole * STRETCH].reshape(-1, STRETCH, FILTERS).argmax(1)
        best[whole] = y[cut[whole] : ends[whole]].argmax(0)
        best += cut[:, None]
        return np.maximum(np.take_along_axis(y, best, 0), 0), best

    def score(self, text: str | None) -> float:
        total, most, least, n = np.zeros(FILTERS), np.zeros(FILTERS), np.full(FILTERS, np.inf), 0
        for b in chunks(text):
            z = self.pooled(b)[0]
            total += z.sum(0)
            most, least = np.maximum(most, z.max(0)), np.minimum(least, z.min(0))
            n += len(z)
        logit = float(np.concatenate([total / n, most, least]) @ self.p["out"] + self.p["out_bias"][0])
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))

    def step(self, texts: list[str | None], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over whole texts."""
        self.__dict__.pop("_table", None)
        p, zs, codes, sizes = self.p, [], [], []
        for text in texts:
            n = 0
            for b in chunks(text):
                z, best = self.pooled(b)
                zs.append(z)
                codes.append(b[best[:, :, None] * STRIDE + np.arange(WIDTH)].astype(np.int64))
                n += len(z)
            sizes.append(n)
        z, codes, sizes = np.concatenate(zs), np.concatenate(codes), np.array(sizes)
        start = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        mean = np.add.reduceat(z, start) / sizes[:, None]
        most, least = np.maximum.reduceat(z, start), np.minimum.reduceat(z, start)
        feats = np.concatenate([mean, most, least], 1)
        s = 1 / (1 + np.exp(-np.clip(feats @ p["out"] + p["out_bias"], -60, 60)))
        d_logit = ((s - y) / len(y)).astype(np.float32)
        d_mean, d_most, d_least = np.split(d_logit[:, None] * p["out"], 3, axis=1)
        d_z = (d_mean / sizes[:, None])[owner]
        for value, d in ((most, d_most), (least, d_least)):
            tied = z == value[owner]  # stretches that share an extreme share its gradient
            d_z += tied * (d / np.add.reduceat(tied, start, dtype=np.int64))[owner]
        d_z *= z > 0
        by_filter = p["filters"].reshape(WIDTH, DIM, FILTERS)
        # codes: stretch, filter, byte of the window
        d_filters = np.empty_like(by_filter)
        d_embed = np.zeros((256, DIM))
        for w in range(WIDTH):
            c = codes[:, :, w]
            d_filters[w] = np.einsum("sf,sfd->df", d_z, p["embed"][c])
            at = (c * FILTERS + np.arange(FILTERS)).ravel()
            d_embed += np.bincount(at, d_z.ravel(), 256 * FILTERS).reshape(256, FILTERS) @ by_filter[w].T
        return {"embed": d_embed, "filters": d_filters.reshape(WIDTH * DIM, FILTERS), "bias": d_z.sum(0), "out": feats.T @ d_logit, "out_bias": np.array([d_logit.sum()])}


def fit(texts: list[str | None], labels: list[int], steps: int = TRAIN_STEPS, batch: int = 64, rate: float = 0.02) -> Network | float:
    """A trained network, or the share of label 1 where there is nothing to tell apart."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return float(y.mean()) if len(y) else 0.5
    rng, net = np.random.default_rng(SEED), Network(np.random.default_rng(SEED))
    low, high = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(low, batch // 2), rng.choice(high, batch // 2)])
        grads = net.step([texts[i] for i in pick], y[pick])
        now = rate * (1 - (t - 1) / steps) ** 0.5
        for k, g in grads.items():
            g = g.astype(np.float32) + (1e-4 * net.p[k] if k in ("filters", "out") else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] -= now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
    net.__dict__.pop("_table", None)
    return net


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Network | float:
    """Fit on at most `limit` labelled documents that are not held out, with at most `most_bytes` of text."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    # The ids are at most `limit`, so they may be broadcast.
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r.quality, i) for i, r in enumerate(known)], "doc_id long, quality int, place int"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").withColumn("digest", F.sha2("text", 256))
    sizes = texts.groupBy("doc_id", "place").agg(F.min(F.struct("digest", F.octet_length("text").alias("bytes"))).alias("least")).collect()
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: r.place):
        total += r.least.bytes
        if total > most_bytes and chosen:
            break
        chosen.append((r.doc_id, r.least.digest))
    picked = spark.createDataFrame(chosen, "doc_id long, digest string")
    sample = texts.join(F.broadcast(picked), ["doc_id", "digest"]).select("place", "quality", "text").dropDuplicates(["place"]).collect()
    sample.sort(key=lambda r: r.place)
    return fit([r.text for r in sample], [r.quality for r in sample])


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            texts = batch.column("text")
            scores = [net if isinstance(net, float) else net.score(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose text scores at least the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            good = [(net if isinstance(net, float) else net.score(t.as_py())) >= threshold for t in batch.column("text")]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
