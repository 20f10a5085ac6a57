"""The network against plain loops, its gradients against differences, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from lamina.llm import quality


def naive_score(net, text):
    raw = list((text or " ").encode("utf-8", "surrogatepass"))
    raw += [32] * max(quality.WIDTH - len(raw), -len(raw) % quality.STRIDE)
    e, f = net.p["embed"].astype(float), net.p["filters"].astype(float)
    steps = [np.concatenate([e[b] for b in raw[i : i + quality.WIDTH]]) @ f + net.p["bias"] for i in range(0, len(raw) - quality.WIDTH + 1, quality.STRIDE)]
    in_chunk = quality.CHUNK // quality.STRIDE
    stretches = [steps[i : i + quality.STRETCH] for i in range(0, len(steps), quality.STRETCH)]
    if len(stretches) > 1 and len(stretches[-1]) < quality.STRETCH // 2 and (len(stretches) - 1) * quality.STRETCH % in_chunk:
        stretches[-2:] = [stretches[-2] + stretches[-1]]
    z = np.array([np.maximum(np.max(s, 0), 0) for s in stretches])
    logit = np.concatenate([z.mean(0), z.max(0), z.min(0)]) @ net.p["out"] + net.p["out_bias"][0]
    return 1 / (1 + np.exp(-logit))


def test_score_against_loops():
    rng, net = random.Random(3), quality.Network(np.random.default_rng(2))
    texts = [None, "", "a", "some text" * 5 + "xx", "some text" * 5 + "xy", "\U0001f600 é" * 20] + ["".join(rng.choice("abc é.") for _ in range(n)) for n in (127, 128, 500, 8191, 8192, 8193, 8197, 8198, 8199, 8260, 16384, 20001)]
    got = [net.score(t) for t in texts]
    assert np.allclose(got, [naive_score(net, t) for t in texts], rtol=1e-4)
    assert got[3] != got[4]  # the last byte of an odd text counts


def test_gradients_against_differences():
    net, texts, y = quality.Network(np.random.default_rng(1)), ["word " * 90 + "end", "Some other text, not that long.", "x" * 9000 + " tail"], np.array([0.0, 1.0, 1.0])
    grads = net.step(texts, y)
    loss = lambda: -np.mean([np.log(s if t else 1 - s) for s, t in ((naive_score(net, x), t) for x, t in zip(texts, y, strict=True))])
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for i in rng.choice(np.flatnonzero(g), 3) if name != "out_bias" else [0]:
            flat, kept, h = net.p[name].reshape(-1), net.p[name].reshape(-1)[i], 1e-3
            flat[i] = kept + h
            above = loss()
            flat[i] = kept - h
            below = loss()
            flat[i] = kept
            assert np.isclose((above - below) / (2 * h), g.reshape(-1)[i], rtol=0.05, atol=2e-5), name


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, quality.train(docs, labels)


def test_held_out_accuracy(learned):
    docs, labels, model = learned
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and sum(p == q for p, q in held) / len(held) >= 0.96
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_scores_and_kept_rows_of_the_whole_table(spark, learned):
    docs, _, model = learned
    rows = docs.where("doc_id % 9 = 0").collect()
    want = {r.doc_id: naive_score(model, r.text) for r in rows}
    some = spark.createDataFrame(rows, docs.schema)
    assert all(np.isclose(r.score, want[r.doc_id], rtol=1e-3, atol=1e-4) for r in quality.score(some, model).collect())
    kept = quality.keep_good(some, model)
    border = {i for i, s in want.items() if abs(s - quality.THRESHOLD) < 1e-3}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - border == {i for i, s in want.items() if s >= quality.THRESHOLD} - border


def test_the_model_is_a_function_of_the_table(spark):
    rng = random.Random(8)
    rows = [(i % 40, "".join(rng.choice("abcdef ") for _ in range(200)) + ("!" * 9 if i % 40 % 3 == 0 else "")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert all((models[0].p[k] == models[1].p[k]).all() for k in models[0].p)


def test_odd_rows(spark, learned):
    docs, labels, model = learned
    odd = quality.score(spark.createDataFrame([(1, None, 0), (None, "", 1), (1, None, 0)], "doc_id long, text string, score int"), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    assert quality.fit([], []) == 0.5 and quality.fit(["a"], [1]) == 1.0 and quality.score(docs.limit(0), 0.5).count() == 0
    assert quality.train(docs.limit(0), labels) == 0.5
