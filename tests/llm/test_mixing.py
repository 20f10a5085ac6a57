"""Mixing against a version over Python lists."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from lamina.llm import mixing

SCHEMA = "doc_id long, text string, source string, weight int, key string, epoch int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def corpus():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), "big") for i in range(300)] + [(1000 + i, "x y " * rng.randrange(1, 9), f"s{i % 7}") for i in range(60)]
    return rows + [(5, "w w", "big")] * 3 + [(5, "other", "big"), (None, "a b", None), (None, None, None), (7000, None, "empty"), (7001, "", "empty"), (7000, None, "empty"), (1, "a", "=")]


def weights(tokens, exponent):
    raised = {s: (t / max(tokens.values())) ** exponent if t else 0.0 for s, t in tokens.items()}
    return {s: r / sum(raised.values()) for s, r in raised.items()}


def entropy(share):
    return -sum(w * math.log(w) for w in share.values() if w)


def brute(rows, fits, block):
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    some = [t for t in tokens.values() if t]
    low, high = 0.0, 1.0
    if fits(tokens, 0.0):
        high = 0.0
    for _ in range(60 if high else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(tokens, mid) else (mid, high)
    share, seen, streams, out = weights(tokens, high), Counter(), defaultdict(list), []
    for doc, text, source in rows:
        n, digest = len((text or "").split()), hashlib.sha256((text or "").encode()).hexdigest()[:32]
        shown = (max(some) / tokens[source]) ** (1 - high) if tokens[source] else 1
        budget = max(tokens[source], round(shown * tokens[source]))
        for epoch in range(math.ceil(budget / tokens[source]) if n else 1):
            key = hashlib.sha256(f"{'' if doc is None else doc}|{digest}|{seen[doc, source, digest]}|{epoch}|{mixing.SEED}".encode()).hexdigest()
            streams[source, budget].append((epoch, key, doc, n))
        seen[doc, source, digest] += 1
    for (source, budget), stream in streams.items():
        at = 0
        for epoch, key, doc, n in sorted(stream, key=lambda x: x[:2]):
            if not epoch or at < budget:
                out.append((doc, source, n, epoch, math.floor(at / max(share[source] * block, 1)) if share[source] else 0, key[32:48]))
            at += n
    return sorted(out, key=str), share


@pytest.mark.parametrize("repeat, target", [(3.0, None), (None, 1.2), (1000.0, 0.01)])
def test_mixture_against_lists(spark, repeat, target):
    rows = corpus()

    def fits(tokens, a):
        some = [t for t in tokens.values() if t]
        return (repeat is None or (max(some) / min(some)) ** (1 - a) <= repeat) and (target is None or entropy(weights(tokens, a)) <= target)

    want, share = brute(rows, fits, 400)
    for docs in (table(spark, rows), table(spark, rows[::-1]).repartition(7))[: 2 if target is None else 1]:
        got = mixing.mixture(docs, repeat, target, block_tokens=400).collect()
        assert sorted(((r.doc_id, r.source, r.tokens, r.epoch, r.block_id, r.block_order) for r in got), key=str) == want
        assert all(math.isclose(r.weight, share[r.source], rel_tol=1e-9) for r in got)
    assert len({x[4] for x in want}) > 5


def test_block_quotas(spark):
    """A block holds its share of each source, but for the documents across its border."""
    got = mixing.mixture(table(spark, corpus()), 2.0, block_tokens=2000).collect()
    held, last = Counter(), max(r.block_id for r in got)
    for r in got:
        held[r.block_id, r.source] += r.tokens
    for r in got:
        if r.block_id < last and r.weight and held[r.block_id + 1, r.source]:
            assert abs(held[r.block_id, r.source] - r.weight * 2000) <= 60


def test_equal_rows_beyond_one_portion(spark):
    rows = [(3, "a b", "s")] * (2 * mixing.COPIES + 5) + [(4, "c", "t")]
    got = mixing.mixture(table(spark, rows), 1.0).collect()
    assert Counter(r.doc_id for r in got) == {3: len(rows) - 1, 4: 1} and {r["copy"] for r in got if r.doc_id == 3} == set(range(len(rows) - 1))


def test_only_empty_texts(spark):
    got = mixing.mixture(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.weight, r.block_id, r.epoch) for r in got) == [(1, 0.0, 0, 0), (2, 0.0, 0, 0)]
