"""The entropy scan against counts made anew for every window."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lamina.llm import secrets


def least_sum(text):
    """Every window counted from nothing."""
    return min(sum(secrets.NLOGN[n] for n in Counter(text[i : i + secrets.WINDOW]).values()) for i in range(len(text) - secrets.WINDOW + 1))


def test_least_sum_of_windows(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (20, 21, 39, 41, 400, 6000) for alphabet in (secrets.ALPHABET, "0123456789abcdef", "ab1", "a")]
    got = spark.createDataFrame([(t,) for t in [*texts, "short", ""]], "s string").select(secrets.least_sum(F.col("s"))).collect()
    assert [r[0] for r in got] == [*map(least_sum, texts), None, None]


def test_entropy_spans_of_long_and_non_ascii_texts(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET) for _ in range(n))
    texts = [f"é\U0001f600 {key(30)} 日本 {'ab' * 40}1 {key(19)}", "x" * 70_000 + " ü" + key(5_000) + ". " + "deadbeef01" * 30, "1a" * 4_000 + key(25)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.scan(docs).collect():
        want = []
        for m in re.finditer(secrets.CANDIDATE, texts[r.doc_id]):
            s = m[0]
            mixes = re.search("[0-9]", s) and re.search("[A-Za-z]", s) and not re.search(secrets.ALLOWED, s)
            kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "mixed"
            if mixes and math.log2(secrets.WINDOW) - least_sum(s) / 1e6 / secrets.WINDOW >= secrets.THRESHOLD[kind]:
                want.append(f"entropy:{m.start()}:{m.end()}")
        assert [x for x in r.spans.split(",") if x.startswith("entropy")] == want and r.n_entropy == len(want), r.doc_id


def test_a_candidate_of_a_million_characters_ends(spark):
    rng = random.Random(7)
    text = "id " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.spans == f"entropy:3:{len(text)}"
