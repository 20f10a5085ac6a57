"""The whole pipeline against plain Python: every stage on what the one before keeps."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import brute_components
from test_mixing import brute as brute_mixture
from test_quality import naive_score

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage of one run, and a model fitted as the first stage fits its own."""
    import corpus_pipeline
    from lamina.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, write = [docs], corpus_pipeline.stored

    def kept(df, label):
        table = write(df, label)
        if label.startswith("stage-"):
            out.append(table)
        return table

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "stored", kept)
        last = corpus_pipeline.run(spark, SF)
    assert len(out) == 1 + len(corpus_pipeline.STAGES) and last is out[-1]
    return [x.collect() for x in out], [x.columns for x in out], quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_columns_and_order(stages):
    import corpus_pipeline

    _, columns, _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    assert all(c == columns[0] for c in columns[:-1])


def test_quality_stage(stages):
    (docs, kept, *_), _, model = stages
    scores = {r.doc_id: naive_score(model, r.text) for r in docs}
    assert all(abs(s - 0.7) > 1e-3 for s in scores.values())
    assert sorted(kept) == sorted(r for r in docs if scores[r.doc_id] >= 0.7) and 0.7 * len(docs) < len(kept) < len(docs)


def test_exact_dedup_stage(stages):
    (_, before, after, *_), _, _ = stages
    first = {}
    for r in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(after) == sorted(first.values()) and len(after) < len(before)


def test_join_stage(stages):
    (_, _, before, after, *_), _, _ = stages
    found = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(after) == sorted(r for r in before if found[r.doc_id][1] == r.doc_id)


def test_mixing_stage(stages):
    import lamina.llm.mixing as mixing

    (_, _, _, before, after, _), _, _ = stages

    def fits(tokens, a):
        some = [t for t in tokens.values() if t]
        return (max(some) / min(some)) ** (1 - a) <= mixing.REPEAT_LIMIT

    want, _ = brute_mixture([(r.doc_id, r.text, r.source) for r in before], fits, mixing.BLOCK_TOKENS)
    assert Counter(r.doc_id for r in after) == Counter(w[0] for w in want) and {r.doc_id for r in after} == {r.doc_id for r in before}
    assert [r.doc_id for r in after] == [w[0] for w in sorted(want, key=lambda w: (w[4], w[5]))]  # in the order of blocks


def test_packing_stage(stages):
    from lamina.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    (*_, before, pieces), _, _ = stages
    library = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in before}
    shown, covered, sequences = Counter(r.doc_id for r in before), defaultdict(Counter), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        covered[p.doc_id].update(range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {i: set(c.values()) for i, c in covered.items()} == {i: {n} for i, n in shown.items()} and all(len(covered[i]) == len(ids[i]) for i in shown)
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 1024
    total = sum(sum(n for _, n in s) for s in sequences.values())
    full = sum(1 << math.ceil(math.log2(sum(n for _, n in s))) for s in sequences.values())
    assert total == sum(len(ids[r.doc_id]) for r in before) and full <= 1.02 * total


def test_stages_take_odd_tables(spark):
    """Nulls, empty texts, repeated rows, no rows, and columns that the stages use themselves."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, place_ int, kept boolean"
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, "x", 1, True), (1, "", "en", "a", 0, "x", 1, True), (2, "some words of a text", None, "b", 3, None, None, None), (2, "other words", "en", None, 3, None, None, None)]
    odd, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert {r.text for r in out.collect()} >= {r[1] for r in rows} - ({None} if name == "exact dedup" else set()), name
    for name, stage in corpus_pipeline.STAGES:
        if name not in ("quality classifier", "n-gram Jaccard join"):  # whose operators have their own tests of empty tables
            assert stage(spark, none, SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() >= len(rows)
