"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import embedding_dedup, exact_dedup, html_text, mixing, ngram_join, packing, quality, secrets, sharding, warc

TOKENIZER = "byte_bpe_50k.json"
SHARD_BYTES = 256 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every showing of every document: doc_id, source, tokens, epoch, weight, block_id, block_order."""
    return mixing.mixture(_table(spark, sf_dir, "documents")).drop("copy", "digest").withColumn("weight", F.round("weight", 9))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most SHARD_BYTES, which a reader takes in one request."""
    return sharding.shard(_table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"), as_read=True)


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_temperature_mixing, op2_ngram_join, op3_extendible_sharding, op4_exact_dedup, op5_warc_normaliser,
    op6_vector_packing, op7_quality_classifier, op8_html_extraction, op9_secret_scan, op10_embedding_dedup,
)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, substr(sha256(coalesce(text, '')), 1, 32) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS copy FROM d
), t AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM r GROUP BY source
), m AS (SELECT CAST(max(total) AS DOUBLE) AS high, CAST(min(total) FILTER (total > 0) AS DOUBLE) AS low FROM t
), b(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT i + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
  FROM (SELECT i, b.low, b.high, (b.low + b.high) / 2 AS mid, pow(m.high / m.low, 1 - (b.low + b.high) / 2) <= {mixing.REPEAT_LIMIT} AS fits FROM b, m WHERE i < {mixing.STEPS})
), a AS (SELECT CASE WHEN m.high / m.low <= {mixing.REPEAT_LIMIT} THEN CASE WHEN m.high = m.low THEN 1 ELSE 0 END ELSE b.high END AS a, m.high AS top FROM b, m WHERE i = {mixing.STEPS}
), w AS (SELECT source, total, CASE WHEN total > 0 THEN pow(total / top, a) ELSE 0 END AS share, CASE WHEN total > 0 THEN greatest(total, CAST(round(pow(top / total, 1 - a) * total) AS BIGINT)) ELSE 0 END AS budget FROM t, a
), p AS (SELECT source AS s, total, budget, share / sum(share) OVER () AS weight FROM w
), e AS (
  SELECT *, unnest(range(0, CASE WHEN tokens > 0 THEN CAST(ceil(budget / total) AS BIGINT) ELSE 1 END)) AS epoch FROM r JOIN p ON s IS NOT DISTINCT FROM source
), k AS (SELECT *, sha256(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), digest, copy, epoch, '{mixing.SEED}')) AS key FROM e
), o AS (SELECT *, epoch * total + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start FROM k)
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch, round(weight, 9) AS weight,
  CASE WHEN weight > 0 THEN CAST(floor(start / greatest(weight * {float(mixing.BLOCK_TOKENS)}, 1)) AS BIGINT) ELSE 0 END AS block_id, substr(key, 33, 16) AS block_order
FROM o WHERE epoch = 0 OR start < budget
"""

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP3_SQL = f"""
WITH a AS (
  SELECT doc_id, right(list_reduce(list_transform(string_split(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15), ''),
    lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), lambda x, y: x || y), {sharding.MAX_BITS}) AS bits,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents
), l AS (
  SELECT d, substr(bits, 1, d) AS prefix, sum(bytes) AS bytes FROM (SELECT *, unnest(range(0, {sharding.MAX_BITS + 1})) AS d FROM a) GROUP BY ALL
), m AS (
  SELECT doc_id, min(d) AS d FROM (SELECT *, unnest(range(0, {sharding.MAX_BITS + 1})) AS d FROM a) x JOIN l USING (d)
  WHERE l.prefix = substr(x.bits, 1, d) AND l.bytes <= {SHARD_BYTES} GROUP BY doc_id
)
SELECT doc_id, CASE WHEN m.d = 0 THEN '-' ELSE substr(bits, 1, m.d) END AS shard_id, CAST(m.d AS INTEGER) AS depth, CAST(l.bytes AS BIGINT) AS shard_bytes
FROM a JOIN m USING (doc_id) JOIN l ON l.d = m.d AND l.prefix = substr(bits, 1, m.d)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP5_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {warc.MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc.MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM q
"""


def _op9_sql() -> str:
    def found(kind: int, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {kind} AS kind, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS s, unnest(g) AS g, unnest(gaps[1 : len(m)]) AS gap, {least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS gaps FROM d) WHERE len(m) > 0"""

    parts = "\n  UNION ALL ".join([
        found(0, secrets.ASSIGN, 2, 8), found(1, secrets.ACCESS, 0, 16), found(2, secrets.HEX, 0, 32), found(3, secrets.CANDIDATE, 0, secrets.WINDOW)])
    table = ", ".join(map(str, secrets.NLOGN))
    names = "['" + "', '".join(secrets.KINDS) + "'][kind + 1] || ':' || a || ':' || z"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({parts}),
z AS (SELECT *, CAST(sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS z FROM f),
c AS (SELECT doc_id, k, s, unnest(range(1, length(s) - {secrets.WINDOW - 2})) AS i FROM z
  WHERE kind = 3 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '{secrets.ALLOWED}')),
e AS (SELECT doc_id, k, s, i, unnest(string_split(substr(s, i, {secrets.WINDOW}), '')) AS c FROM c),
h AS (SELECT doc_id, k, s, sum(([{table}])[n + 1]) AS h FROM (SELECT doc_id, k, s, i, c, count(*) AS n FROM e GROUP BY ALL) GROUP BY doc_id, k, s, i),
g AS (SELECT doc_id, k FROM h GROUP BY doc_id, k, s
  HAVING min(h) <= CASE WHEN regexp_full_match(s, '[0-9a-f]+|[0-9A-F]+') THEN {secrets.MOST['hex']} ELSE {secrets.MOST['mixed']} END),
o AS (SELECT z.doc_id, kind, z - length(s) AS a, z FROM z LEFT JOIN g ON g.doc_id = z.doc_id AND g.k = z.k AND kind = 3
  WHERE length(z.g) >= least AND (kind < 3 OR g.k IS NOT NULL)),
j AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({names}, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg({names}, ',' ORDER BY a, kind) AS spans, count(*) FILTER (kind = 3) AS n_entropy
  FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN j USING (doc_id)
"""


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {embedding_dedup.COSINE}),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id <= coalesce(c.b, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLE_SQL = {
    "op1_temperature_mixing": OP1_SQL, "op2_ngram_join": OP2_SQL, "op3_extendible_sharding": OP3_SQL, "op4_exact_dedup": OP4_SQL,
    "op5_warc_normaliser": OP5_SQL, "op9_secret_scan": _op9_sql(), "op10_embedding_dedup": OP10_SQL,
}
