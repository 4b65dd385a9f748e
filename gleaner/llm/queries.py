"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import extracted

    return extracted(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import groups

    return groups(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_pii, op3_substring_dedup, op4_toxicity, op5_suffix_dedup, op6_mixing, op7_simhash_dedup, op8_token_counts, op9_warc, op10_decontamination)}

ORACLE_SQL = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op6_mixing": """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, rank % 3 + 1 AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT first(level ORDER BY cap / weight, source NULLS LAST) AS level FROM l WHERE level * weight <= cap),
-- Words of a block, and each source's blocks, whole passes, and words and blocks of the pass behind them.
z AS (SELECT CAST(greatest(1024, ceil(sum(source_size) / 1048576)) AS BIGINT) AS block FROM s),
t AS (SELECT source, source_size, rank, block, least(v.level * weight, CAST(cap AS DOUBLE)) AS target, CAST(round(least(v.level * weight, CAST(cap AS DOUBLE))) AS BIGINT) AS take,
  (source_size + block - 1) // block AS n, CASE WHEN source_size = 0 THEN 0 ELSE take // source_size END AS whole, take - whole * source_size AS rest, (rest + block - 1) // block AS part,
  whole * n + part AS q FROM w, v, z),
-- The splitting tree over 64 shards: a row deals one source of a node, or parts the node.
quotas AS (SELECT list(q ORDER BY rank) AS q, CAST(sum(q) AS BIGINT) AS m FROM t),
tree AS (
  SELECT 0 AS lo, 64 AS hi, q, m, 0 AS i, m AS r, (m * 32) // 64 AS c, CAST([] AS BIGINT[]) AS x FROM quotas
  UNION ALL
  SELECT CASE WHEN side = 1 THEN mid ELSE lo END, CASE WHEN side = 0 THEN mid ELSE hi END, nq, m,
    CASE WHEN side = 2 THEN i + 1 ELSE 0 END, CASE WHEN side = 2 THEN r - q[i + 1] ELSE CAST(list_sum(nq) AS BIGINT) END,
    CASE WHEN side = 2 THEN c - h WHEN side = 0 THEN (m * ((lo + mid) // 2)) // 64 - (m * lo) // 64 ELSE (m * ((mid + hi) // 2)) // 64 - (m * mid) // 64 END,
    CASE WHEN side = 2 THEN list_append(x, h) ELSE CAST([] AS BIGINT[]) END
  FROM (
    SELECT *, (lo + hi) // 2 AS mid, CASE side WHEN 0 THEN x WHEN 1 THEN list_transform(q, lambda y, j: y - x[j]) ELSE q END AS nq,
      CASE WHEN side < 2 OR r = 0 THEN 0 ELSE a + least(b - a, len(list_filter(range(1, b - a + 2), lambda j: list_sum(list_slice(ws, 1, j)) < u * list_sum(ws)))) END AS h
    FROM (
      SELECT *, list_transform(range(a, b + 1), lambda k: exp(lgamma(g + 1) - lgamma(k + 1) - lgamma(g - k + 1) + lgamma(r - g + 1) - lgamma(c - k + 1) - lgamma(r - g - c + k + 1)
        - lgamma(r + 1) + lgamma(c + 1) + lgamma(r - c + 1))) AS ws
      FROM (
        SELECT *, greatest(greatest(0, c + g - r), mode - wide) AS a, least(least(g, c), mode + wide) AS b FROM (
          SELECT *, CAST(floor((c + 1.0::DOUBLE) * (g + 1) / (r + 2)) AS BIGINT) AS mode,
            CASE WHEN r = 0 THEN 0 ELSE CAST(ceil(12 * sqrt(greatest(0, c::DOUBLE * g / r * (1 - g::DOUBLE / r) * (r - c) / greatest(1, r - 1)))) AS BIGINT) + 12 END AS wide,
            (CAST('0x' || substr(md5(concat_ws(':', 7, lo, hi, i)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS u
          FROM (SELECT *, CASE WHEN side = 2 THEN q[i + 1] ELSE 0 END AS g FROM tree, (VALUES (0), (1), (2)) AS sides(side) WHERE hi - lo > 1 AND (side = 2) = (i < len(q)))))))
),
x AS (SELECT lo AS shard, unnest(range(len(q))) AS rank, unnest(q) AS n FROM tree WHERE hi - lo = 1),
y AS (SELECT *, CAST(sum(n) OVER (PARTITION BY rank ORDER BY shard) AS BIGINT) AS upto, upto - n AS since FROM x),
runs AS (SELECT t.source, greatest(since - whole * t.n, 0) AS nth, nth + (t.n - part) * shard // 64 AS lo, lo + greatest(upto - whole * t.n, 0) - nth AS hi FROM y JOIN t USING (rank)),
p AS (SELECT d.*, t.* EXCLUDE (source),
  CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT rid, source, b, n, whole, part, rest, block, pos, size,
  CASE WHEN b = n - 1 THEN b ELSE (b * CASE WHEN (n - 1) % 1000003 = 0 THEN 999983 ELSE 1000003 END + 7 + whole) % (n - 1) END AS place
  FROM (SELECT *, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS b FROM p WHERE size > 0 AND rest > 0)),
f AS (SELECT rid, CAST(sum(greatest(0, least(b * block + CASE WHEN place - lo + nth = part - 1 THEN rest - (part - 1) * block ELSE block END, pos + size) - greatest(b * block, pos))) AS BIGINT) AS n
  FROM o JOIN runs ON o.source IS NOT DISTINCT FROM runs.source AND place >= lo AND place < hi GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(whole * size + coalesce(f.n, 0) AS BIGINT) AS taken FROM p LEFT JOIN f USING (rid)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
""",
}
