"""One query per operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import decontaminate, jaccard, mixing, quality, repeats, secret_scan, sharding, token_count, toxicity, url_filter
from confab.llm.common import shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, similarity of every benchmark item found in a document."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, file, start of every document."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, threshold=0.9)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: shipped(f) for f in (op1_decontamination, op2_quality, op3_url_filter, op4_secrets, op5_token_counts, op6_toxicity, op7_mixing, op8_sharding, op9_ngram_jaccard, op10_substring_dedup)}

#: Words as the contracts define them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op9_ngram_jaccard": f"""WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS l FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]))) END AS s FROM w),
reps AS MATERIALIZED (SELECT s, min(doc_id) AS rep, len(s) AS n, (row_number() OVER ())::int AS node FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS MATERIALIZED (SELECT node, unnest(s) AS g FROM reps),
shared AS MATERIALIZED (SELECT node, n, (dense_rank() OVER (ORDER BY g))::int AS g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM grams) JOIN reps USING (node) WHERE c > 1),
links AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM shared a JOIN shared b ON a.g = b.g AND a.node <> b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT node, node FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
named AS (SELECT reach.a AS node, min(r.rep) AS component_id FROM reach JOIN reps r ON r.node = reach.b GROUP BY reach.a)
SELECT d.doc_id, len(d.s)::bigint AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN reps r ON r.s = d.s LEFT JOIN named c ON c.node = r.node""",
    "op10_substring_dedup": f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS l FROM documents),
starts AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(l) - 18)) AS p, unnest(list_transform(range(1, len(l) - 18), lambda i: md5(array_to_string(l[i:i + 19], ' ')))) AS h FROM w WHERE len(l) >= 20),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY h) AS late FROM starts) WHERE late),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 20)))) AS g FROM later GROUP BY doc_id),
kept AS (SELECT w.doc_id, l, coalesce(g, []) AS g FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(l)::bigint AS n_words, len(g)::bigint AS n_removed,
  sha256(array_to_string(CASE WHEN len(g) = 0 THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256 FROM kept""",
    "op8_sharding": """WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::bigint, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS MATERIALIZED (SELECT r, doc_id, strlen(text) + 1 AS size, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(text) + 1),
    lambda i: (16 * (position(substr(h, 2 * i - 1, 1) IN '0123456789ABCDEF') - 1) + position(substr(h, 2 * i, 1) IN '0123456789ABCDEF') - 1)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc FROM d, steps),
jumps(r, n, k, b, j) AS (
  SELECT r, n, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 16))::ubigint::hugeint, -1::bigint, 0::bigint FROM d, (VALUES (16), (17)) s(n)
  UNION ALL SELECT r, n, k2, j, floor((j + 1)::double * (2147483648.0::double / ((k2 // 8589934592) + 1)::double))::bigint
  FROM (SELECT *, (k * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint AS k2 FROM jumps WHERE j < n)),
placed AS (SELECT r, max(b) FILTER (n = 16) AS shard, max(b) FILTER (n = 17) AS grown FROM jumps WHERE j >= n GROUP BY r)
SELECT doc_id, size::bigint AS size, crc AS text_crc32, 'key' AS law, shard::int AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::varchar, '') || ':' || crc), doc_id) - 1)::bigint AS slot, grown::int AS grown_shard
FROM sums JOIN placed USING (r)""",
}
