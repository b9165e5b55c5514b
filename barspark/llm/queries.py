"""The ten operators as queries over whole tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import html_extract, mixing, near_dup, packing, quality, secret_scan, sharding, token_count, token_store, top_k

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.quality_ledger(_table(spark, sf_dir, "documents"))
    return quality.apply_policy(ledger).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, alone and in all, by bits of the ledger."""
    return quality.ablation(quality.quality_ledger(_table(spark, sf_dir, "documents")), "v1")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8).select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "law", "shard", "slot", "grown_shard"
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), columns=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def queries() -> dict[str, Query]:
    found = (
        op1_best_fit_packing, op2_quality_rules, op3_token_store, op4_near_dedup, op5_sharding,
        op6_source_mixing, op7_html_extraction, op8_exact_top_k, op9_secret_scan, op10_token_counts,
        quality_ablation,
    )
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM base),
tok AS (
  SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
tri AS (
  SELECT rid, pos, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o AS t
  FROM tok WINDOW o AS (PARTITION BY rid ORDER BY pos)),
hit AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, t) AS c FROM tri WHERE t IS NOT NULL) WHERE c > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM hit) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
bits AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 3 * n_words)::BIGINT
    + 8 * (word_chars > 10 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT
    + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 64 * (n_words > 100000)::BIGINT + 128 * (n_words = 0)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept, fail_bits
FROM bits
"""

ABLATION_SQL = f"""
WITH ledger AS ({OP2_SQL}),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {1 << quality.RULE_NAMES.index(r)})" for r in quality.POLICIES["v1"])}) AS v(rule, bit)),
b AS (SELECT fail_bits & 63 AS bits FROM ledger)
SELECT rule, count(*) FILTER (WHERE bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE bits = bit) AS n_only_this,
  count(*) FILTER (WHERE bits = 0 OR bits = bit) AS n_kept_without
FROM b, rules GROUP BY rule
"""

OP4_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM base),
one AS (SELECT doc_id, unnest(s) AS h FROM sh),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM pairs JOIN sh a ON a.doc_id = u JOIN sh b ON b.doc_id = v
  WHERE 100 * n_both >= 75 * (len(a.s) + len(b.s) - n_both)),
sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM sh UNION SELECT reach.doc_id, sym.v FROM reach JOIN sym ON reach.r = sym.u),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sh JOIN comp USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
w AS (
  SELECT *, ([5, 2, 1])[rnk % 3 + 1]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS stop FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 150 / 100.0::DOUBLE
      - coalesce(sum(stop) OVER (ORDER BY stop / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, level * weight >= stop AS stops FROM l),
t AS (
  SELECT *, CASE WHEN stops THEN stop
    ELSE first_value(level) OVER (ORDER BY stops, stop / weight, rnk) * weight END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + (('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 < rate - floor(rate))::BIGINT)
    * size AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

OP8_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": OP2_SQL,
        "quality_ablation": ABLATION_SQL,
        "op4_near_dedup": OP4_SQL,
        "op6_source_mixing": OP6_SQL,
        "op8_exact_top_k": OP8_SQL,
    }
