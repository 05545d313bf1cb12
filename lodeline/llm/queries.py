"""The digest queries of this subpackage's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import chat_format, decontaminate, embed_dedup, lang_id, license_scan, lm_score, mixing, quality, simhash, token_output
from lodeline.llm.common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return lm_score.score(spark, docs)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(same).alias("text"),
    )
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(probe)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(remainder("doc_id", 3) != 1))
    found = lang_id.predict(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_vectors(spark, table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = token_output.write_tokens(spark, table(spark, sf_dir, "documents"), tokenizer_path())
    return token_output.read_tokens(folder, index)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spark, table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(spark, table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_license_scan, op3_lm_score, op4_chat_format, op5_language_id, op6_embedding_near_dedup, op7_token_output, op8_simhash_near_dedup, op9_mix_sources, op10_quality_classifier)}


#: Renders the conversations, parses what it rendered and counts that.
OP4 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (
  SELECT *, CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'ANS' WHEN 'system' THEN 'SYS' ELSE 'ROLE' END AS mark,
         regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*(/?(INST|ANS|SYS|ROLE)|TEXT)\])', '[\\\1', 'g') AS shown_role,
         regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*(/?(INST|ANS|SYS|ROLE)|TEXT)\])', '[\\\1', 'g') AS shown_text
  FROM rows),
formatted AS (
  SELECT conv_id, '<s>' || string_agg('[' || mark || ']' || CASE mark WHEN 'ROLE' THEN shown_role || '[TEXT]' ELSE '' END || shown_text || '[/' || mark || ']', ''
                                      ORDER BY turn NULLS FIRST, role, text) || '</s>' AS f
  FROM coded GROUP BY conv_id),
pieces AS (SELECT conv_id, f, regexp_extract_all(f, '(?s)\[(?:INST|ANS|SYS|ROLE)\].*?\[/(?:INST|ANS|SYS|ROLE)\]') AS turns FROM formatted),
turns AS (SELECT conv_id, unnest(turns) AS t, generate_subscripts(turns, 1) AS n FROM pieces),
cut AS (
  SELECT conv_id, n, regexp_extract(t, '^\[([A-Z]+)\]', 1) AS mark, regexp_replace(t, '(?s)^\[[A-Z]+\](.*)\[/[A-Z]+\]$', '\1') AS inner_text FROM turns),
sides AS (
  SELECT conv_id, n, CASE mark WHEN 'INST' THEN 'user' WHEN 'ANS' THEN 'assistant' WHEN 'SYS' THEN 'system' ELSE regexp_replace(inner_text, '(?s)\[TEXT\].*$', '') END AS role,
         CASE mark WHEN 'ROLE' THEN substr(inner_text, position('[TEXT]' IN inner_text) + 6) ELSE inner_text END AS text
  FROM cut),
read AS (
  SELECT conv_id, n,
         regexp_replace(regexp_replace(role, '<\\(\\*/?s>)', '<\1', 'g'), '\[\\(\\*(/?(INST|ANS|SYS|ROLE)|TEXT)\])', '[\1', 'g') AS role,
         regexp_replace(regexp_replace(text, '<\\(\\*/?s>)', '<\1', 'g'), '\[\\(\\*(/?(INST|ANS|SYS|ROLE)|TEXT)\])', '[\1', 'g') AS text
  FROM sides)
SELECT r.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       CAST(max(length(f)) AS BIGINT) AS formatted_chars,
       true AS round_trip
FROM read r JOIN formatted p ON r.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY r.conv_id
"""

#: Sources by code point, in turn 3, 1 and 2; the level by running sums; cuts by running sums in hash order.
OP9 = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR) || ':mix') AS key
  FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * CAST(2.0 AS DOUBLE) AS stop,
         CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM total),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) * CAST(1.5 AS DOUBLE)
             - coalesce(sum(stop) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / ((SELECT sum(weight) FROM weighed)
             - coalesce(sum(weight) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM weighed),
free AS (SELECT max(CASE WHEN NOT (stop <= level * weight) THEN level END) AS free FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN stop <= level * weight OR free IS NULL THEN stop ELSE free * weight END AS target
  FROM levels, free),
placed AS (
  SELECT doc_id, size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4, "op9_mix_sources": OP9}
