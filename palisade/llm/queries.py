"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import alignment, byte_pairs, decontamination, langid, lines, mixing, order_minhash, passages, simhash, substrings, tool_calls, urls, vantage, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link(*tool_calls.from_conversations(_table(spark, sf_dir, "conversations")), tool_calls.CHAT_SCHEMAS)
    return out.select(
        "conv_id", "call_id", "status", "position", "result_position", "name", "n_calls", "n_results", F.col("level").cast("long").alias("level"), "place", "valid",
        F.array_join("errors", "; ").alias("errors"), F.md5("canonical").alias("canonical_md5"), F.md5("content").alias("content_md5"),
    )


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(_table(spark, sf_dir, "documents"))
    spans = [_spans(F.col(c)).alias(c) for c in ("removed_spans", "passage_spans")]
    return out.select("doc_id", "n_units", "n_removed", "n_passages", *spans, F.col("kept_text").alias("text"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), (s["end"] - s["start"]).cast("string"))), ",")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"), spans.alias("removed_spans"))


def op5_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op6_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_simhash_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_url_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    planted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vantage.hard_negatives(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), planted.alias("label")), F.col("id") % 50 == 0)


def op13_byte_pair_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_tool_call_linking": op1_tool_call_linking,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_wrapper_extraction": op5_wrapper_extraction,
    "op6_capped_water_filling": op6_capped_water_filling,
    "op7_simhash_ball_hashing": op7_simhash_ball_hashing,
    "op8_url_boosted_trees": op8_url_boosted_trees,
    "op9_order_minhash": op9_order_minhash,
    "op10_language_bitmask": op10_language_bitmask,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_vantage_negatives": op12_vantage_negatives,
    "op13_byte_pair_prefixes": op13_byte_pair_prefixes,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_tool_call_linking": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
raw_calls AS (
  SELECT conv_id, 'call-' || conv_id || '-' || CASE WHEN again THEN turn - 2 ELSE turn END AS call_id, turn,
         CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, text, words, words % 11 = 5 AS broken, words % 13 = 3 AS typed,
         CASE WHEN words IS NOT NULL AND NOT again AND floor(turn / 8) = floor((turn + ahead) / 8) THEN 'call-' || conv_id || '-' || (turn + ahead) END AS need
  FROM (SELECT *, coalesce(words % 17 = 6 AND turn >= 2, false) AS again, CASE WHEN words % 2 = 1 THEN 2 ELSE -2 END AS ahead FROM m WHERE role IN ('user', 'system'))),
calls AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS n_calls FROM raw_calls
  QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, words, text) = 1),
edges AS (
  SELECT c.conv_id, c.call_id, c.turn AS own, n.call_id AS need, n.turn AS other
  FROM calls c JOIN calls n ON n.conv_id = c.conv_id AND n.call_id = c.need),
chains(conv_id, call_id, steps) AS (
  SELECT conv_id, call_id, 0 FROM calls ANTI JOIN edges USING (conv_id, call_id)
  UNION ALL SELECT e.conv_id, e.call_id, steps + 1 FROM chains c JOIN edges e ON e.conv_id = c.conv_id AND e.need = c.call_id),
levels AS (
  SELECT conv_id, call_id, CASE WHEN conv_id IN (SELECT conv_id FROM edges WHERE other > own) THEN steps ELSE 0 END AS level
  FROM calls LEFT JOIN chains USING (conv_id, call_id)),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn) AS place,
    CASE WHEN text IS NULL THEN CASE WHEN name = 'ask' THEN '$.text: missing; $.words: missing' ELSE '$.text: missing' END
         WHEN broken THEN '$: no JSON'
         WHEN name = 'ask' THEN concat_ws('; ', CASE WHEN length(text) NOT BETWEEN 20 AND 1000 THEN '$.text: length' END,
                                          CASE WHEN typed THEN '$.words: not integer' WHEN words NOT BETWEEN 3 AND 150 THEN '$.words: out of range' END)
         ELSE concat_ws('; ', CASE WHEN length(text) < 1 THEN '$.text: length' END, CASE WHEN typed THEN '$.words: not integer' END) END AS errors,
    CASE WHEN broken THEN NULL ELSE '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) || ',"words":' || CASE WHEN typed THEN '"' || words || '"' ELSE words::VARCHAR END END
      || '},"id":"' || call_id || '","name":"' || name || '"}' END AS canonical
  FROM calls JOIN levels USING (conv_id, call_id)),
replies AS (
  SELECT conv_id, call_id, turn, count(*) OVER (PARTITION BY conv_id, call_id) AS n_results, text AS content
  FROM (SELECT *, 'call-' || conv_id || '-' || CASE WHEN words % 7 = 4 THEN turn + 1 ELSE turn - 1 END || CASE WHEN words % 7 = 2 THEN 'x' ELSE '' END AS call_id FROM m WHERE role = 'assistant')
  QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text NULLS FIRST) = 1)
SELECT conv_id, call_id,
       CASE WHEN j.name IS NULL THEN 'orphan' WHEN r.n_results IS NULL THEN 'unanswered' WHEN r.turn < j.turn THEN 'early' ELSE 'linked' END AS status,
       j.turn::BIGINT AS position, r.turn::BIGINT AS result_position, j.name AS name, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       level::BIGINT AS level, place, errors = '' AS valid, errors, md5(canonical) AS canonical_md5, md5(content) AS content_md5
FROM judged j FULL JOIN replies r USING (conv_id, call_id)
""",
    "op3_line_dedup": r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
parts AS (SELECT r, doc_id, string_split(text, chr(10)) AS ps FROM rows),
units AS (SELECT r, doc_id, unnest(range(len(ps))) AS n, unnest(ps) AS u FROM parts),
placed AS (
  SELECT *, sum(length(u) + 1) OVER (PARTITION BY r ORDER BY n) - length(u) - 1 AS pos,
         trim(regexp_replace(lower(u), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM units),
ranked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, r, n) > 1 AS gone FROM placed),
line AS (SELECT *, coalesce(max(n) FILTER (NOT gone) OVER (PARTITION BY r), -1) AS last FROM ranked),
cut AS (
  SELECT r, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
         string_agg(pos || ':' || length(u), ',' ORDER BY n) FILTER (gone) AS spans FROM line GROUP BY r),
low AS (SELECT r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM rows WHERE text IS NOT NULL),
split AS (
  SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         CASE WHEN regexp_matches(t, '^[\x20\x09-\x0D]') THEN regexp_extract_all(t, '[\x20\x09-\x0D]+') ELSE list_prepend('', regexp_extract_all(t, '[\x20\x09-\x0D]+')) END AS seps FROM low),
each AS (SELECT r, doc_id, len(ws) AS m, unnest(range(len(ws))) AS i, unnest(ws) AS w, unnest(seps[1:len(ws)]) AS sep FROM split),
word AS (SELECT *, sum(length(sep) + length(w)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS z FROM each),
win AS (
  SELECT r, doc_id, i, z, z - length(w) AS a, CASE WHEN i <= m - {n} THEN string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n} - 1 FOLLOWING) END AS run FROM word),
again AS (
  SELECT *, run IS NOT NULL AND (first_value(r) OVER g <> r OR i >= first_value(i) OVER g + {n}) AS late
  FROM win WINDOW g AS (PARTITION BY run ORDER BY doc_id NULLS LAST, r, i)),
hit AS (SELECT *, max(late::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n} - 1 PRECEDING AND CURRENT ROW) AS h FROM again),
passage AS (
  SELECT r, min(a) AS a, max(z) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run_no FROM hit WHERE h = 1) GROUP BY r, run_no),
passages AS (SELECT r, count(*) AS n_passages, string_agg(a || ':' || (z - a), ',' ORDER BY a) AS spans FROM passage GROUP BY r),
gap AS (
  SELECT r, CASE WHEN n < last THEN pos ELSE greatest(0, pos - 1) END AS a, pos + length(u) + CASE WHEN n < last THEN 1 ELSE 0 END AS z FROM line WHERE gone
  UNION ALL SELECT r, a, z FROM passage),
apart AS (SELECT *, a > max(z) OVER (PARTITION BY r ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new FROM gap),
island AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY r ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM apart),
hole AS (SELECT r, min(a) AS a, max(z) AS z FROM island GROUP BY r, k),
between_ AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM hole),
kept AS (
  SELECT r, string_agg(substr(text, from_::BIGINT + 1, (a - from_)::BIGINT), '' ORDER BY a) || substr(any_value(text), max(z)::BIGINT + 1) AS text FROM between_ JOIN rows USING (r) GROUP BY r)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_passages, 0)::BIGINT AS n_passages,
       coalesce(cut.spans, '') AS removed_spans, coalesce(passages.spans, '') AS passage_spans, CASE WHEN kept.r IS NULL THEN rows.text ELSE kept.text END AS text
FROM rows LEFT JOIN cut USING (r) LEFT JOIN passages USING (r) LEFT JOIN kept USING (r)
""".replace("{n}", str(passages.WORDS)),
    "op6_capped_water_filling": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
p AS (
  SELECT *, total - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max(CASE WHEN cap >= rest / open * weight THEN rest / open END) OVER () AS final FROM p),
t AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
g AS (
  SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
a AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, words - whole * source_size - ahead)))::BIGINT AS taken, a.source AS source
FROM a JOIN g ON a.source IS NOT DISTINCT FROM g.source
""",
}
