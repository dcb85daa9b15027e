"""One query for each training-data operator, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quire.llm.alignment import alignment
from quire.llm.common import documents
from quire.llm.line_dedup import dedup_lines
from quire.llm.media import document_media
from quire.llm.mixing import copies
from quire.llm.personal_data import personal_data
from quire.llm.pieces import round_trip
from quire.llm.quality_rules import quality
from quire.llm.ranked_search import search
from quire.llm.sharding import shards
from quire.llm.simhash import near_duplicates
from quire.llm.suffix_dedup import remove_repeats
from quire.llm.token_counts import token_counts
from quire.llm.toxicity import toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    found = (op1_line_dedup, op2_sharding, op3_token_counts, op4_mixing, op5_toxicity, op6_sentencepiece, op7_quality_rules, op8_suffix_dedup, op9_media_columns, op10_simhash, op11_personal_data, op12_ranked_search, op13_alignment)
    return {f.__name__: f for f in found}


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
  SELECT rid, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5
), h AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i+4]) AS c FROM g
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 4)) AS p FROM h WHERE c > 1) GROUP BY rid
), l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), b AS (
  SELECT w.rid, w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
), marks AS (
  SELECT rid, source, 'base' AS rule, base_failed AS hit FROM f UNION ALL
  SELECT rid, source, 'short', n_words < 20 FROM f UNION ALL
  SELECT rid, source, 'symbols', 10 * n_symbols > word_chars FROM f UNION ALL
  SELECT rid, source, 'lines', 25 * n_dup_lines > n_words FROM f UNION ALL
  SELECT rid, source, 'repeats', 10 * n_repeat_words > n_words FROM f
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS k FROM marks WHERE source IS NOT NULL GROUP BY source, rule
), p AS (
  SELECT rule, sum(k) / sum(n) AS m, var_samp(k / n) AS v FROM hosts GROUP BY rule
), q AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM p
), v AS (
  SELECT source, rule, round((k + m * s) / (n + s), 9) > CASE WHEN rule = 'base' THEN 0.5 ELSE round(m + sqrt(m * (1 - m) / (s + 1)), 9) END AS above
  FROM hosts JOIN q USING (rule)
), gone AS (
  SELECT DISTINCT rid FROM marks JOIN v USING (source, rule) WHERE above AND (hit OR rule = 'base')
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM gone) AS kept
FROM f
"""


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), worded AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM split
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, no) AS o FROM worded
), d AS (
  SELECT ws, min(o) AS o FROM placed WHERE len(ws) > 0 GROUP BY ws
), v AS (
  SELECT o, i, ws[:i - 1] || ws[i + 1:] AS r FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM d WHERE len(ws) >= 5)
), near AS (
  SELECT v.o FROM v JOIN (SELECT i, r, min(o) AS m FROM v GROUP BY i, r) g ON v.i = g.i AND v.r = g.r WHERE v.o > g.m
  UNION SELECT v.o FROM v JOIN d ON d.ws = v.r WHERE len(d.ws) >= 5 AND v.o > d.o
  UNION SELECT d.o FROM v JOIN d ON d.ws = v.r WHERE len(d.ws) >= 5 AND d.o > v.o
), kept AS (
  SELECT p.*, len(p.ws) = 0 OR p.o IN (SELECT o FROM d WHERE o NOT IN (SELECT o FROM near)) AS keep FROM placed p
), t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE keep), '') AS text
  FROM kept GROUP BY doc_id
)
SELECT a.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(length(t.text) AS BIGINT) AS kept_chars, sha256(t.text) AS kept_sha256
FROM documents a LEFT JOIN t USING (doc_id)
"""


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws,
    row_number() OVER () AS rid
  FROM documents
), s AS (
  SELECT CAST(count(*) FILTER (WHERE len(ws) > 0) AS BIGINT) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM t
), p AS (
  SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM t) GROUP BY rid, term
), f AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, big_n
), q AS (
  SELECT iid, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY iid, item_id, term
), g AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY iid, item_id, rid, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": OP12_SQL, "op1_line_dedup": OP1_SQL, "op7_quality_rules": OP7_SQL}
