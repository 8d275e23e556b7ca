"""The registered queries of this package, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, html_text, language, lines, ngram_join, pack, passages, quality, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packed_matrices(table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.tiktoken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.removed_lines(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ","))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packed_documents(table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_token_counts, op4_token_output, op5_line_dedup, op6_html_extraction, op7_language_id, op8_best_fit_packing, op9_ngram_join, op10_decontamination)}

_OP10 = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), worded AS (
  SELECT side, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS width, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM worded WHERE side = 'b' AND len(w) > 0)
), widths AS (SELECT DISTINCT width FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, width, k, array_to_string(w[k : k + width - 1], ' ') AS win
  FROM (SELECT id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM worded, widths WHERE side = 'd' AND len(w) >= width)
), hits AS (SELECT doc_id, k, width, item_id FROM doc_windows JOIN item_windows USING (width, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + width)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit_words ON hit_words.doc_id = id LEFT JOIN hit_items ON hit_items.doc_id = id WHERE side = 'd'
"""

_OP9 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM worded WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least_id AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(v, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_id ON u = d.doc_id
"""

_OP5 = r"""
WITH broken AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, no, list_filter(string_split_regex(parts[no + 1], '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS no FROM broken)),
tokens AS (SELECT DISTINCT doc_id, no, array_to_string(w[k : k + 4], ' ') AS t FROM (SELECT doc_id, no, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM lines WHERE len(w) > 0)),
sizes AS (SELECT doc_id, no, count(*) AS n FROM tokens GROUP BY ALL),
pairs AS (SELECT a.doc_id AS d1, a.no AS n1, b.doc_id AS d2, b.no AS n2, count(*) AS c FROM tokens a JOIN tokens b USING (t) WHERE a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.no < b.no GROUP BY ALL),
gone AS (SELECT DISTINCT d2 AS doc_id, n2 AS no FROM pairs JOIN sizes x ON x.doc_id = d1 AND x.no = n1 JOIN sizes y ON y.doc_id = d2 AND y.no = n2 WHERE 100 * c >= 75 * (x.n + y.n - c)),
listed AS (SELECT doc_id, count(*) AS n_removed, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM broken LEFT JOIN listed USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": _OP5, "op9_ngram_join": _OP9, "op10_decontamination": _OP10}
