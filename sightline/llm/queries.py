"""The queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, html_text, language_ppm, line_dedup, ngram_jaccard, periodic_runs, quality_crf, quality_rules, token_alignment, toxicity, warc
from .common import crc_mod

#: The rank file's place is a parameter; it is read where it is and never copied.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The two vocabularies that op11 aligns.
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.join(table(spark, sf_dir, "documents"), width=3, p=9, q=10)
    return ngram_jaccard.document_components(found).select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")))
    return made.select("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_digest", "source_content_type")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=(5, 0))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = language_ppm.train(docs.where(~held_out))
    out = language_ppm.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"), fold=(5, 0))
    out = quality_crf.score_documents(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, keep_ids=False)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_corpus(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES, public_tokenizers.PATTERN)


#: A conversation of control strings, -1 of op12.
CONTROL_TURNS = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_TURNS))
    return chat_format.digests(chat_format.format_chats(chat_format.gather(rows)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.plant(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_line_dedup, op3_warc, op4_toxicity, op5_quality_rules, op6_language_id, op7_decontamination, op8_quality_classifier, op9_byte_bpe, op10_html_extraction, op11_token_alignment, op12_chat_format, op13_periodic_runs)}


_WHITE = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP2 = rf"""
WITH lines AS (
  SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(line, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k FROM lines),
counts AS (SELECT k, max(doc_id) AS last_id FROM (SELECT DISTINCT rid, doc_id, k FROM keyed WHERE length(k) >= 20) GROUP BY k HAVING count(*) >= 3),
marked AS (SELECT keyed.*, (counts.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM counts.last_id) AS gone FROM keyed LEFT JOIN counts ON keyed.k = counts.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{_WHITE}+'), lambda x: x <> '') AS words FROM d),
pos AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT rid, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM pos WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS c FROM win WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, i + o AS j FROM twice, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_WHITE}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
flagged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base),
judged AS (SELECT *, (base_failed OR 100 * n_symbols > 1 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS host_failed FROM flagged),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(host_failed::INT)::DOUBLE AS k FROM judged GROUP BY source),
s AS (SELECT sum(n) AS total, sum(k) / sum(n) AS mean, sum(k * k / n) AS kk, sum(n * n) AS nn, count(*) AS h FROM hosts),
m AS (SELECT *, mean * (1 - mean) AS within, CASE WHEN total - nn / total > 0 THEN greatest(0, (kk - total * mean * mean - (h - 1) * mean * (1 - mean)) / (total - nn / total)) ELSE 0 END AS between_ FROM s),
g AS (SELECT mean, CASE WHEN within = 0 THEN 2.0 WHEN between_ > 0 THEN least(1e6, greatest(2.0, within / between_ - 1)) ELSE 1e6 END AS strength FROM m),
p AS (SELECT greatest(mean * strength, 1e-3) AS a, greatest((1 - mean) * strength, 1e-3) AS b FROM g),
ok AS (SELECT source, (k + a) / (n + a + b) <= 4 * a / (4 * a + b) AS host_ok FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_ok) AS kept
FROM flagged JOIN ok ON flagged.source IS NOT DISTINCT FROM ok.source
"""


_OP12 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows_),
marked AS (SELECT *, length(role || text) + len(regexp_extract_all(role || chr(10) || text, '<\\*(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>)|\[\\*(INST\]|/INST\])')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + length('<|im_start|><|im_sep|><|im_end|>') + 1)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query on whole tables.

    Not for: op1 (connected components of all similar pairs), op4, op6, op8 (fitted models), op7 (SimHash
    candidates over hashes that DuckDB lacks), op9 and op11 (BPE merges), op10 (a tokenizer with a stack), op13
    (every period of every word is too slow on whole tables). Those
    are tested against brute-force versions, round trips or held-out accuracy in tests/llm.
    """
    return {"op2_line_dedup": _OP2, "op3_warc": warc.ORACLE_SQL, "op5_quality_rules": _OP5, "op12_chat_format": _OP12}
