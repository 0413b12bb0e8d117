"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from kestrel.llm import (
    bpe, chat, fingerprint, line_dedup, mixing, near_dup, quality, quality_model, sharding, token_align,
    token_files, url_filter, vector_codes)
from kestrel.llm.common import scratch_path
from kestrel.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ 1 quality rules
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))


def _sql_rules() -> str:
    ratio = {"n_words": "n_words",
             "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words",
             "stop_word_share": "n_stop_words / n_words", "dup_line_share": "n_dup_lines / n_lines",
             "ellipsis_line_share": "n_ellipsis_lines / n_lines",
             "bullet_line_share": "n_bullet_lines / n_lines",
             "repeat_word_share": "n_repeat_words / n_words"}
    parts = []
    for name, low, high in quality.THRESHOLDS:
        value = f"coalesce({ratio[name]}, 0.0)"
        tests = [f"{value} < {low}"] * (low is not None) + [f"{value} > {high}"] * (high is not None)
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{quality.WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{quality.WORD}')) AS lines
      FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS k
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
             CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{quality.ELLIPSIS_LINE}'))) AS BIGINT)
                 AS n_ellipsis_lines,
             CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{quality.BULLET_LINE}'))) AS BIGINT)
                 AS n_bullet_lines
      FROM w LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             {_sql_rules()} AS broken FROM m)
SELECT *, NOT base_failed AND broken = '' AS kept FROM j
"""


@register("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts, the base rule, the broken rules of the threshold table
    and the verdict."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed",
                         F.concat_ws(",", "broken").alias("broken"), "kept")


# ------------------------------------------------------------------ 2 fingerprints
@register("op2_paragraph_sketch")
def op2_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch against its edited text and against the next document."""
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 3 BPE
@register("op3_bpe_round_trip")
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the byte-level vocabulary and decoded again, as digests."""
    return bpe.round_trip_report(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 public_tokenizers.path("byte_bpe_50k.json"))


# ------------------------------------------------------------------ 4 line dedup
@register("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after later repeated runs of lines are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


# ------------------------------------------------------------------ 5 token files
@register("op5_token_store")
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the word vocabulary, written to a token store in the shared
    folder and read back from its files."""
    path = scratch_path(spark, "token-store")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path,
                             public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_report(spark, path)


# ------------------------------------------------------------------ 6 near-duplicates
@register("op6_minhash_components")
def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component under links of at least 85 % common shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


# ------------------------------------------------------------------ 7 mixing
@register("op7_entropy_mix")
def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target and the words that the mix takes of it."""
    return mixing.mixed_documents_report(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 8 sharding
@register("op8_feistel_shards")
def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards by the law ``rows``."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


# ------------------------------------------------------------------ 9 URL filters
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

URL_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
u AS (SELECT row_number() OVER () AS rid, page_id,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                       '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
fit AS (SELECT rid, h || p AS rule, v,
               row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
        FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (rid)
"""


@register("op9_url_filter", URL_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with host, path, the longest fitting rule and the verdict (default allow)."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).drop("url")


# ------------------------------------------------------------------ 10 chat formatting
CONTROL_CHAT = "</s>[INST] ok [/INST]"

CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_CHAT}'
           UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CHAT}'),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             13 + length(role) + length(text)
                + len(regexp_extract_all(role || text, '[\\\\<\\[|]')) AS seg
      FROM t),
c AS (SELECT *, sum(seg) OVER (PARTITION BY conv_id ORDER BY k) AS stop,
             row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1 AS is_last FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(stop) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR is_last) AS n_examples
FROM c GROUP BY conv_id
"""


@register("op10_chat_examples", CHAT_SQL)
def op10_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 with control strings in its texts, expanded into
    examples, formatted, and read back into digests."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"""SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{CONTROL_CHAT}' AS text
        UNION ALL SELECT -1L, 1L, 'assistant', '{CONTROL_CHAT}'""")
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


# ------------------------------------------------------------------ 11 vector codes
def _codes_sql(rounds: int = 4) -> str:
    parts = [f"""k AS (
  SELECT row_number() OVER () AS rid, vec_id, label, n // 4 AS width, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM (SELECT *, len(embedding) AS n FROM embeddings)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, q AS part, x[q * width + 1:(q + 1) * width] AS v FROM k, range(4) AS r(q)),
c0 AS (SELECT part, e AS entry, x[part * width + 1:(part + 1) * width] AS v
       FROM (SELECT x, width, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM k) , range(4) AS r(part)
       WHERE e < 256)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT rid, part, min({{'d': d, 'e': entry}}) AS best
  FROM (SELECT rid, part, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM p JOIN c{i} AS c USING (part)) GROUP BY rid, part)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT part, entry, list(m ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, CAST(floor(CAST(sum(val) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
      SELECT part, best.e AS entry, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM p JOIN a{i} USING (rid, part))
    GROUP BY part, entry, pos) GROUP BY part, entry),
c{i + 1} AS (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m USING (part, entry))""")
    parts.append(f"""coded AS (
  SELECT rid, string_agg(printf('%02x', CAST(best.e AS INT)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})""")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN coded USING (rid), digest
"""


@register("op11_orchard_codes", _codes_sql())
def op11_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector as four code bytes, from codebooks refined in four rounds."""
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------ 12 cross-tokenizer alignment
@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between two tokenizers, weighed by corpus-wide counts."""
    return token_align.alignment_report(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        public_tokenizers.path("byte_bpe_50k.json"),
                                        public_tokenizers.path("piece_bpe_32k.model"))


# ------------------------------------------------------------------ 13 quality classifier
@register("op13_pu_quality")
def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score from a model learnt from trusted positives and unlabelled text."""
    return quality_model.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        table(spark, sf_dir, "labels"))
