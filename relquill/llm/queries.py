"""The registered queries of the ten operators and the pipeline, and their SQL."""

from __future__ import annotations

from relquill.llm.chat import op1_chat_formatting
from relquill.llm.decontam import op6_decontamination
from relquill.llm.media import op4_media
from relquill.llm.mixing import op7_mixing
from relquill.llm.quality import op5_quality
from relquill.llm.simhash import op3_simhash
from relquill.llm.suffix import op9_suffix_dedup
from relquill.llm.tokens import op2_token_output
from relquill.llm.toxicity import op10_toxicity
from relquill.llm.warc import op8_warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_chat_formatting, op2_token_output, op3_simhash, op4_media, op5_quality, op6_decontamination, op7_mixing, op8_warc, op9_suffix_dedup, op10_toxicity, pipeline)
    return {f.__name__: f for f in named}


def _escapes(column: str, signs: str) -> str:
    return " + ".join(f"length({column}) - length(replace({column}, {s}, ''))" for s in signs.split(" "))


_CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + {_escapes("text", r"'\' '#' '<'")} + {_escapes("role", r"'\' '#' '<' ':' chr(10)")}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""

_WARC = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, hex,
    min(page_id) OVER (PARTITION BY hex) AS first_page,
    row_number() OVER (PARTITION BY hex ORDER BY page_id) AS k FROM rows)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(CAST(CAST(unhex(hex) AS BIT) AS VARCHAR), CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first_page END AS refers_to
FROM named"""


#: Every window as hex; starts of those that occur twice, joined to runs; the text between the runs.
_SUFFIX = """
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, substr(h, 2 * i + 1, 400) AS w FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
t AS (SELECT r, i FROM p JOIN (SELECT w FROM p GROUP BY w HAVING count(*) > 1) USING (w)),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM t)),
s AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM k GROUP BY r, run),
g AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS upto FROM s),
o AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
  string_agg(substr(h, 2 * upto + 1, 2 * (lo - upto)), '' ORDER BY lo) AS kept FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN o USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _CHAT, "op8_warc": _WARC, "op9_suffix_dedup": _SUFFIX}
