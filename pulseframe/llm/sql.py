"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from .common import LOWER as _LOWER
from .common import UPPER as _UPPER
from .common import WORD_PATTERN as _WORD
from .divergence import SQL as OP13
from .licenses import TEMPLATES

OP5 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), r AS (SELECT *, row_number() OVER () AS rid FROM w),
g AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM r WHERE len(ws) >= 5)
), d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
p AS (SELECT rid, i, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS c FROM d),
n AS (SELECT rid, sum(c) AS n_repeat FROM p GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(array_to_string(ws, ''), '[^A-Z]+', '', 'g')) AS n_capitals
  FROM r LEFT JOIN n USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 4 * n_symbols > n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept, failed
FROM f
"""

# The checksum table is built from the rule of CRC-32 (reflected polynomial 0xEDB88320).
OP10 = r"""
WITH RECURSIVE step AS (
  SELECT 0 AS k, i AS b, i::BIGINT AS v FROM range(256) r(i)
  UNION ALL
  SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), tab AS (SELECT list(v ORDER BY b) AS tb FROM step WHERE k = 8),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, x: xor(c >> 8, tb[xor(c & 255, x) + 1]))) AS text_crc32,
         list_transform(range(25), lambda s: struct_pack(
           cost := -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0),
           shard := s)) AS draws
  FROM documents, tab
), e AS (
  SELECT doc_id, size, text_crc32, list_min(draws[1:24]).shard::INTEGER AS shard, list_min(draws).shard::INTEGER AS grown_shard FROM d
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM e
"""

OP1 = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '@U', '@L'), '@W') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '@U', '@L'), '@W') AS w FROM documents
), places AS (
  SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT p.rid, p.i, p.n, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')
), hit AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM found) GROUP BY rid
), listed AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
""".replace("@U", _UPPER).replace("@L", _LOWER).replace("@W", _WORD)

OP9 = r"""
WITH templates(label, t) AS (VALUES @T),
tw AS (
  SELECT row_number() OVER () AS tid, label, list_distinct(regexp_extract_all(lower(t), '@W')) AS ws FROM templates
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '@U', '@L') AS t FROM documents
), words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '@W') AS w FROM docs),
phrases(p, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
base AS (
  SELECT rid, label, i - 1 AS place
  FROM (SELECT rid, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM words, phrases WHERE len(w) >= len(p))
  WHERE w[i:i + len(p) - 1] = p
), blocks AS (
  SELECT rid, regexp_extract_all(b, '@W') AS w
  FROM (SELECT rid, unnest(regexp_split_to_array(t, '\n[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n|[.!?;][ \t\n\r]')) AS b FROM words)
), met AS (
  SELECT rid, label, len(list_intersect(ws, w))::DOUBLE / len(ws) AS c
  FROM blocks, tw WHERE len(w) > 0 AND 20 * len(list_intersect(ws, w)) >= 17 * len(ws)
), b AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid
), m AS (SELECT rid, max(c) AS c FROM met GROUP BY rid),
l AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM met) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM words LEFT JOIN b USING (rid) LEFT JOIN m USING (rid) LEFT JOIN l USING (rid)
""".replace("@U", _UPPER).replace("@L", _LOWER).replace("@W", _WORD).replace("@T", ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES))


OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(text, '(\\*(?:<</?(?:SYS|ROLE)>>|\[/?INST\]|</?s>))', '\\\1', 'g')) AS n,
         length(regexp_replace(role, '(\\*(?:<</?(?:SYS|ROLE)>>|\[/?INST\]|</?s>))', '\\\1', 'g')) AS r
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE 26 + r END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP11 = r"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op9_license_scan": OP9, "op5_quality_rules": OP5, "op7_chat_formatting": OP7, "op10_sharding": OP10, "op11_exact_dedup": OP11, "op13_source_divergence": OP13}
