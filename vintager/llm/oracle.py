r"""The queries of this subpackage that SQL expresses, as DuckDB SQL over the whole tables.

Each statement follows the query's contract by the plainest way (every window, every shingle pair),
not by the operator's method. ``doc_id`` is taken to be unique and not null, as in the tables.
"""

from __future__ import annotations

from vintager.llm.quality import BASE, POLICIES, PRODUCTION, RULES, mask

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _bits() -> str:
    return " + ".join(
        f"CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES)
    )


WARC = """
WITH bodies AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
sums AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex,
    min(page_id) OVER (PARTITION BY body) AS first_id FROM bodies),
digits AS (
  SELECT page_id, g, CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) AS v
  FROM sums, range(8) AS r(g)),
names AS (
  SELECT page_id, string_agg(
      substr(a, (v >> 15) + 1, 1) || substr(a, ((v >> 10) & 31) + 1, 1)
      || substr(a, ((v >> 5) & 31) + 1, 1) || substr(a, (v & 31) + 1, 1), '' ORDER BY g)
    AS payload_digest
  FROM digits, (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a) GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM sums JOIN names USING (page_id)
"""

JACCARD = rf"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
worded AS (SELECT doc_id, {WORDS} AS w FROM lowered),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]
                                         FOR i IN range(1, len(w) - 1)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s
  FROM worded),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT links.b, reached.other FROM reached JOIN links ON links.a = reached.doc_id)
SELECT doc_id, len(any_value(s)) AS n_shingles, min(other) AS component_id
FROM reached JOIN sets USING (doc_id) GROUP BY doc_id
"""

WORD_REPEATS = rf"""
WITH worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM worded),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM starts),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) AS r(k)),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
  FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (doc_id)
"""

QUALITY = rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM starts),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters,
    length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals
  FROM worded LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, CAST({_bits()} AS BIGINT) AS fail_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & {mask(BASE)} <> 0 AS base_failed,
  fail_bits & {mask(BASE) | mask(POLICIES[PRODUCTION])} = 0 AS kept, fail_bits
FROM judged
"""

BYTE_REPEATS = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
    octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
starts AS (SELECT doc_id, h, unnest(range(n_bytes - 399)) AS i FROM bytes),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM starts),
repeated AS (SELECT doc_id, i FROM strings QUALIFY count(*) OVER (PARTITION BY g) > 1),
edges AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 400 THEN 0 ELSE 1 END AS opens
  FROM repeated WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM spans
  UNION ALL
  SELECT doc_id, coalesce(max(b), 0), any_value(n_bytes)
  FROM bytes LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * gaps.a + 1 AS BIGINT), CAST(2 * (gaps.b - gaps.a) AS BIGINT)),
      '' ORDER BY gaps.a) AS body
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, n_bytes, n_bytes - length(body) // 2 AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(body)) AS kept_sha256
FROM bytes JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
summed AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS body,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')
      AS learned,
    sum(length('<turn >') + length(role) + length(regexp_replace(role, '[^\\<>]+', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^\\<>]+', '', 'g')) + length('</turn>') + 2)
      AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM summed
"""

REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda x: CAST(ascii(x) AS BIGINT)) AS codes
  FROM conversations),
fated AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, codes),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fate
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
      AS text
  FROM fated, range(2) AS r(copy)
  WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    left(role, 1) AS x, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN said = '' THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
best(conv_id, i, none, led, pair, half) AS (
  SELECT conv_id, n + 1, {'c': 0, 'e': ''}, {'c': 6, 'e': 'II'}, {'c': 0, 'e': ''}, {'c': 3, 'e': 'I'}
  FROM counted
  UNION ALL
  SELECT conv_id, i,
    list_min([b0, {'c': h.c + 3, 'e': 'I' || h.e}]), list_min([b1, {'c': h.c + 3, 'e': 'I' || h.e}]),
    list_min([b2, {'c': b3.c + 3, 'e': 'I' || b3.e}]), h
  FROM (
    SELECT *, list_min([b3, {'c': b2.c + 3, 'e': 'I' || b2.e}]) AS h FROM (
      SELECT conv_id, i,
        list_min([{'c': none.c + 4, 'e': 'D' || none.e}, u,
          {'c': led.c + extra + CASE WHEN x = 's' THEN 0 ELSE 1000000 END, 'e': 'K' || led.e}]) AS b0,
        list_min([{'c': led.c + 4, 'e': 'D' || led.e}, u]) AS b1,
        list_min([{'c': pair.c + 4, 'e': 'D' || pair.e}, u]) AS b2,
        list_min([{'c': half.c + 4, 'e': 'D' || half.e}, a]) AS b3
      FROM (
        SELECT best.*, f.i AS i, x, extra,
          {'c': half.c + extra + CASE WHEN x = 'u' THEN 0 ELSE 3 END,
           'e': CASE WHEN x = 'u' THEN 'K' ELSE 'R' END || half.e} AS u,
          {'c': pair.c + extra + CASE WHEN x = 'a' THEN 0 ELSE 3 END,
           'e': CASE WHEN x = 'a' THEN 'K' ELSE 'R' END || pair.e} AS a
        FROM (SELECT conv_id, i AS after, none, led, pair, half FROM best) AS best
        JOIN (
          SELECT conv_id AS conv, i, x,
            CASE fault WHEN '' THEN 0 WHEN 't' THEN 3 ELSE 1000000 END AS extra
          FROM faults) AS f ON f.conv = best.conv_id AND f.i = after - 1)))),
repairs AS (SELECT conv_id, none.c AS cost, none.e AS audit FROM best WHERE i = 1),
edits AS (
  SELECT conv_id, p, substr(audit, p, 1) AS edit FROM (
    SELECT conv_id, audit, CAST(unnest(range(1, length(audit) + 1)) AS BIGINT) AS p FROM repairs)),
numbered AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
    count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p DESC) AS k
  FROM edits),
lines AS (
  SELECT numbered.conv_id, string_agg(
      CASE WHEN edit = 'K' THEN role WHEN k % 2 = 1 THEN 'assistant' ELSE 'user' END || ':'
      || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM numbered LEFT JOIN faults ON faults.conv_id = numbered.conv_id AND faults.i = numbered.i
  WHERE edit <> 'D' GROUP BY numbered.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN counted ON counted.conv_id = o.conv_id LEFT JOIN repairs ON repairs.conv_id = o.conv_id
LEFT JOIN lines ON lines.conv_id = o.conv_id
"""

ALL = {
    "op2_warc": WARC,
    "op4_jaccard_join": JACCARD,
    "op6_substring_dedup": WORD_REPEATS,
    "op8_quality_rules": QUALITY,
    "op9_suffix_dedup": BYTE_REPEATS,
    "op10_chat_formatting": CHAT,
    "op12_conversation_repair": REPAIR,
}
