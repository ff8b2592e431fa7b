"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from termloom.llm import conversations, divergence, licenses, quality

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = f"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13
), k AS (
  SELECT doc_id, p, sha256(array_to_string(ws[p : p + 12], ' ')) AS h FROM s
), o AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS origin FROM k
), r AS (
  SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM o WHERE origin < doc_id) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([x FOR x, i IN ws IF gone IS NULL OR NOT list_contains(gone, i)], ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _op9() -> str:
    classes = ["a-z", "A-Z", "0-9", r".,;:!?''\"()\-", "#*$%&|<>"]
    of = lambda chars: f"length(regexp_replace(coalesce(text, ''), '[^{chars}]', '', 'g'))"
    beyond = r"length(regexp_replace(coalesce(text, ''), '[\x00-\x7F]', '', 'g'))"
    plain = f"translate(trim(x, '{quality.PUNCTUATION}'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents
), langs AS (
  SELECT lang AS ref FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {quality.MIN_DOCS}
), own AS (
  SELECT doc_id, lang, {plain} AS w, count(*)::DOUBLE AS n FROM (SELECT doc_id, lang, unnest(ws) AS x FROM d) GROUP BY ALL
), top AS (
  SELECT ref, w FROM (
    SELECT ref, w, row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, w) AS i FROM own JOIN langs ON lang = ref WHERE w <> '' GROUP BY ref, w) WHERE i <= {quality.COMMON}
), tri AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
    SELECT doc_id, p, array_to_string(ws[p : p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) >= 3))
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE n >= 2) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), base AS (
  SELECT d.doc_id, lang, text, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {of('#*$%&|<>')}::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), pairs AS (
  SELECT doc_id, ref, lang, base_failed, n_words FROM judged JOIN langs ON lang = ref OR lang IS NULL
), c AS (
  SELECT doc_id, word_chars, [{', '.join(of(x) for x in classes)}] AS five, {beyond} AS beyond FROM base
), cc AS (
  SELECT doc_id, unnest(range(7))::VARCHAR AS bin, unnest([five[1], five[2], five[3], five[4], five[5], word_chars - list_sum(five) - beyond, beyond])::DOUBLE AS n FROM c
), wc AS (
  SELECT doc_id, ref, own.w AS bin, n FROM pairs JOIN own USING (doc_id) JOIN top USING (ref, w)
), h AS (
  SELECT doc_id, ref, 'c' AS kind, bin, n FROM pairs JOIN cc USING (doc_id)
  UNION ALL SELECT doc_id, ref, 'w', bin, n FROM wc
  UNION ALL SELECT doc_id, ref, 'w', '', n_words - coalesce(s, 0) FROM pairs LEFT JOIN (SELECT doc_id, ref, sum(n) AS s FROM wc GROUP BY ALL) USING (doc_id, ref)
), p AS (
  SELECT doc_id, ref, kind, bin, n / greatest(sum(n) OVER (PARTITION BY doc_id, ref, kind), 1) AS p FROM h
), q AS (
  SELECT ref, kind, bin, s / sum(s) OVER (PARTITION BY ref, kind) AS q FROM (
    SELECT ref, kind, bin, sum(p) AS s FROM p JOIN pairs USING (doc_id, ref) WHERE lang = ref AND NOT base_failed GROUP BY ALL)
), bins AS (
  SELECT ref, 'c' AS kind, unnest(range(7))::VARCHAR AS bin FROM (SELECT DISTINCT ref FROM q)
  UNION ALL SELECT ref, 'w', w FROM top WHERE ref IN (SELECT ref FROM q) UNION ALL SELECT DISTINCT ref, 'w', '' FROM q
), js AS (
  SELECT doc_id, ref, kind, sqrt(greatest(least(sum(
      CASE WHEN coalesce(p.p, 0) > 0 THEN p.p * log2(p.p / ((p.p + coalesce(q.q, 0)) / 2)) ELSE 0 END + CASE WHEN coalesce(q.q, 0) > 0 THEN q.q * log2(q.q / ((coalesce(p.p, 0) + q.q) / 2)) ELSE 0 END
    ) / 2, 1), 0)) AS dist
  FROM pairs JOIN bins USING (ref) LEFT JOIN p USING (doc_id, ref, kind, bin) LEFT JOIN q USING (ref, kind, bin) GROUP BY ALL
), far AS (
  SELECT doc_id, arg_min(dc, dc + dw) AS dc, arg_min(dw, dc + dw) AS dw FROM (
    SELECT doc_id, ref, max(CASE WHEN kind = 'c' THEN dist END) AS dc, max(CASE WHEN kind = 'w' THEN dist END) AS dw FROM js GROUP BY ALL) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(coalesce(dc, 0), 6) AS char_distance, round(coalesce(dw, 0), 6) AS word_distance,
  NOT base_failed AND (word_chars < {quality.MIN_CHARS} OR coalesce(dc, 0) <= {quality.MAX_CHAR_DISTANCE}) AND (n_words < {quality.MIN_WORDS} OR coalesce(dw, 0) <= {quality.MAX_WORD_DISTANCE}) AS kept
FROM judged LEFT JOIN far USING (doc_id)
"""


def _op10() -> str:
    templates = ", ".join(f"({i}, {_text(x)}, {_text(t.lower())})" for i, (x, t) in enumerate(licenses.TEMPLATES))
    has = lambda c: "(" + " OR ".join(f"contains({c}, {_text(t)})" for t in licenses.TRIGGERS) + ")"
    n = len(licenses.TEMPLATES)
    found = lambda c: f"regexp_extract_all({c}, {_text(licenses.WORD)})"
    return f"""
WITH t AS (
  SELECT template, license, unnest({found('text')}) AS word FROM (VALUES {templates}) v(template, license, text)
), tc AS (
  SELECT template, license, word, count(*) AS tf FROM t GROUP BY ALL
), idf AS (
  SELECT word, ln({n + 1}::DOUBLE / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tc GROUP BY word
), tw AS (
  SELECT template, license, word, tf * idf AS weight, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY template)) AS norm FROM tc JOIN idf USING (word)
), f AS (
  SELECT doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id::VARCHAR) AS path, concat_ws('/', coalesce(source, ''), coalesce(lang, '')) AS dir, lower(text) AS text FROM documents
), s AS (
  SELECT doc_id, len({found('text')}) AS n_words, unnest(range(len(parts))) AS section, unnest(parts) AS part FROM (
    SELECT doc_id, text, list_distinct(list_concat(
      list_transform(list_filter(regexp_split_to_array(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {has('x')} THEN x || ' ' ELSE chr(1) END), ''), '\\x01+'), lambda x: {has('x')}), lambda x: trim(x, ' ')),
      list_filter(regexp_split_to_array(text, {_text(licenses.PARAGRAPH)}), lambda x: {has('x')}))) AS parts FROM f WHERE {has('text')})
), wc AS (
  SELECT doc_id, n_words, section, word, count(*) AS tf FROM (SELECT doc_id, n_words, section, unnest({found('part')}) AS word FROM s) GROUP BY ALL
), ww AS (
  SELECT doc_id, n_words, section, word, w, sqrt(sum(w * w) OVER (PARTITION BY doc_id, section)) AS size, sum(tf) OVER (PARTITION BY doc_id, section) AS section_words FROM (
    SELECT wc.*, tf * coalesce(idf, ln({n + 1}::DOUBLE) + 1.0::DOUBLE) AS w FROM wc LEFT JOIN idf USING (word))
), dots AS (
  SELECT doc_id, section, template, license, round(sum(w * weight / (size * norm)), 6) AS score, max(n_words) AS n_words, max(section_words) AS section_words
  FROM ww JOIN tw USING (word) GROUP BY ALL HAVING round(sum(w * weight / (size * norm)), 6) >= {licenses.MIN_COSINE}
), own AS (
  SELECT doc_id, license AS own_license, score AS own_score, 2 * section_words >= n_words AS is_license_file FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template, license DESC, (2 * section_words >= n_words) DESC) AS i FROM dots) WHERE i = 1
), declared AS (
  SELECT dir AS declares, own_license AS dir_license FROM (
    SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) AS i FROM own JOIN f USING (doc_id) WHERE is_license_file) WHERE i = 1
), near AS (
  SELECT dir, ancestor, dir_license FROM (
    SELECT a.dir, ancestor, dir_license, row_number() OVER (PARTITION BY a.dir ORDER BY depth DESC) AS i FROM (
      SELECT dir, depth, array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') AS ancestor FROM (
        SELECT dir, unnest(range(len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM f))) a JOIN declared ON declares = ancestor) WHERE i = 1
)
SELECT f.doc_id, path, own_license, own_score, coalesce(is_license_file, FALSE) AS is_license_file, coalesce(own_license, dir_license) AS license,
  CASE WHEN own_license IS NOT NULL AND is_license_file THEN 'file' WHEN own_license IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_source,
  CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.dir = f.dir
"""


def _crc32(expr: str) -> str:
    """The usual checksum of a text of ASCII characters, bit by bit."""
    byte = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({expr}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {byte}), 4294967295::BIGINT)"


def _op12() -> str:
    cost, word = {"R": conversations.REROLE, "D": conversations.DELETE, "I": conversations.INSERT, "t": conversations.CUT_OFF}, "[^\\x20\\x09-\\x0D]"
    then, wants = (2, 2, 3, 2), "uuau"

    def way(state: int) -> str:
        options = [f"{{'c': s{state}.c + {cost['D']}, 'a': 'D' || s{state}.a}}"]
        rest = f"s{then[state]}"
        options.append(f"{{'c': CASE WHEN known = 'd' THEN 1000000000000 ELSE {rest}.c + {cost['R']} + late END, 'a': 'R' || {rest}.a}}")
        options.append(f"{{'c': CASE WHEN known = '{wants[state]}' THEN {rest}.c + late ELSE 1000000000000 END, 'a': 'K' || {rest}.a}}")
        if state == 0:
            options.append("{'c': CASE WHEN known = 's' THEN s1.c + late ELSE 1000000000000 END, 'a': 'K' || s1.a}")
        return f"list_min([{', '.join(options)}])"

    insert = lambda s: f"{{'c': {s}.c + {cost['I']}, 'a': 'I' || {s}.a}}"
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations
), r AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE code WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM t WHERE code <> 0
), f AS (
  SELECT *, row_number() OVER w AS n, lag(role[1]) OVER w || role[1] AS pair, regexp_extract(text, '({word})[\\x20\\x09-\\x0D]*$', 1, 's') AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), k AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN dup THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup FROM f)
), told AS (
  SELECT conv_id, count(n) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id
), s AS (
  SELECT k.conv_id, n, rows, CASE WHEN fault IN ('b', 'd') THEN 'd' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS known, CASE fault WHEN 't' THEN {cost['t']} ELSE 0 END AS late
  FROM k JOIN told ON k.conv_id IS NOT DISTINCT FROM told.conv_id
), dp AS (
  SELECT conv_id, rows + 1 AS n, {{'c': 0, 'a': ''}} AS s0, {{'c': {2 * cost['I']}, 'a': 'II'}} AS s1, {{'c': {cost['I']}, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM told
  UNION ALL
  SELECT conv_id, n, list_min([b0, {insert('i2')}]), list_min([b1, {insert('i2')}]), i2, list_min([b3, {insert('b2')}]) FROM (
    SELECT *, list_min([b2, {insert('b3')}]) AS i2 FROM (
      SELECT dp.conv_id, s.n, {way(0)} AS b0, {way(1)} AS b1, {way(2)} AS b2, {way(3)} AS b3 FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.n - 1))
), a AS (
  SELECT conv_id, s0.c::BIGINT AS cost, s0.a AS audit FROM dp WHERE n = 1
), e AS (
  SELECT conv_id, p, audit[p] AS edit, length(regexp_replace(audit[1 : p], 'I', '', 'g')) AS n, length(regexp_replace(audit[1 : p], 'D', '', 'g')) AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM a)
), o AS (
  SELECT e.conv_id, p, CASE WHEN edit = 'K' THEN role WHEN (place - coalesce(max(CASE WHEN place = 1 AND edit = 'K' AND role[1] = 's' THEN 1 END) OVER (PARTITION BY e.conv_id), 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE edit WHEN 'I' THEN '' ELSE text END AS line
  FROM e LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM e.conv_id AND k.n = e.n WHERE edit <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS repaired_sha256 FROM o GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= {divergence.MIN_DOCS}
), langs AS (
  SELECT lang, sum(n)::HUGEINT + count(*) AS total FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), totals AS (
  SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS own FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (own + v) AS p
  FROM totals JOIN (SELECT lang, term, count(*) OVER (PARTITION BY lang) AS v FROM kept) USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // total AS q FROM kept JOIN langs USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), term AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL SELECT lang, source, 'term', item, value FROM term)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""



ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2, "op9_quality_rules": _op9(), "op10_licenses": _op10(), "op12_conversations": _op12(), "op13_divergence": OP13}
