"""DuckDB SQL for the operators that SQL can express."""

from levelcast.llm import licenses, line_chunks, line_rules, mixing, shards, source_audit
from levelcast.llm.common import GAP, WORD


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _line_fails(line):
    without = lambda cs: f"length(translate({line}, {quoted(cs)}, ''))"
    return f"""(regexp_matches({line}, {quoted(WORD)}) AND (
        NOT regexp_matches({line}, {quoted(line_rules.ENDING)})
        OR (length({line}) - {without(line_rules.MARKS)}) * 100
            > length(regexp_replace({line}, {quoted(GAP)}, '', 'g')) * {line_rules.MAX_MARK_PERCENT}
        OR length({line}) - {without(line_rules.SEPARATORS)} >= {line_rules.MIN_SEPARATORS}
        OR regexp_matches({line}, {quoted(line_rules.BOILERPLATE)})))"""


LINE_RULES = f"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {quoted(WORD)}) AS ws,
           string_split(coalesce(text, ''), chr(10)) AS ls
    FROM documents),
windows AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM windows JOIN twice USING (doc_id, g) CROSS JOIN (VALUES (0), (1), (2)) AS o(k) GROUP BY 1),
m AS (
    SELECT doc_id, t, len(ws) AS n_words, length(list_aggregate(ws || [''], 'string_agg', '')) AS word_chars,
           length(t) - length(translate(t, '{line_rules.SYMBOLS}', '')) AS n_symbols,
           list_filter(ls, lambda l: regexp_matches(l, {quoted(WORD)})) AS worded, ls,
           list_filter(ls, lambda l: NOT {_line_fails("l")}) AS good, coalesce(n, 0) AS n_repeat_words
    FROM w LEFT JOIN covered USING (doc_id)),
r AS (
    SELECT *, n_words < {line_rules.MIN_WORDS}
              OR n_repeat_words * 100 > n_words * {line_rules.MAX_REPEAT_PERCENT} AS base_failed,
           length(t) - length(coalesce(list_aggregate(good, 'string_agg', chr(10)), '')) AS lost_chars
    FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, len(worded) - len(list_distinct(worded)) AS n_dup_lines, n_repeat_words,
       base_failed, NOT base_failed AND lost_chars * 100 <= length(t) * {line_rules.MAX_LOST_PERCENT} AS kept,
       len(ls) AS n_lines, len(ls) - len(good) AS n_removed_lines, lost_chars
FROM r
"""

PREFIX_TARGETS = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
    SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
           sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11)
               OVER (w ROWS UNBOUNDED PRECEDING) AS chars
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS plain,
           coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
           sum(chars) FILTER (role = 'assistant' OR k = n) AS formatted_chars
    FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(plain) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM c
"""

_OWNERS = ",".join(map(str, shards.lookup_table(range(shards.SHARDS))))
SHARDS = f"""
SELECT doc_id, source,
       ([{_OWNERS}])[1 + (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {shards.SLOTS})]::INTEGER AS shard
FROM documents
"""

LINE_CHUNKS = f"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT % {line_chunks.PRIME} AS hash FROM l),
b AS (
    SELECT *, (hash + (coalesce(lag(hash) OVER (PARTITION BY doc_id ORDER BY i), 0) * {line_chunks.BASE})
                % {line_chunks.PRIME}) % {line_chunks.PRIME} % {line_chunks.DIVISOR} = 0 AS ends
    FROM h),
k AS (
    SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS chunk
    FROM b),
c AS (
    SELECT doc_id, chunk, count(*) AS n, bool_or(regexp_matches(line, {quoted(WORD)})) AS worded,
           string_agg(line, chr(10) ORDER BY i) AS body
    FROM k GROUP BY ALL),
r AS (
    SELECT *, n > 1 AND worded AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, chunk) > 1 AS gone FROM c)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       count(*) FILTER (gone) AS n_removed_chunks,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS clean_sha256
FROM r GROUP BY 1
"""


def _pick(values, index):
    return f"([{', '.join(str(v) for v in values)}])[1 + {index} % {len(values)}]"


MIX = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {quoted(WORD)})) AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM d GROUP BY 1),
p AS (
    SELECT *, {_pick(mixing.WEIGHTS, "(rank - 1)")}::BIGINT AS weight, source_size * {mixing.MAX_PASSES} AS cap,
           {_pick([list(x) for x in mixing.SCHEDULES], "(rank - 1)")}::DOUBLE[] AS knots
    FROM s),
q AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
    FROM p WINDOW w AS (ORDER BY cap::DOUBLE / weight, rank)),
g AS (
    SELECT *, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM q),
x AS (
    SELECT d.*, source_size, target, knots, round(target)::BIGINT AS take,
           (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
y AS (
    SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS passes,
           greatest(0, least(size, CASE WHEN source_size > 0 THEN take % source_size ELSE 0 END - before)) AS cut_words
    FROM x),
z AS (
    SELECT *, size * passes + cut_words AS taken,
           (before + CASE WHEN passes > 0 THEN size ELSE cut_words END / 2.0::DOUBLE) / take AS share,
           (knots[1] + knots[2]) / 2.0::DOUBLE AS a1, (knots[2] + knots[3]) / 2.0::DOUBLE AS a2
    FROM y),
n AS (
    SELECT *, share * (0.0::DOUBLE + a1 + a2) AS need, CASE WHEN a1 <= share * (a1 + a2) THEN 1 ELSE 0 END AS seg FROM z),
o AS (
    SELECT *, knots[seg + 1] AS lo, knots[seg + 2] AS hi, need - CASE WHEN seg = 1 THEN a1 ELSE 0.0 END AS missing FROM n)
SELECT doc_id, source, size, source_size, target, taken, passes, cut_words,
       CASE WHEN taken > 0 THEN (seg + CASE WHEN missing <= 0 THEN 0.0::DOUBLE ELSE missing * 2.0::DOUBLE
            / (lo + sqrt(greatest(lo * lo + (hi - lo) * missing * 2.0::DOUBLE, 0.0))) END) / 2 END AS position
FROM o
"""

_TEMPLATES = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.TEMPLATES)


def _normal(text):
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    clean = rf"regexp_replace({lower}, '[^\p{{L}}\p{{N}}.]+', ' ', 'g')"
    return rf"list_filter(string_split(regexp_replace({clean}, '\.+( |$)', '\1', 'g'), ' '), lambda w: w <> '')"


def _bigrams(words):
    pairs = f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"
    return f"CASE WHEN len({words}) >= 2 THEN {pairs} ELSE {words} END"


LICENSES = f"""
WITH t AS (SELECT license, {_bigrams("ws")} AS pattern
           FROM (SELECT license, {_normal("wording")} AS ws FROM (VALUES {_TEMPLATES}) AS v(license, wording))),
parts AS (
    SELECT doc_id, unnest(list_distinct(string_split(text, chr(10))
               || regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n') || [text])) AS unit
    FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unit, {_bigrams("ws")} AS pairs FROM (SELECT doc_id, unit, {_normal("unit")} AS ws FROM parts)),
m AS (
    SELECT doc_id, license, unit,
           len(list_intersect(pairs, pattern)) * 2.0::DOUBLE / (len(pairs) + len(pattern)) AS dice
    FROM u JOIN t ON len(pairs) BETWEEN 1 AND 3 * len(pattern) AND len(list_intersect(pairs, pattern)) > 0)
SELECT doc_id, license, max(dice) AS dice, count(DISTINCT unit) AS n_matches
FROM m WHERE dice >= {licenses.THRESHOLD} GROUP BY 1, 2
""".replace("\\\\", "\\")

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(WORD)}) AS ws
    FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1),
               lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
           WHEN len(ws) > 0 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE [] END AS s
    FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM g),
link AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.w = b.w AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(x, y) AS (
    SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM g LEFT JOIN least_of ON doc_id = x
"""

SOURCE_AUDIT = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t
    FROM documents),
w AS (
    SELECT r, lang, source, unnest(regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {source_audit.MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total, count(*) OVER (PARTITION BY lang, source) AS terms FROM x),
p AS (SELECT lang, source, term, n, (1 + ({source_audit.SCALE}::HUGEINT * (n + 2)) // (total + 2 * terms))::BIGINT AS p FROM y),
l AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL),
z AS (SELECT *, sum(n) OVER (PARTITION BY lang)::HUGEINT AS total, count(*) OVER (PARTITION BY lang) AS terms FROM l),
q AS (SELECT lang, term, (1 + ({source_audit.SCALE}::HUGEINT * (n + 2)) // (total + 2 * terms))::BIGINT AS q FROM z),
v AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
WHERE part = 'pair' OR rank <= {source_audit.TOP}
""".replace("\\\\", "\\")

ORACLE = {
    "op11_count_cells": SOURCE_AUDIT,
    "op6_bottom_k": NEAR_DUPLICATES,
    "op4_line_rules": LINE_RULES,
    "op5_prefix_targets": PREFIX_TARGETS,
    "op7_lookup_shards": SHARDS,
    "op8_line_chunks": LINE_CHUNKS,
    "op9_curriculum_mix": MIX,
    "op10_license_scan": LICENSES,
}
