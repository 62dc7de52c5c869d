"""DuckDB SQL for the operators that it can express, over the whole tables."""

from __future__ import annotations

import re

from .licenses import BASE, TEMPLATES

#: Words of each text: lower-cased letters and digits, or all between ASCII white space. No empty words.
ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACE = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hits) x, unnest(range(i, i + n)) AS t(p) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

RULES = f"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {SPACE} AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
twice AS (SELECT rid, g FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM windows JOIN twice USING (rid, g), unnest(range(i, i + 5)) AS t(p) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM d, unnest(string_split(text, chr(10))) AS t(l)
          WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
rules AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
    len(w) < 10 OR 100 * coalesce(repeated.n, 0) > 20 * len(w) AS base_failed
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM rules GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(n * n) AS nn, sum(f * f / n) AS ff, sum(f) / sum(n) AS m FROM hosts),
between_hosts AS (SELECT *, CASE WHEN n - nn / n > 0 THEN greatest(0, (ff - n * m * m - (k - 1) * m * (1 - m)) / (n - nn / n)) ELSE 0 END AS v FROM sums),
prior AS (SELECT *, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE n END, 1), n) AS s FROM between_hosts),
ab AS (SELECT CASE WHEN m > 0 AND m < 1 THEN m * s ELSE 1 + f END AS a, CASE WHEN m > 0 AND m < 1 THEN (1 - m) * s ELSE 1 + n - f END AS b FROM prior),
verdicts AS (SELECT source, (f + a) / (n + a + b) > 0.5 AS rejected FROM hosts, ab)
"""

OP3 = f"""
WITH {RULES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM rules JOIN verdicts ON rules.source IS NOT DISTINCT FROM verdicts.source
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SPACE} AS w FROM documents),
windows AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
first_of AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT rid, p FROM windows JOIN first_of USING (g), unnest(range(i, i + 50)) AS t(p) WHERE first < doc_id),
places AS (SELECT rid, w[p] AS word, p FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM places ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""



def template_pattern(markup: str) -> tuple[str, str]:
    """A template as a regular expression over a line of lower-case words with a space on either side of each, and its longest fixed piece."""
    out, depth, fixed = " ", 0, [""]
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part.startswith("<<optional"):
            out, depth = out + "(?:", depth + 1
        elif part.startswith("<<end"):
            out, depth = out + ")?", depth - 1
        elif part.startswith("<<any"):
            out += f"(?:[^ ]+ ){{0,{int(part[5:-2])}}}"
        else:
            words = "".join(f"{w} " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.lower()))
            out += words
            fixed += [] if depth else [words]
    return out, max(fixed, key=len)


_MATCHES = [(label, *template_pattern(m)) for label, markup in TEMPLATES.items() for m in ([markup] if isinstance(markup, str) else markup)]
#: Places of the base phrases are word positions; a template holds if its pattern is found in the line of words.
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM} AS w FROM documents),
phrases(phrase, label, n) AS (VALUES {", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE.items())}),
lines AS (SELECT rid, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
near AS (SELECT rid, w, phrase, label, n FROM d JOIN lines USING (rid), phrases WHERE contains(line, ' ' || phrase || ' ')),
places AS (SELECT rid, i - 1 AS word, label FROM near, unnest(range(1, len(w) + 1)) AS t(i) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
base AS (SELECT rid, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
found AS ({" UNION ALL ".join(f"SELECT rid, '{label}' AS label FROM lines WHERE contains(line, '{fixed}') AND regexp_matches(line, '{pattern}')" for label, pattern, fixed in _MATCHES)}),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION ALL SELECT rid, label FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CAST(CASE WHEN rid IN (SELECT rid FROM found) THEN 1 WHEN n_base > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""

#: Each source's b blocks are at its first b points, of more than are needed.
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len({SPACE}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weights AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS most FROM sizes),
-- the sources that are full come first; the level is that of the others
filled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM weights WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
chosen AS (SELECT CAST(arg_min(level, most / w) AS DOUBLE) AS level FROM filled WHERE level <= most / w),
targets AS (SELECT source, source_size, least(most, level * w) AS target, CAST(round(least(most, level * w)) AS BIGINT) AS quota FROM weights, chosen),
placed AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d),
blocks AS (SELECT source, CAST((quota + 1023) // 1024 AS BIGINT) AS b FROM targets WHERE quota > 0),
cut AS (SELECT *, CAST(sum(b) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS hi, CAST(sum(b) OVER () AS BIGINT) AS n FROM blocks),
points AS (SELECT s, CAST(list_sum(list_transform(range(40), lambda i: ((s >> i) & 1) << (39 - i))) AS DOUBLE) / CAST(1099511627776 AS DOUBLE) AS u FROM (SELECT unnest(range(8 * (SELECT max(n) FROM cut))) AS s)),
slots AS (SELECT source, s, row_number() OVER (PARTITION BY source ORDER BY s) - 1 AS k FROM points JOIN cut ON u >= CAST(hi - b AS DOUBLE) / CAST(n AS DOUBLE) AND (u < CAST(hi AS DOUBLE) / CAST(n AS DOUBLE) OR hi = n))
SELECT doc_id, size, source_size, target, (SELECT s FROM slots WHERE slots.source IS NOT DISTINCT FROM placed.source AND k = first // 1024 AND size > 0 AND first < quota) AS first_slot, CAST((SELECT sum(greatest(0, least(size, quota - e * source_size - first))) FROM range(3) AS t(e)) AS BIGINT) AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""

_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: The least cost and audit of each state, row by row: a plain dynamic programme, up to two inserts before each row.
OP11 = f"""
WITH RECURSIVE bits(n, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) AS t(i)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
base AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM conversations, crc),
hurt AS (SELECT rid, conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM base, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS t(copy) WHERE kind <> 0),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS nth, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last_char FROM hurt),
marked AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS next_c, lead(i) OVER (PARTITION BY conv_id ORDER BY i) IS NOT NULL AS followed,
    CASE WHEN last_char = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM rows_),
-- inserts before a row: from state, to state, count
ins(q, to_q, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)),
keep(q, c, to_q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
turns(q, role, to_q) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
edits AS (SELECT conv_id, i, q, 'D' AS e, 3 AS cost, q AS to_q, CAST(NULL AS VARCHAR) AS line FROM marked, (VALUES (0), (1), (2), (3)) AS s(q)
    UNION ALL SELECT conv_id, i, q, 'K', CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, to_q, role || ':' || text FROM marked JOIN keep USING (c) WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, i, q, 'R', 2 + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, to_q, turns.role || ':' || text FROM marked, turns WHERE fault NOT IN ('blank', 'duplicate')),
spoken(q, n, said) AS (VALUES (0, 0, []), (1, 0, []), (2, 0, []), (3, 0, []), (0, 1, ['user:']), (1, 1, ['user:']), (3, 1, ['user:']), (2, 1, ['assistant:']), (0, 2, ['user:', 'assistant:']), (1, 2, ['user:', 'assistant:'])),
walk(conv_id, i, q, cost, audit, said) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM marked
    UNION ALL SELECT conv_id, i, q, cost, audit, said FROM (
        SELECT w.conv_id, e.i, e.to_q AS q, w.cost + 2 * ins.n + e.cost AS cost, w.audit || repeat('I', ins.n) || e.e AS audit,
            list_concat(w.said, list_concat(s.said, CASE WHEN e.line IS NULL THEN [] ELSE [e.line] END)) AS said
        FROM walk w JOIN ins ON ins.q = w.q JOIN spoken s ON s.q = w.q AND s.n = ins.n JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = ins.to_q)
    QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (followed AND c || next_c NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
ends AS (SELECT w.conv_id, w.cost + 2 * ins.n AS cost, w.audit || repeat('I', ins.n) AS audit, list_concat(w.said, s.said) AS said
    FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ins ON ins.q = w.q AND ins.to_q IN (0, 3) JOIN spoken s ON s.q = w.q AND s.n = ins.n
    QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * ins.n, w.audit || repeat('I', ins.n)) = 1),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
    coalesce(sha256(array_to_string(said, chr(10))), '{_EMPTY}') AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS} AS w FROM documents),
t AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(*) >= 30),
vocabulary AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups_ AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT t.lang, t.source, term, CAST(sum(t.n) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM held GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(h.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (v.total + 5 * v.v) AS lang_p
    FROM groups_ g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN totals s USING (lang, source) LEFT JOIN held h USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source),
apart AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY coalesce(value, 0) DESC, item) AS INTEGER) AS rank FROM pairs LEFT JOIN apart USING (lang, source, item)
UNION ALL
SELECT lang, source, 'term', term, CAST(p - lang_p AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - lang_p DESC, term) AS INTEGER) AS rank FROM every WHERE n > 0 AND p > lang_p QUALIFY rank <= 50
"""

SQL: dict[str, str] = {
    "op1_benchmark_decontamination": OP1,
    "op3_host_quality_rules": OP3,
    "op7_license_templates": OP7,
    "op8_source_mix": OP8,
    "op10_relative_lz_dedup": OP10,
    "op11_conversation_repair": OP11,
    "op13_source_divergence": OP13,
}
