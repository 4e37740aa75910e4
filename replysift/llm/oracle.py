"""DuckDB twins of the queries that SQL can express."""

from .license_scan import KNOWN, NO_HOLDER, PLANTED, SPELLINGS, TITLE_LINES, TITLES, WHOLE
from .license_texts import TEXTS
from .mixing import BLOCK_WORDS, DOCS_PER_SHARD, MAX_EPOCHS, SEED

#: Blanks as DuckDB's trim takes them: space and \x09-\x0D.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT rid, pos, line, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key)),
r AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM r JOIN d USING (rid)
"""


def _op9_counts(state: str, chosen: str) -> str:
    """Lines of the chosen documents, and how many of them at least ten of these documents share."""
    return f"""(WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE {chosen}),
k AS (SELECT rid, unnest(list_transform(ls, lambda x: translate(trim(x, {_BLANKS}), '{_UPPER}', '{_LOWER}'))) AS key FROM d),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, '{state}' AS state, n_lines, n_dropped FROM d JOIN
  (SELECT rid, count(*) AS n_lines, count(hot.key) AS n_dropped FROM k LEFT JOIN hot USING (key) GROUP BY rid) USING (rid))"""


OP9_REVERSED = _op9_counts("without", "coalesce(doc_id % 3 <> 0, true)") + " UNION ALL " + _op9_counts("again", "true")


_BLANK_OR_COLON = r"([ \t]+|[ \t]*:[ \t]*)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _notice(x: str) -> str:
    """SQL: the lower-case line is a copyright notice (a year or its place, a sign, or a holder)."""
    rules = [
        r"^[ \t]*(copyright|\(c\)|©)([ \t:,]|copyright\b|\(c\)|©|by\b)*[\[<{(]?(([12][0-9]{3}|19yy|20yy|yyyy)\b|year\b)",
        r"^[ \t]*(copyright[ \t:,]*(\(c\)|©)|©)",
    ]
    holder = rf"^[ \t]*copyright{_BLANK_OR_COLON}[\p{{L}}\p{{N}}\[<{{]"
    no_holder = rf"^[ \t]*copyright{_BLANK_OR_COLON}(({NO_HOLDER})\b|the[ \t]*$)"
    matches = [f"regexp_matches({x}, {_quoted(r)})" for r in rules]
    return "(" + " OR ".join(matches) + f" OR (regexp_matches({x}, {_quoted(holder)}) AND NOT regexp_matches({x}, {_quoted(no_holder)})))"


def _canonical(text: str) -> str:
    """SQL for the canonical lines of a text: notices are told line by line, then each line is spelled anew."""
    x = "x"
    for old, new in SPELLINGS:
        x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
    x = f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    lines = f"string_split(lower(coalesce({text}, '')), chr(10))"
    return f"list_filter(list_transform(list_filter({lines}, lambda x: NOT {_notice('x')}), lambda x: {x}), lambda x: x <> '')"


def _body(lines: str) -> str:
    """SQL: canonical lines without the titles at their head."""
    is_title = f"lambda x: x IN ({', '.join(_quoted(t) for t in TITLES)})"
    other = f"list_position(list_transform({lines}[1:{TITLE_LINES}], {is_title}), false)"
    return f"CASE WHEN coalesce({other}, 0) > 0 THEN {lines}[{other}:] ELSE {lines}[{TITLE_LINES + 1}:] END"


def _values(texts) -> str:
    return ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in texts)


#: Long licences stand here once; their shorter variants are cut by SQL.
_WITHOUT_CUTS = tuple((i, t) for i, t in WHOLE if not any(t != u and u.startswith(t) for _, u in TEXTS))
_PLANTED_DOCS = f"""(SELECT doc_id, CASE WHEN t IS NULL THEN text ELSE 'Copyright (c) 2021 The Owners' || chr(10) || chr(10)
        || CASE WHEN (doc_id // 5) % 2 = 1 THEN upper(t) ELSE t END END AS text
    FROM documents LEFT JOIN (SELECT t, row_number() OVER () - 1 AS n FROM (VALUES {_values(PLANTED)}) v(id, t)) p
      ON doc_id % 5 = 0 AND n = (doc_id // 5) % {len(PLANTED)})"""


def _op8(docs: str) -> str:
    return f"""
WITH notice AS (SELECT id, t FROM (VALUES {_values(KNOWN)}) v(id, t)),
base AS (SELECT * FROM notice UNION ALL SELECT * FROM (VALUES {_values(_WITHOUT_CUTS)}) v(id, t)),
cuts AS (SELECT id, t FROM base UNION ALL
         SELECT id, unnest([split_part(t, 'END OF TERMS AND CONDITIONS', 1), split_part(t, 'END OF TERMS AND CONDITIONS', 1) || 'END OF TERMS AND CONDITIONS'])
         FROM base WHERE contains(t, 'END OF TERMS AND CONDITIONS') UNION ALL
         SELECT id, split_part(t, 'For more information', 1) FROM base WHERE id = 'Unlicense' AND contains(t, 'For more information')),
lined AS (SELECT id, {_canonical("t")} AS ls FROM cuts),
known AS (SELECT md5(array_to_string(ls, ' ')) AS digest, min(id) AS id FROM (SELECT id, {_body("ls")} AS ls FROM lined) GROUP BY 1),
stated AS (SELECT md5(array_to_string(ls, ' ')) AS digest, min(id) AS id FROM (SELECT id, {_body("ls")} AS ls FROM (SELECT id, {_canonical("t")} AS ls FROM notice)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_canonical("text")} AS ls FROM {docs}),
l AS (SELECT rid, unnest(ls) AS line FROM d),
n AS (SELECT rid, string_agg(DISTINCT id, ',' ORDER BY id) AS notices, count(*) AS n FROM l JOIN stated ON md5(line) = digest GROUP BY rid)
SELECT doc_id, known.id AS license_id, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notice_lines,
       md5(array_to_string(ls, ' ')) AS canonical_md5
FROM d LEFT JOIN known ON md5(array_to_string({_body("ls")}, ' ')) = known.digest LEFT JOIN n USING (rid)
"""


OP8, OP8_PLANTED = _op8("documents"), _op8(_PLANTED_DOCS)


def _number(seed: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


#: Targets from the level at which capped and open sources meet, seats as the highest of all quotients.
OP2 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS w, count(*) AS n, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
g AS (SELECT *, i % 3 + 1 AS g, row_number() OVER (ORDER BY CAST(w AS DOUBLE) / (i % 3 + 1), i) AS r FROM s),
o AS (SELECT *, sum(w) OVER () - coalesce(sum({MAX_EPOCHS} * w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(g) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn FROM g),
v AS (SELECT r AS r0, lft AS left0, opn AS open0 FROM o WHERE g * lft <= {MAX_EPOCHS} * w * opn ORDER BY r LIMIT 1),
t AS (SELECT source, w, n, i, CASE WHEN r0 IS NULL OR r < r0 THEN CAST({MAX_EPOCHS} * w AS DOUBLE)
             ELSE CAST(g * left0 AS DOUBLE) / CAST(open0 AS DOUBLE) END AS target FROM o LEFT JOIN v ON true),
k AS (SELECT CAST((2 * sum(w) + {BLOCK_WORDS}) // (2 * {BLOCK_WORDS}) AS BIGINT) AS blocks FROM s),
q AS (SELECT i, row_number() OVER (ORDER BY target / (2 * a + 1) DESC, i, a) AS place FROM t, k, range(blocks) x(a) WHERE target > 0),
seats AS (SELECT i, count(*) AS seats FROM q, k WHERE place <= blocks GROUP BY i),
e AS (SELECT d.*, t.i, t.w AS source_size, t.target,
             {_number(SEED + "-shard", "doc_id")} % ((t.n + {DOCS_PER_SHARD} - 1) // {DOCS_PER_SHARD}) AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT i, shard, CAST(sum(size) AS BIGINT) AS w FROM e GROUP BY i, shard),
p AS (SELECT h.i, h.shard, row_number() OVER (PARTITION BY h.i ORDER BY CAST(h.w AS DOUBLE) / (2 * a + 1) DESC, h.shard, a) AS place, seats
      FROM h JOIN seats USING (i), range((SELECT max(seats) FROM seats)) x(a) WHERE a < seats AND h.w > 0),
u AS (SELECT i, shard, count(*) AS got FROM p WHERE place <= seats GROUP BY i, shard),
z AS (SELECT h.i, h.shard, h.w, least(coalesce(got, 0) * {BLOCK_WORDS}, {MAX_EPOCHS} * h.w) AS quota,
             {_number(SEED + "-start", "h.i", "h.shard")} % greatest(1, (h.w + {BLOCK_WORDS} - 1) // {BLOCK_WORDS}) * {BLOCK_WORDS} AS start
      FROM h LEFT JOIN u ON u.i = h.i AND u.shard = h.shard),
a AS (SELECT e.*, z.w, quota, start, coalesce(sum(size) OVER (PARTITION BY e.i, e.shard
             ORDER BY {_number(SEED + "-order", "doc_id")}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM e JOIN z ON z.i = e.i AND z.shard = e.shard)
SELECT doc_id, size, source_size, target,
       CAST({" + ".join(f"greatest(0, least(start + quota, {lap} * w + ahead + size) - greatest(start, {lap} * w + ahead))" for lap in range(MAX_EPOCHS + 1))} AS BIGINT) AS taken
FROM a
"""

def _moved(best: str, cost: str, edit: str) -> str:
    """``best`` (nine digits of cost, then an audit) behind one more edit."""
    return f"(lpad(CAST(CAST(left({best}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({best}, 10))"


#: One recursive step for each row from the last to the first; least() takes the cost, then the audit.
OP13 = f"""
WITH RECURSIVE steps AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
dealt AS (SELECT src.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS d FROM src, steps),
hurt AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM dealt, range(2) x(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
named AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, hurt.*, rtrim(text, {_BLANKS}) AS ended, left(role, 1) AS ini,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt JOIN named ON named.conv_id IS NOT DISTINCT FROM hurt.conv_id),
faulty AS (SELECT *, CASE WHEN ended = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY c ORDER BY i) AS prev FROM placed),
counted AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY c),
best(c, i, f0, f1, f2, f3) AS (
    SELECT c, coalesce(n, 0) + 1, '000000000', '000000010II', '000000005I', '000000000' FROM named LEFT JOIN counted USING (c)
    UNION ALL
    SELECT c, i, least(g0, {_moved("least(g2, " + _moved("g3", "5", "I") + ")", "5", "I")}), least(g1, {_moved("least(g2, " + _moved("g3", "5", "I") + ")", "5", "I")}),
           least(g2, {_moved("g3", "5", "I")}), least(g3, {_moved("g2", "5", "I")})
    FROM (SELECT c, i, least({_moved("f0", "2", "D")}, CASE WHEN stays THEN {_moved("f2", "1 + p", "R")} END, CASE WHEN stays AND ini = 's' THEN {_moved("f1", "p", "K")} WHEN stays AND ini = 'u' THEN {_moved("f2", "p", "K")} END) AS g0,
                 least({_moved("f1", "2", "D")}, CASE WHEN stays THEN {_moved("f2", "1 + p", "R")} END, CASE WHEN stays AND ini = 'u' THEN {_moved("f2", "p", "K")} END) AS g1,
                 least({_moved("f2", "2", "D")}, CASE WHEN stays THEN {_moved("f3", "1 + p", "R")} END, CASE WHEN stays AND ini = 'a' THEN {_moved("f3", "p", "K")} END) AS g2,
                 least({_moved("f3", "2", "D")}, CASE WHEN stays THEN {_moved("f2", "1 + p", "R")} END, CASE WHEN stays AND ini = 'u' THEN {_moved("f2", "p", "K")} END) AS g3
          FROM (SELECT f.c, f.i, f.ini, fault NOT IN ('b', 'd') AS stays, CASE fault WHEN 't' THEN 5 ELSE 0 END AS p, f0, f1, f2, f3
                FROM best JOIN faulty f ON f.c = best.c AND f.i = best.i - 1))),
solved AS (SELECT c, CAST(left(f0, 9) AS BIGINT) AS cost, substr(f0, 10) AS audit FROM best WHERE i = 1),
edits AS (SELECT c, e, j, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY j) AS i
    FROM (SELECT c, unnest(string_split(audit, '')) AS e, unnest(range(1, len(audit) + 1)) AS j FROM solved WHERE audit <> '')),
kept AS (SELECT edits.c, e, j, role, text, ini, row_number() OVER (PARTITION BY edits.c ORDER BY j) AS place
    FROM edits LEFT JOIN faulty ON faulty.c = edits.c AND faulty.i = edits.i AND e <> 'I' WHERE e <> 'D'),
said AS (SELECT c, place, CASE WHEN e = 'K' THEN role WHEN (place - max(CASE WHEN place = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c)) % 2 = 1
    THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM kept),
hashed AS (SELECT c, sha256(string_agg(line, chr(10) ORDER BY place)) AS h FROM said GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM named JOIN solved USING (c) LEFT JOIN counted USING (c) LEFT JOIN hashed USING (c)
"""


OP12 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other, b.label AS label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, other AS positive_id, score AS positive_score FROM s WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> p.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLE_SQL = {"op2_mixing": OP2, "op8_license_scan": OP8, "license_scan_planted": OP8_PLANTED, "op9_line_dedup": OP9, "line_dedup_reversed": OP9_REVERSED, "op12_hard_negatives": OP12, "op13_conversation_repair": OP13}
