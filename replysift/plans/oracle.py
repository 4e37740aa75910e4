"""DuckDB SQL twins of the registered queries (the differential check).

Written independently of the Spark code paths: the rule scorer counts each
category with its own regex (the Spark side does one pass), the histogram
bins with a range join (Spark counts edges), the cards join a VALUES list of
categories (Spark unpivots one aggregate row), and so on. Shared are only the
fixed values: phrase list, cue words, tokens and texts.
"""

from __future__ import annotations

from ..config import (
    CATEGORIES, CORRECTED_REASONING, DEFAULT_RULES, EMPTY_WORDS, FALLBACK_LABEL, FALLBACK_REASONING,
    INVALID_REASONING, NA_TOKENS, RuleSet,
)
from ..functions.noise import LEAST_PAIRS, MARGIN
from ..functions.text import DG_CLASS, WS_CLASS
from ..operators.model_batch import default_instructions
from ..sources.derived import ANSWER_PHRASES, NOISE_LETTERS, PLANTED_PHRASES
from .queries import CUSTOM_RULES, FILTER_ITEM, MODEL_BATCH, MODEL_BUCKET_ROWS, SITE_MIN_ROWS


def lit(s: str | None) -> str:
    """SQL string literal; line breaks as ``chr(10)`` so the text stays one line."""
    if s is None:
        return "NULL"
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


CATS = in_list(CATEGORIES)
NA_IN = in_list(NA_TOKENS)
PHRASES = "[" + ", ".join(lit(p) for p in ANSWER_PHRASES) + "]"
N_PHRASES = len(ANSWER_PHRASES)
NOT_INVALID = "\"LLM_Classification\" IS DISTINCT FROM 'INVALID'"


def na(expr: str, alias: str) -> str:
    return f'CASE WHEN {expr} IN {NA_IN} THEN NULL ELSE {expr} END AS "{alias}"'


# ------------------------------------------------------------------ listings

def events_listing_sql() -> str:
    raw = f"""SELECT CAST(event_id AS VARCHAR) AS q,
      CASE WHEN user_id % 17 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'ALPHA-01'
           ELSE 'BETA-0' || CAST(user_id % 5 AS VARCHAR) END AS st,
      'S' || CAST(user_id % 23 + 1000 AS VARCHAR) AS si,
      CAST(user_id AS VARCHAR) AS su,
      CASE WHEN event_id % 53 = 0 THEN NULL ELSE event_type || '-' || CAST(user_id % 7 AS VARCHAR) END AS it,
      'Please review ' || event_type || ' for subject ' || CAST(user_id AS VARCHAR) AS oq,
      ({PHRASES})[event_id % {N_PHRASES} + 1] AS re
    FROM events"""
    cols = [("q", "Query ID"), ("st", "Study Alias"), ("si", "Site"), ("su", "Subject"),
            ("it", "CRF Item"), ("oq", "Original Query"), ("re", "Site Response")]
    sel = ", ".join(na(a, b) for a, b in cols)
    return f'SELECT *, "Query ID" AS row_key FROM (SELECT {sel} FROM ({raw}))'


def planted_sql(text: str, number: str) -> str:
    at = f"(({number}) * 37) % (length({text}) + 1)"
    phrases = "[" + ", ".join(lit(p) for p in PLANTED_PHRASES) + "]"
    return f"({text}[1:{at}] || ' ' || ({phrases})[({number}) % {len(PLANTED_PHRASES)} + 1] || ' ' || {text}[{at} + 1:])"


def documents_listing_sql() -> str:
    cols = [("CAST(doc_id AS VARCHAR)", "Query ID"), ("lang", "Study Alias"), ("source", "Site"),
            ("source", "CRF Item"), (planted_sql("text", "doc_id"), "Site Response")]
    sel = ", ".join(na(a, b) for a, b in cols)
    return f'SELECT *, "Query ID" AS row_key FROM (SELECT {sel} FROM documents)'


def conversations_listing_sql() -> str:
    re = planted_sql("a.text", "a.conv_id + a.turn")
    raw = f"""SELECT CAST(q.conv_id AS VARCHAR) || '-' || CAST(q.turn AS VARCHAR) AS qi,
        CAST(q.conv_id AS VARCHAR) AS su, a.role AS it, q.text AS oq, {re} AS re
      FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
      WHERE q.role = 'user'"""
    cols = [("qi", "Query ID"), ("su", "Subject"), ("it", "CRF Item"), ("oq", "Original Query"),
            ("re", "Site Response")]
    sel = ", ".join(na(a, b) for a, b in cols)
    return f'SELECT *, "Query ID" AS row_key FROM (SELECT {sel} FROM ({raw}))'


def lineitem_listing_sql() -> str:
    raw = f"""SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS q,
        'RF-' || l_returnflag AS st, 'LS-' || l_linestatus AS it,
        ({PHRASES})[(l_orderkey + l_linenumber) % {N_PHRASES} + 1] AS re
      FROM lineitem"""
    cols = [("q", "Query ID"), ("st", "Study Alias"), ("it", "CRF Item"), ("re", "Site Response")]
    sel = ", ".join(na(a, b) for a, b in cols)
    fp_parts = ", ".join(
        f"CASE WHEN \"{c}\" IS NULL THEN 'N' ELSE 'V' || \"{c}\" END" for _, c in cols
    )
    return f"""SELECT * EXCLUDE (fp), fp || '-' || CAST(row_number() OVER (PARTITION BY fp) AS VARCHAR) AS row_key
      FROM (SELECT *, sha256(concat_ws(chr(31), {fp_parts})) AS fp FROM (SELECT {sel} FROM ({raw})))"""


# ------------------------------------------------------------ classification

def _phrase_regex(rules: RuleSet) -> str:
    """All phrases, longest first; which category one belongs to is decided by lists below."""
    core = f"\\b(?:{'|'.join(rules.phrases)})\\b" if rules.phrases else ""
    return "|".join(x for x in ("\\?" if any(r.question_mark for r in rules.rules) else "", core) if x)


def classified_sql(listing: str, rules: RuleSet = DEFAULT_RULES) -> str:
    """CTEs ``lst``, ``v``, ``cls`` over a listing query (``Site Response`` column)."""
    ws = WS_CLASS
    trim = f"'\\A[{ws}]+|[{ws}]+\\z'"
    empty = in_list(EMPTY_WORDS)
    digits = f"'\\A[{DG_CLASS}]+\\z'"
    counts = []
    rx = _phrase_regex(rules).replace("'", "''")
    for i, r in enumerate(rules.rules):
        own = in_list([*r.cues, *(["?"] if r.question_mark else [])])
        counts.append(f"len(list_filter(_found, lambda x: x IN {own})) AS _n{i}")
    k = len(rules.rules)
    total = " + ".join(f"_n{i}" for i in range(k))
    label_when, win_when = [], []
    for i, r in enumerate(rules.rules):
        cond = f"_n{i} > 0"
        if not r.overriding:
            cond += "".join(f" AND _n{i} >= _n{j}" for j in range(i + 1, k))
        label_when.append(f"WHEN {cond} THEN {lit(r.label)}")
        win_when.append(f"WHEN {cond} THEN _n{i}")
    reason = " || ".join(
        [lit("cues:")] + [
            f"{lit((', ' if i else ' ') + r.label + ' ')} || CAST(_n{i} AS VARCHAR)"
            for i, r in enumerate(rules.rules)
        ]
    )
    return f"""lst AS ({listing}),
v AS (SELECT * EXCLUDE (_t), coalesce(NOT (_t IN {empty})
        AND NOT regexp_matches(regexp_replace(_t, '[.\\-]', '', 'g'), {digits}), false) AS "Is_Valid"
      FROM (SELECT *, lower(regexp_replace("Site Response", {trim}, '', 'g')) AS _t FROM lst)),
sc AS (SELECT * EXCLUDE (_found), {", ".join(counts)}
      FROM (SELECT *, regexp_extract_all(replace(lower("Site Response"), '’', ''''), '{rx}') AS _found FROM v)),
cls AS (SELECT * EXCLUDE ({", ".join(f"_n{i}" for i in range(k))}),
      CASE WHEN NOT "Is_Valid" THEN 'INVALID' {" ".join(label_when)} ELSE {lit(rules.default_label)} END
        AS "LLM_Classification",
      CASE WHEN NOT "Is_Valid" THEN NULL
           WHEN {total} = 0 THEN CAST({rules.no_cue_confidence!r} AS DOUBLE)
           ELSE CAST({rules.base_confidence!r} AS DOUBLE)
                + (CAST({rules.share_weight!r} AS DOUBLE) * CAST(CASE {" ".join(win_when)} ELSE 0 END AS DOUBLE))
                  / CAST({total} AS DOUBLE) END AS "Confidence",
      CASE WHEN NOT "Is_Valid" THEN {lit(INVALID_REASONING)} ELSE {reason} END AS "Reasoning",
      false AS "Human_Reviewed"
    FROM sc)"""


EV = classified_sql(events_listing_sql())
DOC = classified_sql(documents_listing_sql())
LI = classified_sql(lineitem_listing_sql())
# places of the rows: DuckDB scans a file in its order
LI_PLACED = classified_sql(f"""SELECT * FROM (SELECT {", ".join(na(a, b) for a, b in [
    ("q", "Query ID"), ("st", "Study Alias"), ("it", "CRF Item"), ("re", "Site Response")])}, place FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS q,
        'RF-' || l_returnflag AS st, 'LS-' || l_linestatus AS it, ({PHRASES})[(l_orderkey + l_linenumber) % {N_PHRASES} + 1] AS re,
        row_number() OVER () AS place FROM lineitem))""")
OUT = '"Is_Valid", "LLM_Classification", "Confidence", "Reasoning", "Human_Reviewed"'


def with_ev(body: str, extra: str = "") -> str:
    return f"WITH {EV}{(', ' + extra) if extra else ''} {body}"


# -------------------------------------------------------------- corrections

CORR = f"""corr AS (SELECT CAST(event_id - event_id % 2 AS VARCHAR) AS row_key,
      ({"[" + ", ".join(lit(c) for c in CATEGORIES) + "]"})[user_id % 4 + 1] AS corrected_label,
      CASE WHEN event_id % 7 = 0 THEN NULL WHEN (event_id - event_id % 2) % 5 = 0 THEN event_id - event_id % 2
           ELSE event_id END AS seq FROM events WHERE value > 40),
ranked AS (SELECT row_key, corrected_label, row_number() OVER (PARTITION BY row_key ORDER BY seq DESC NULLS LAST,
        list_position({"[" + ", ".join(lit(c) for c in CATEGORIES) + "]"}, corrected_label) DESC) AS rn
      FROM corr WHERE corrected_label IN {CATS} AND row_key IS NOT NULL),
latest AS (SELECT row_key, corrected_label FROM ranked WHERE rn = 1)"""

APPLIED = f"""applied AS (SELECT cls.* EXCLUDE ("LLM_Classification", "Confidence", "Reasoning", "Human_Reviewed",
        _cl, _hit),
      CASE WHEN _hit THEN "LLM_Classification" ELSE NULL END AS "Original_Classification",
      CASE WHEN _hit THEN _cl ELSE "LLM_Classification" END AS "LLM_Classification",
      CASE WHEN _hit THEN CAST(1.0 AS DOUBLE) ELSE "Confidence" END AS "Confidence",
      CASE WHEN _hit THEN {lit(CORRECTED_REASONING)} ELSE "Reasoning" END AS "Reasoning",
      CASE WHEN _hit THEN true ELSE "Human_Reviewed" END AS "Human_Reviewed"
    FROM (SELECT cls.*, l.corrected_label AS _cl,
            (l.row_key IS NOT NULL AND {NOT_INVALID}) AS _hit
          FROM cls LEFT JOIN latest l ON cls.row_key = l.row_key) cls)"""


# ---------------------------------------------------------------- histogram

def histogram_sql(bins: int = 10) -> str:
    return f"""vc AS (SELECT "Confidence" AS v, count(*) AS cnt FROM cls
      WHERE {NOT_INVALID} AND "Confidence" IS NOT NULL AND NOT isnan("Confidence") GROUP BY 1),
r AS (SELECT min(v) AS mn0, max(v) AS mx0 FROM vc),
st AS (SELECT
      CASE WHEN mn0 = mx0 THEN (CASE WHEN mn0 = 0 THEN CAST(-0.001 AS DOUBLE)
           ELSE mn0 + CAST(-0.001 AS DOUBLE) * abs(mn0) END) ELSE mn0 END AS mn,
      CASE WHEN mn0 = mx0 THEN (CASE WHEN mx0 = 0 THEN CAST(0.001 AS DOUBLE)
           ELSE mx0 + CAST(0.001 AS DOUBLE) * abs(mx0) END) ELSE mx0 END AS mx,
      mn0 = mx0 AS same FROM r WHERE mn0 IS NOT NULL),
edges AS (SELECT b.i AS bin,
      CASE WHEN b.i = 1 THEN (CASE WHEN same THEN mn ELSE mn - (mx - mn) * CAST(0.001 AS DOUBLE) END)
           ELSE mn + CAST(b.i - 1 AS DOUBLE) * ((mx - mn) / CAST({bins} AS DOUBLE)) END AS lo,
      CASE WHEN b.i = {bins} THEN mx
           ELSE mn + CAST(b.i AS DOUBLE) * ((mx - mn) / CAST({bins} AS DOUBLE)) END AS hi
    FROM range(1, {bins + 1}) b(i), st)"""


HIST_SELECT = """SELECT CAST(e.bin AS BIGINT) AS bin, e.lo, e.hi, CAST(coalesce(sum(vc.cnt), 0) AS BIGINT) AS n
  FROM edges e LEFT JOIN vc ON vc.v > e.lo AND vc.v <= e.hi GROUP BY e.bin, e.lo, e.hi"""


# -------------------------------------------------------------------- model

def batched_sql() -> str:
    return f"""mv AS (SELECT row_key, CAST("Query ID" AS BIGINT) // {MODEL_BUCKET_ROWS} AS bucket,
        coalesce("CRF Item", 'nan') AS _item, coalesce("Site Response", 'nan') AS _resp
      FROM v WHERE "Is_Valid"),
mr AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_key) - 1 AS rn FROM mv),
mb AS (SELECT row_key, bucket, rn // {MODEL_BATCH} AS batch, rn % {MODEL_BATCH} AS pos,
        CAST(to_json(struct_pack(item := _item, answer := _resp)) AS VARCHAR) AS line
      FROM mr)"""


PROMPT_SELECT = f"""SELECT CAST(bucket AS BIGINT) AS bucket, CAST(batch AS BIGINT) AS batch,
    CAST(count(*) AS BIGINT) AS n_rows, string_agg(row_key, ',' ORDER BY pos) AS row_keys,
    {lit(default_instructions())} || chr(10) || 'LINES: ' || CAST(count(*) AS VARCHAR) || chr(10)
      || string_agg(line, chr(10) ORDER BY pos) AS prompt
  FROM mb GROUP BY bucket, batch"""

def replies_sql() -> str:
    """What every kind of reply (event id mod 11) must give for its three rows, stated as
    a table of results: kind, position, label, confidence, reasoning."""
    c, a, m = ("Confused", "0.25", "seen"), ("Affirmative", "1.0", "seen"), ("Medically Related", "0.5", "seen")
    fb = ("Miscellaneous", "0.0", FALLBACK_REASONING)
    kinds = [
        (c, a, m), (a, c, c), (m, fb, fb), (c, a, m), (fb, fb, fb), (fb, fb, fb), (c, m, a),
        (("Affirmative", "0.75", "seen"), ("Affirmative", "NULL", "seen"), a), (("Confused", "0.9", None), fb, ("Another", "0.1", "seen")),
        (fb, fb, fb), (fb, fb, fb),
    ]
    rows = ", ".join(f"({k}, {p}, {lit(x[0])}, CAST({x[1]} AS DOUBLE), {lit(x[2])})" for k, three in enumerate(kinds) for p, x in enumerate(three))
    return f"""SELECT CAST(e.event_id AS VARCHAR) || '-' || CAST(r.p AS VARCHAR) AS row_key, r.l AS _m_label, r.c AS _m_conf, r.r AS _m_reason
      FROM events e JOIN (VALUES {rows}) r(k, p, l, c, r) ON r.k = e.event_id % 11"""


PARSED_REPLIES = replies_sql()

MODEL_SELECT = f"""SELECT cls.* EXCLUDE ("LLM_Classification", "Confidence", "Reasoning"),
    CASE WHEN NOT "Is_Valid" THEN 'INVALID' ELSE coalesce(res._m_label, {lit(FALLBACK_LABEL)}) END AS "LLM_Classification",
    CASE WHEN NOT "Is_Valid" THEN NULL WHEN res._m_label IS NULL THEN CAST(0.0 AS DOUBLE) ELSE res._m_conf END AS "Confidence",
    CASE WHEN NOT "Is_Valid" THEN "Reasoning" WHEN res._m_label IS NULL THEN {lit(FALLBACK_REASONING)} ELSE res._m_reason END
      AS "Reasoning"
  FROM cls LEFT JOIN res
    ON res.row_key = CAST(CAST(cls.row_key AS BIGINT) // 3 * 3 AS VARCHAR) || '-' || CAST(CAST(cls.row_key AS BIGINT) % 3 AS VARCHAR)"""


# -------------------------------------------------------------------- summary

BUNDLE = f"""tot AS (SELECT CAST(count(*) AS BIGINT) AS n FROM cls WHERE {NOT_INVALID}),
cc AS (SELECT "LLM_Classification" AS key, CAST(count(*) AS BIGINT) AS n FROM cls
      WHERE {NOT_INVALID} AND "LLM_Classification" IS NOT NULL GROUP BY 1),
it AS (SELECT "CRF Item" AS key, CAST(count(*) AS BIGINT) AS n FROM cls
      WHERE "LLM_Classification" = 'Confused' AND "CRF Item" IS NOT NULL GROUP BY 1
      ORDER BY n DESC, key LIMIT 10),
bundle AS (
  SELECT 'total' AS section, CAST(0 AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS key, n,
         CAST(NULL AS DOUBLE) AS pct FROM tot
  UNION ALL
  SELECT 'category', CAST(row_number() OVER (ORDER BY cc.n DESC, cc.key) AS BIGINT), cc.key, cc.n,
         CASE WHEN tot.n > 0 THEN (CAST(cc.n AS DOUBLE) / CAST(tot.n AS DOUBLE)) * 100.0 ELSE 0.0 END
    FROM cc, tot
  UNION ALL
  SELECT 'confused_item', CAST(row_number() OVER (ORDER BY it.n DESC, it.key) AS BIGINT), it.key, it.n,
         CASE WHEN tot.n > 0 THEN (CAST(it.n AS DOUBLE) / CAST(tot.n AS DOUBLE)) * 100.0 ELSE 0.0 END
    FROM it, tot)"""

SUMMARY_SELECT = """SELECT '## Classification summary' || chr(10) || chr(10)
    || (SELECT 'Total answers classified: ' || CAST(n AS VARCHAR) FROM bundle WHERE section = 'total')
    || chr(10) || chr(10) || '### Answers per category'
    || coalesce(chr(10) || (SELECT string_agg('- ' || key || ': ' || CAST(n AS VARCHAR) || ' ('
          || CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || '%)', chr(10) ORDER BY rank)
        FROM (SELECT b.*, CASE WHEN tot.n > 0 THEN (b.n * 1000) // tot.n ELSE 0 END AS t
              FROM bundle b, tot WHERE section = 'category')), '')
    || chr(10) || chr(10) || '### Form items with the most confused answers' || chr(10)
    || coalesce((SELECT string_agg('- ' || key || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY rank)
        FROM bundle WHERE section = 'confused_item'), '- none') AS summary"""


# -------------------------------------------------------------------- queries

PENDING = f"""SELECT p.row_key, p."LLM_Classification" AS current_label,
             coalesce(l.corrected_label, CASE WHEN p."LLM_Classification" IN {CATS}
                      THEN p."LLM_Classification" ELSE 'Miscellaneous' END) AS corrected_label
           FROM page p LEFT JOIN latest l ON p.row_key = l.row_key
           WHERE coalesce(l.corrected_label, CASE WHEN p."LLM_Classification" IN {CATS}
                      THEN p."LLM_Classification" ELSE 'Miscellaneous' END)
                 IS DISTINCT FROM p."LLM_Classification\""""

RAGGED_LISTING = """SELECT CAST(event_id AS VARCHAR) AS "Query ID", CAST(event_id AS VARCHAR) AS row_key,
      CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'type, ' || event_type END AS "CRF Item",
      CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'saved, and "done"'
           WHEN 3 THEN 'which one?' ELSE 'pain' END AS "Site Response",
      event_id % 5 IN (1, 3, 4) AS has_surplus FROM events"""

_CLS_VALID = f"FROM cls WHERE {NOT_INVALID}"

ORACLE_SQL: dict[str, str] = {
    "validate_rows": with_ev('SELECT row_key, "Site Response", "Is_Valid" FROM v'),
    "validity_counts": with_ev(
        'SELECT CAST(count_if("Is_Valid") AS BIGINT) AS n_valid, '
        'CAST(count_if(NOT "Is_Valid") AS BIGINT) AS n_invalid, CAST(count(*) AS BIGINT) AS n_total FROM v'
    ),
    "classify_rules": with_ev("SELECT * FROM cls"),
    "classify_documents": f'WITH {DOC} SELECT row_key, "Study Alias", "Site", "CRF Item", {OUT} FROM cls',
    "classify_lineitem": f'WITH {classified_sql(lineitem_listing_sql())} '
                         f'SELECT row_key, "Query ID", "Study Alias", "CRF Item", {OUT} FROM cls',
    "classify_conversations": f'WITH {classified_sql(conversations_listing_sql())} '
                              f'SELECT row_key, "Subject", "CRF Item", {OUT} FROM cls',
    "row_keys_lineitem": f"SELECT * FROM ({lineitem_listing_sql()})",
    "listing_profile": f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(7 AS BIGINT) AS n_columns "
                       f"FROM ({events_listing_sql()})",
    "listing_preview": f"SELECT * FROM ({events_listing_sql()}) ORDER BY row_key LIMIT 10",
    "category_counts": with_ev(
        f'SELECT "LLM_Classification" AS label, CAST(count(*) AS BIGINT) AS n {_CLS_VALID} '
        'AND "LLM_Classification" IS NOT NULL GROUP BY 1'
    ),
    "category_counts_documents": f'WITH {DOC} SELECT "LLM_Classification" AS label, CAST(count(*) AS BIGINT) AS n '
                                 f'{_CLS_VALID} AND "LLM_Classification" IS NOT NULL GROUP BY 1',
    "category_counts_json": with_ev(
        f"""SELECT to_json(map_from_entries(list(struct_pack(k := label, v := n) ORDER BY label)))
             AS counts_json FROM (SELECT "LLM_Classification" AS label, CAST(count(*) AS BIGINT) AS n
             {_CLS_VALID} AND "LLM_Classification" IS NOT NULL GROUP BY 1)"""
    ),
    "validate_documents_strict": f"""WITH {DOC}
        SELECT row_key, "Study Alias", "Is_Valid" AND NOT coalesce(
            NOT regexp_matches(_g, '\\p{{L}}')
            OR regexp_matches(_g, '(^|[^\\p{{L}}])[b-df-hj-np-tv-xz]{{12,}}([^\\p{{L}}]|$)'), false) AS "Is_Valid"
        FROM (SELECT *, lower(regexp_replace("Site Response", '\\A[{WS_CLASS}]+|[{WS_CLASS}]+\\z', '', 'g')) AS _g
              FROM v)""",
    "category_cards": with_ev(
        """SELECT CAST(c.ordinal AS BIGINT) AS ordinal, c.category, CAST(coalesce(k.n, 0) AS BIGINT) AS n,
             CASE WHEN t.total > 0 THEN (CAST(coalesce(k.n, 0) AS DOUBLE) / CAST(t.total AS DOUBLE)) * 100.0
                  ELSE 0.0 END AS pct
           FROM (VALUES """ + ", ".join(f"({i + 1}, {lit(c)})" for i, c in enumerate(CATEGORIES)) +
        f""") c(ordinal, category)
           LEFT JOIN (SELECT "LLM_Classification" AS label, count(*) AS n {_CLS_VALID} GROUP BY 1) k
             ON k.label = c.category
           CROSS JOIN (SELECT count(*) AS total {_CLS_VALID}) t"""
    ),
    "results_header": with_ev(
        f"""SELECT CAST(count(*) AS BIGINT) AS n_rows,
             CAST(count_if({NOT_INVALID}) AS BIGINT) AS n_classified,
             CAST(count_if({NOT_INVALID} AND "Confidence" < CAST(0.7 AS DOUBLE)) AS BIGINT) AS n_low_confidence,
             CAST(count_if("LLM_Classification" = 'Medically Related') AS BIGINT) AS n_medical FROM cls"""
    ),
    "top_confused_items": with_ev(
        f"""SELECT "CRF Item" AS item, CAST(count(*) AS BIGINT) AS n {_CLS_VALID}
             AND "LLM_Classification" = 'Confused' AND "CRF Item" IS NOT NULL
           GROUP BY 1 ORDER BY n DESC, item LIMIT 10"""
    ),
    "top_confused_items_15": with_ev(
        f"""SELECT "CRF Item" AS item, CAST(count(*) AS BIGINT) AS n {_CLS_VALID}
             AND "LLM_Classification" = 'Confused' AND "CRF Item" IS NOT NULL
           GROUP BY 1 ORDER BY n DESC, item LIMIT 15"""
    ),
    "top_confused_sources": f"""WITH {DOC} SELECT "CRF Item" AS item, CAST(count(*) AS BIGINT) AS n {_CLS_VALID}
             AND "LLM_Classification" = 'Confused' AND "CRF Item" IS NOT NULL
           GROUP BY 1 ORDER BY n DESC, item LIMIT 15""",
    "confidence_histogram": with_ev(HIST_SELECT, histogram_sql()),
    "confidence_histogram_documents": f"WITH {DOC}, {histogram_sql()} {HIST_SELECT}",
    "study_category_pivot": with_ev(
        'SELECT "Study Alias" AS study, '
        + ", ".join(f'CAST(count_if("LLM_Classification" = {lit(c)}) AS BIGINT) AS "{c}"' for c in CATEGORIES)
        + f' {_CLS_VALID} AND "Study Alias" IS NOT NULL AND "LLM_Classification" IS NOT NULL GROUP BY 1'
    ),
    "study_category_pivot_lineitem": f"WITH {LI} "
    + 'SELECT "Study Alias" AS study, '
    + ", ".join(f'CAST(count_if("LLM_Classification" = {lit(c)}) AS BIGINT) AS "{c}"' for c in CATEGORIES)
    + f' {_CLS_VALID} AND "Study Alias" IS NOT NULL AND "LLM_Classification" IS NOT NULL GROUP BY 1',
    "confidence_histogram_lineitem": f"WITH {LI}, {histogram_sql()} {HIST_SELECT}",
    "study_category_counts": with_ev(
        f'SELECT "Study Alias" AS study, "LLM_Classification" AS label, CAST(count(*) AS BIGINT) AS n '
        f'{_CLS_VALID} AND "Study Alias" IS NOT NULL AND "LLM_Classification" IS NOT NULL GROUP BY 1, 2'
    ),
    "medical_listing": with_ev(
        'SELECT "Query ID", "Study Alias", "CRF Item", "Site Response", "Reasoning" FROM cls '
        "WHERE \"LLM_Classification\" = 'Medically Related'"
    ),
    "filtered_rows": with_ev(
        f'SELECT * FROM cls WHERE "LLM_Classification" IN {CATS} AND "Confidence" >= CAST(0.8 AS DOUBLE) '
        f'AND "CRF Item" = {lit(FILTER_ITEM)}'
    ),
    "filtered_rows_low": with_ev(
        "SELECT * FROM cls WHERE \"LLM_Classification\" IN ('Confused', 'Miscellaneous', 'INVALID') "
        'AND "Confidence" < CAST(0.6 AS DOUBLE)'
    ),
    "filtered_rows_medium": with_ev(
        f'SELECT * FROM cls WHERE "LLM_Classification" IN {CATS} AND "Confidence" >= CAST(0.6 AS DOUBLE) '
        'AND "Confidence" < CAST(0.8 AS DOUBLE)'
    ),
    "filter_options": with_ev('SELECT DISTINCT "CRF Item" AS item FROM cls WHERE "CRF Item" IS NOT NULL'),
    "shown_of_total": with_ev(
        f"""SELECT CAST(count_if("LLM_Classification" IN {CATS} AND "Confidence" >= CAST(0.8 AS DOUBLE)
             AND "CRF Item" = {lit(FILTER_ITEM)}) AS BIGINT) AS shown, CAST(count(*) AS BIGINT) AS total FROM cls"""
    ),
    "review_queue": with_ev(
        f"""SELECT row_key, "LLM_Classification", "Confidence", substr("Site Response", 1, 80) AS preview,
             "CRF Item", "Reasoning" {_CLS_VALID} AND "Confidence" < CAST(0.7 AS DOUBLE)
           ORDER BY "Confidence" ASC NULLS LAST, row_key LIMIT 50"""
    ),
    "review_queue_all": with_ev(
        f"""SELECT row_key, "LLM_Classification", "Confidence", "Site Response" {_CLS_VALID}
           ORDER BY row_key LIMIT 50"""
    ),
    "pending_corrections": with_ev(PENDING, f"{CORR}, page AS (SELECT * {_CLS_VALID} ORDER BY row_key LIMIT 50)"),
    "apply_corrections": with_ev("SELECT * FROM applied", f"{CORR}, {APPLIED}"),
    "label_agreement": with_ev(
        'SELECT "Original_Classification" AS model_label, '
        + ", ".join(f'CAST(count_if("LLM_Classification" = {lit(c)}) AS BIGINT) AS "{c}"' for c in CATEGORIES)
        + """, CAST(count(*) AS BIGINT) AS n_reviewed,
             CAST(count_if("Original_Classification" = "LLM_Classification") AS BIGINT) AS n_agree,
             CAST(count_if("Original_Classification" = "LLM_Classification") AS DOUBLE)
               / CAST(count(*) AS DOUBLE) AS agreement
           FROM applied WHERE "Human_Reviewed" AND "Original_Classification" IS NOT NULL GROUP BY 1""",
        f"{CORR}, {APPLIED}",
    ),
    "confusion_alert": with_ev(
        f"""SELECT scope, study, n_valid, n_confused,
             CASE WHEN n_valid > 0 THEN CAST(n_confused AS DOUBLE) / CAST(n_valid AS DOUBLE) END AS confused_rate,
             CASE WHEN n_valid > 0 THEN CAST(n_confused AS DOUBLE) / CAST(n_valid AS DOUBLE) END
               > CAST(0.3 AS DOUBLE) AS alert
           FROM (
             SELECT 'overall' AS scope, CAST(NULL AS VARCHAR) AS study, CAST(count(*) AS BIGINT) AS n_valid,
                    CAST(count_if("LLM_Classification" = 'Confused') AS BIGINT) AS n_confused {_CLS_VALID}
               HAVING count(*) > 0
             UNION ALL
             SELECT 'study', "Study Alias", CAST(count(*) AS BIGINT),
                    CAST(count_if("LLM_Classification" = 'Confused') AS BIGINT) {_CLS_VALID}
               AND "Study Alias" IS NOT NULL GROUP BY "Study Alias")"""
    ),
    "site_confusion": with_ev(
        f"""SELECT "Site" AS site, CAST(count(*) AS BIGINT) AS n_valid,
             CAST(count_if("LLM_Classification" = 'Confused') AS BIGINT) AS n_confused,
             CAST(count_if("LLM_Classification" = 'Confused') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS confused_rate
           {_CLS_VALID} AND "Site" IS NOT NULL GROUP BY 1 HAVING count(*) >= {SITE_MIN_ROWS}"""
    ),
    "affirmative_worklist": with_ev(
        """SELECT w.row_key, w."Query ID", w."Study Alias", w."Site", w."CRF Item", w."Site Response",
             CAST(coalesce(ak.n, 0) AS BIGINT) AS n_audit_changes, ak.qid IS NOT NULL AS has_audit_change
           FROM cls w LEFT JOIN ak ON w."Query ID" = ak.qid
           WHERE w."LLM_Classification" = 'Affirmative'""",
        """ak AS (SELECT CAST(event_id - event_id % 3 AS VARCHAR) AS qid, count(*) AS n FROM events
             WHERE event_type IN ('purchase', 'signup') GROUP BY 1)""",
    ),
    "summary_bundle": with_ev("SELECT * FROM bundle", BUNDLE),
    "summary_text": with_ev(SUMMARY_SELECT, BUNDLE),
    "prompt_batches": with_ev(PROMPT_SELECT, batched_sql()),
    "parse_replies": PARSED_REPLIES,
    "model_results": with_ev(MODEL_SELECT, f"res AS ({PARSED_REPLIES})"),
    "confused_rows": with_ev("SELECT * FROM cls WHERE \"LLM_Classification\" = 'Confused'"),
    "pending_corrections_all": with_ev(PENDING, f"{CORR}, page AS (SELECT * {_CLS_VALID})"),
    "ignored_corrections": with_ev(
        f"""SELECT c.row_key, c.corrected_label, c.seq,
             CASE WHEN c.row_key IS NULL THEN 'no row key' WHEN NOT coalesce(c.corrected_label IN {CATS}, false)
                  THEN 'unknown label' WHEN k.row_key IS NULL THEN 'unknown row' ELSE 'invalid answer' END AS reason
           FROM (SELECT CASE WHEN seq IS NULL THEN NULL WHEN seq % 9 = 0 THEN row_key || '-x' ELSE row_key END AS row_key,
                        CASE WHEN seq % 4 = 1 THEN lower(corrected_label) ELSE corrected_label END AS corrected_label,
                        seq FROM corr) c
           LEFT JOIN cls k ON k.row_key = c.row_key
           WHERE c.row_key IS NULL OR NOT coalesce(c.corrected_label IN {CATS}, false) OR k.row_key IS NULL
              OR k."LLM_Classification" = 'INVALID'""",
        CORR,
    ),
    "classify_custom_rules": f'WITH {classified_sql(documents_listing_sql(), CUSTOM_RULES)} SELECT row_key, {OUT} FROM cls',
    "classify_ragged_csv": f'WITH {classified_sql(RAGGED_LISTING)} '
                           f'SELECT row_key, "CRF Item", "Site Response", has_surplus, {OUT} FROM cls',
    "csv_round_trip": with_ev("SELECT * FROM cls"),
    "export_by_category": with_ev(
        f"SELECT *, lower(replace(\"LLM_Classification\", ' ', '_')) AS category_slug FROM cls "
        f'WHERE "LLM_Classification" IN {CATS}'
    ),
    "classify_csv_listing": with_ev("SELECT * FROM cls"),
    "export_positions": with_ev(
        'SELECT row_key, "Is_Valid", "LLM_Classification", '
        'CAST(row_number() OVER (ORDER BY "Is_Valid" DESC, row_key) - 1 AS BIGINT) AS row_pos FROM cls'
    ),
    "stratified_key_sample": with_ev(
        """SELECT * FROM cls
           WHERE CAST(CAST(('0x' || substr(md5('11|' || row_key), 1, 8)) AS BIGINT) AS DOUBLE)
                 < (CASE "Study Alias" WHEN 'ALPHA-01' THEN CAST(0.1 AS DOUBLE)
                      WHEN 'BETA-00' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END)
                   * CAST(4294967296.0 AS DOUBLE)"""
    ),
    "stream_classify": with_ev("SELECT * FROM cls"),
    "stream_apply_corrections": with_ev("SELECT * FROM applied", f"{CORR}, {APPLIED}"),
    "stream_category_counts": with_ev(
        f'SELECT "LLM_Classification" AS label, CAST(count(*) AS BIGINT) AS n {_CLS_VALID} '
        'AND "LLM_Classification" IS NOT NULL GROUP BY 1'
    ),
    "export_positions_input": f"""WITH {LI_PLACED}
        SELECT "Query ID", "Is_Valid", "LLM_Classification",
               row_number() OVER (ORDER BY NOT "Is_Valid", place) - 1 AS row_pos FROM cls""",
    "alert_report": with_ev(
        f"""SELECT section, scope, study, CAST(rank AS BIGINT) AS rank, key, CAST(n AS BIGINT) AS n,
             CAST(n AS DOUBLE) / CAST(total AS DOUBLE) * CAST(100.0 AS DOUBLE) AS pct,
             CASE section WHEN 'total' THEN CAST(n AS DOUBLE) / CAST(total AS DOUBLE) > CAST(0.3 AS DOUBLE) END AS alert
           FROM (SELECT 'total' AS section, scope, study, 0 AS rank, CAST(NULL AS VARCHAR) AS key, confused AS n, total FROM totals
             UNION ALL
             SELECT 'breakdown', scope, study, row_number() OVER (PARTITION BY scope, study ORDER BY n DESC, label), label, n, total
             FROM (SELECT scope, study, label, count(*) AS n FROM rows WHERE label IS NOT NULL GROUP BY ALL)
               JOIN totals t USING (scope, sk)
             UNION ALL
             SELECT * FROM (SELECT 'top_item', scope, study, row_number() OVER (PARTITION BY scope, study ORDER BY n DESC, item) AS r, item, n, total
               FROM (SELECT scope, study, item, count(*) AS n FROM rows WHERE label = 'Confused' AND item IS NOT NULL GROUP BY ALL)
                 JOIN totals t USING (scope, sk)) WHERE r <= 3)""".replace("SELECT scope, study, label, count", "SELECT scope, study, sk, label, count")
        .replace("SELECT scope, study, item, count", "SELECT scope, study, sk, item, count").replace("'breakdown', scope, study,", "'breakdown', scope, t.study,")
        .replace("'top_item', scope, study,", "'top_item', scope, t.study,").replace("PARTITION BY scope, study", "PARTITION BY scope, sk"),
        f"""rows AS (SELECT 'overall' AS scope, CAST(NULL AS VARCHAR) AS study, '' AS sk, "CRF Item" AS item, "LLM_Classification" AS label {_CLS_VALID}
             UNION ALL SELECT 'study', "Study Alias", "Study Alias", "CRF Item", "LLM_Classification" {_CLS_VALID} AND "Study Alias" IS NOT NULL),
           totals AS (SELECT scope, study, sk, count(*) AS total, count(*) FILTER (label = 'Confused') AS confused FROM rows GROUP BY ALL)"""
    ),
    "consistent_sites": with_ev(
        """SELECT site, min(day) AS first_period, max(day) AS last_period, CAST(count(*) AS BIGINT) AS n_periods,
             CAST(sum(v) AS BIGINT) AS n_valid, CAST(sum(k) AS BIGINT) AS n_confused
           FROM (SELECT *, sum(CASE WHEN day = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY day) AS run
                 FROM (SELECT *, lag(day) OVER (PARTITION BY site ORDER BY day) AS before FROM days
                       WHERE CAST(k AS DOUBLE) / CAST(v AS DOUBLE) > CAST(0.25 AS DOUBLE)))
           GROUP BY site, run HAVING count(*) >= 3""",
        f"""days AS (SELECT "Site" AS site, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, count(*) AS v,
             count(*) FILTER ("LLM_Classification" = 'Confused') AS k
             FROM cls JOIN events ON CAST(event_id AS VARCHAR) = row_key WHERE {NOT_INVALID} AND "Site" IS NOT NULL GROUP BY ALL)"""
    ),
    "exact_study_sample": with_ev(
        """SELECT * FROM cls QUALIFY row_number() OVER (PARTITION BY "Study Alias"
             ORDER BY CAST('0x' || substr(md5('5|' || row_key), 1, 8) AS BIGINT), row_key) <= 40"""
    ),
    "merge_corrections": with_ev("SELECT * FROM applied", f"{CORR}, {APPLIED}"),
    "column_fill": f"""WITH l AS ({events_listing_sql()})
        SELECT role, "column", present, n_filled, (SELECT count(*) FROM l) AS n_rows FROM (
          SELECT 'response' AS role, 'Site Response' AS "column", true AS present, count("Site Response") AS n_filled FROM l
          UNION ALL SELECT 'item', 'CRF Item', true, count("CRF Item") FROM l
          UNION ALL SELECT 'query_id', 'Query ID', true, count("Query ID") FROM l
          UNION ALL SELECT 'study', 'Study Alias', true, count("Study Alias") FROM l
          UNION ALL SELECT 'original_query', 'Original Query', false, 0
          UNION ALL SELECT 'site', 'Site', true, count("Site") FROM l)""",
    "classify_own_roles": with_ev(
        f"""SELECT "Study Alias" AS study, "LLM_Classification" AS label, CAST(count(*) AS BIGINT) AS n {_CLS_VALID}
            AND "Study Alias" IS NOT NULL GROUP BY 1, 2"""
    ),
    "stream_window_alerts": with_ev(
        f"""SELECT date_trunc('day', ts) AS window_start, "Study Alias" AS study, CAST(count(*) AS BIGINT) AS n_valid,
             CAST(count(*) FILTER ("LLM_Classification" = 'Confused') AS BIGINT) AS n_confused,
             CAST(count(*) FILTER ("LLM_Classification" = 'Confused') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS confused_rate,
             CAST(count(*) FILTER ("LLM_Classification" = 'Confused') AS DOUBLE) / CAST(count(*) AS DOUBLE) > CAST(0.3 AS DOUBLE) AS alert
           FROM cls JOIN events ON CAST(event_id AS VARCHAR) = row_key WHERE {NOT_INVALID} GROUP BY ALL"""
    ),
    "stream_deciding_corrections": f"""WITH {CORR.replace("SELECT row_key, corrected_label, row_number()", "SELECT row_key, corrected_label, seq, row_number()")}
        SELECT row_key, corrected_label, seq FROM ranked WHERE rn = 1""",
    "classify_category_table": f"WITH {DOC} SELECT row_key, {OUT} FROM cls",
    "noise_documents": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id % 7 = 0, false) AS planted,
             translate(sha256(CAST(doc_id AS VARCHAR)), '0123456789abcdef', '{NOISE_LETTERS}') AS h, text FROM documents),
        t AS (SELECT rid, doc_id, planted, trim(regexp_replace(regexp_replace(lower(coalesce(CASE WHEN planted THEN
             concat_ws(' ', h[1:9], h[10:14], h[15:26], h[27:33], h[34:44], h[45:52], h[53:64]) ELSE text END, '')), '[^\\p{{L}}]+', ' ', 'g'), '[^a-z ]', '~', 'g')) AS t FROM d),
        c AS (SELECT rid, unnest(string_split(t, '')) AS ch, unnest(range(length(t))) AS place FROM t WHERE length(t) > 1),
        p AS (SELECT rid, ch || nxt AS pair FROM (SELECT rid, ch, lead(ch) OVER (PARTITION BY rid ORDER BY place) AS nxt FROM c) WHERE nxt IS NOT NULL),
        seen AS (SELECT pair, left(pair, 1) AS a, count(*) AS n FROM p GROUP BY pair),
        w AS (SELECT pair, n, CAST(floor(1000 * ln(CAST(n + 1 AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY a) + 28 AS DOUBLE)) + 0.5) AS BIGINT) AS w FROM seen),
        m AS (SELECT CAST(floor(CAST(sum(n * w) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS mean FROM w),
        s AS (SELECT rid, count(*) AS pairs, CAST(sum(w) AS BIGINT) AS total FROM p JOIN w USING (pair) GROUP BY rid)
        SELECT doc_id, planted, coalesce(pairs, 0) AS pairs, coalesce(total, 0) AS total,
               coalesce(pairs, 0) >= {LEAST_PAIRS} AND coalesce(total, 0) < coalesce(pairs, 0) * (mean - {MARGIN}) AS noise
        FROM t CROSS JOIN m LEFT JOIN s USING (rid)""",
    "open_prompts": with_ev(
        f"SELECT sha256(prompt) AS digest, CAST(length(any_value(prompt)) AS BIGINT) AS n_chars FROM ({PROMPT_SELECT}) WHERE sha256(prompt) >= '8' GROUP BY 1",
        batched_sql()),
}
