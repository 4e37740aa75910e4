"""Listings derived from the benchmark tables (``/root/testdata/sf*/``).

The benchmark tables hold no query listing, so these functions build one with
Spark from each table; the work grows with the table. The same derivations
are written in SQL in ``plans/oracle.py`` for the differential check.

* ``events``       -> one query per event; answer picked from ``ANSWER_PHRASES``
* ``documents``    -> one query per document; the whole document text is the answer
* ``lineitem``     -> one query per line, keys not unique (exercises row keys)
* ``conversations`` -> user turn as the original query, the next turn as the answer
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES

# ---------------------------------------------------------------------------
# Answers for listings from tables without free text, written for each value class:
# the categories, mixed and denied cues, null, blanks, reader null tokens, numbers,
# dates, quotes and line breaks. An answer is picked by index (key % n).
# ---------------------------------------------------------------------------
ANSWER_PHRASES = (
    "Stop date amended",
    "resolved",
    "Weight added for this visit",
    "Unit removed, value saved",
    "DONE!",
    "Record revised and completed on site",
    "How should a missing time be reported?",
    "No access to that page since Monday",
    "unsure if this is still needed",
    "Which one of the two visits is meant",
    "The button is greyed out for our team",
    "Please advise",
    "won't save, shows an error message",
    "Mild rash on the left arm",
    "Nausea and vomiting after the second infusion",
    "Chronic headache since childhood",
    "Physician judged the finding not clinically relevant",
    "Blood pressure in range, therapy goes on",
    "Drug stopped, entry amended",
    "Treated in hospital; narrative added and revised",
    "Corrected, yet unclear if the visit counts?",
    "paper copy attached",
    "we answer next week",
    "n.a. for this cohort",
    "TBC",
    "ok",
    ".",
    None,
    "",
    "   ",
    "N/A",
    " N/A",
    "NA",
    "nan",
    "None ",
    "37.4",
    "2019-11-05",
    "5/11/2019",
    "\u2003",
    "not corrected yet",
    "Nothing was changed, value stands as entered",
    'Noted: "see line 4", and\na second line',
    "Don\u2019t know \u2014 form isn\u2019t ours",
    "Fever entered, drug dose reduced",
    "Team says: UPDATED.",
    "not added, not removed, but saved",
    "pain",
)

# Listing header used for every derived listing (the usual listing headers).
QUERY_ID = "Query ID"
STUDY = "Study Alias"
SITE = "Site"
SUBJECT = "Subject"
ITEM = "CRF Item"
ORIGINAL_QUERY = "Original Query"
RESPONSE = "Site Response"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrase_at(index: Column) -> Column:
    """``ANSWER_PHRASES[index mod n]`` as a column (a literal array lookup)."""
    arr = F.array(*[F.lit(p).cast("string") for p in ANSWER_PHRASES])
    return F.element_at(arr, (F.pmod(index, F.lit(len(ANSWER_PHRASES))) + 1).cast("int"))


# Put into the texts of other tables, whose invented prose has no cues.
PLANTED_PHRASES = (
    "the value was corrected and saved", "no access to that page", "patient with chronic pain under therapy",
    "nothing of the kind", "added, revised, but the diagnosis stands", "which one is meant, please clarify?",
    "not corrected yet", "symptoms of an infection, entry updated",
)


def planted(text: Column, number: Column) -> Column:
    """The whole text with a phrase put in: which one and where follows from ``number``."""
    at = F.pmod(number * F.lit(37), F.char_length(text) + 1).cast("int")
    arr = F.array(*[F.lit(p) for p in PLANTED_PHRASES])
    phrase = F.element_at(arr, (F.pmod(number, F.lit(len(PLANTED_PHRASES))) + 1).cast("int"))
    return F.concat(F.left(text, at), F.lit(" "), phrase, F.lit(" "), F.substr(text, at + 1))


def events_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_listing(table(spark, sf_dir, "events"))


def events_to_listing(e: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Row-local projection of ``events`` rows to listing rows (batch or stream); ``extra``
    columns of ``events`` come along."""
    uid = F.col("user_id")
    study = (
        F.when(F.pmod(uid, F.lit(17)) == 0, F.lit(None).cast("string"))
        # a third of the users share one study: a deliberately hot group key
        .when(F.pmod(uid, F.lit(3)) == 0, F.lit("ALPHA-01"))
        .otherwise(F.concat(F.lit("BETA-0"), F.pmod(uid, F.lit(5)).cast("string")))
    )
    return e.select(
        F.col("event_id").cast("string").alias(QUERY_ID),
        study.alias(STUDY),
        F.concat(F.lit("S"), (F.pmod(uid, F.lit(23)) + 1000).cast("string")).alias(SITE),
        uid.cast("string").alias(SUBJECT),
        F.when(F.pmod(F.col("event_id"), F.lit(53)) == 0, F.lit(None).cast("string"))
        # 7 forms for each type, so that top lists have something to cut
        .otherwise(F.concat(F.col("event_type"), F.lit("-"), F.pmod(uid, F.lit(7)).cast("string"))).alias(ITEM),
        F.concat(F.lit("Please review "), F.col("event_type"), F.lit(" for subject "),
                 uid.cast("string")).alias(ORIGINAL_QUERY),
        phrase_at(F.col("event_id")).alias(RESPONSE),
        *extra,
    )


def documents_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias(QUERY_ID),
        F.col("lang").alias(STUDY),
        F.col("source").alias(SITE),
        F.col("source").alias(ITEM),
        planted(F.col("text"), F.col("doc_id")).alias(RESPONSE),
    )


def lineitem_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_to_listing(table(spark, sf_dir, "lineitem"))


def lineitem_to_listing(li: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias(QUERY_ID),
        F.concat(F.lit("RF-"), F.col("l_returnflag")).alias(STUDY),
        F.concat(F.lit("LS-"), F.col("l_linestatus")).alias(ITEM),
        phrase_at(F.col("l_orderkey") + F.col("l_linenumber")).alias(RESPONSE),
        *extra,
    )


def conversations_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn -> the next turn of the same conversation (null if there is none).

    An equi-join on (conv_id, turn + 1) rather than ``lead`` over a window per
    conversation: a very long conversation then spreads over many tasks.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    q = c.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("q_turn"),
        F.col("text").alias(ORIGINAL_QUERY),
    )
    a = c.select("conv_id", "turn", F.col("role").alias("a_role"),
                 planted(F.col("text"), F.col("conv_id") + F.col("turn")).alias(RESPONSE))
    j = q.join(a, ["conv_id", "turn"], "left")  # a turn without a next one has no answer
    return j.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("q_turn").cast("string")).alias(QUERY_ID),
        F.col("conv_id").cast("string").alias(SUBJECT),
        F.col("a_role").alias(ITEM),
        F.col(ORIGINAL_QUERY),
        F.col(RESPONSE),
    )


def events_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_corrections(table(spark, sf_dir, "events"))


def events_to_corrections(e: DataFrame) -> DataFrame:
    """Reviewer decisions derived from ``events`` rows (batch or stream): two events propose a
    label for the same query (even event ids); some have the same ``seq``, some none."""
    i = F.col("event_id")
    even = i - F.pmod(i, F.lit(2))
    seq = F.when(F.pmod(i, F.lit(7)) == 0, F.lit(None).cast("long")).when(F.pmod(even, F.lit(5)) == 0, even).otherwise(i)
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return e.where(F.col("value") > 40).select(
        (F.col("event_id") - F.pmod(F.col("event_id"), F.lit(2))).cast("string").alias("row_key"),
        F.element_at(cats, (F.pmod(F.col("user_id"), F.lit(4)) + 1).cast("int")).alias("corrected_label"),
        seq.cast("long").alias("seq"),
    )


def events_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit trail derived from ``events``: a logged data change per query id
    (several entries per id are possible)."""
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("purchase", "signup")).select(
        (F.col("event_id") - F.pmod(F.col("event_id"), F.lit(3))).cast("string").alias(QUERY_ID),
        F.col("ts").alias("changed_at"),
    )


def events_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies of every kind, one for each event, for the rows ``<id>-0`` to ``<id>-2``:
    plain, in a Markdown fence, short, long, empty, prose only, prose around, confidence as
    text or as a word, reasoning left out, label null or unknown, broken JSON, no reply."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    i = F.col("event_id").cast("string")

    def entry(label: str, confidence: str, reasoning: str | None = "\"seen\"") -> Column:
        tail = "" if reasoning is None else f", \"reasoning\": {reasoning}"
        return F.concat(F.lit(f'{{"index": 7, "classification": {label}, "confidence": {confidence}{tail}, "note": '), i, F.lit("}"))

    one, two, three = entry('"Confused"', "0.25"), entry('"Affirmative"', "1"), entry('"Medically Related"', "0.5")

    def listed(*entries) -> Column:
        return F.concat(F.lit("["), *[x for k, e in enumerate(entries) for x in ((F.lit(", "), e) if k else (e,))], F.lit("]"))

    kinds = [
        listed(one, two, three),
        F.concat(F.lit("```json\n"), listed(two, one, one), F.lit("\n```")),
        listed(three),
        listed(one, two, three, one),
        F.lit("[]"),
        F.lit("I would rather not."),
        F.concat(F.lit("Here they are:\n"), listed(one, three, two), F.lit("\nbye")),
        listed(entry('"Affirmative"', '"0.75"'), entry('"Affirmative"', '"sure"'), two),
        listed(entry('"Confused"', "0.9", None), entry("null", "0.9"), entry('"Another"', "0.1")),
        F.concat(F.lit("["), one, F.lit(", {]")),
        F.lit(None).cast("string"),
    ]
    which = F.pmod(F.col("event_id"), F.lit(len(kinds)))
    reply = F.when(which == 0, kinds[0])
    for k, text in enumerate(kinds[1:], 1):
        reply = reply.when(which == k, text)
    return e.select("event_id", F.array(*[F.concat(i, F.lit(f"-{k}")) for k in range(3)]).alias("row_keys"), reply.alias("reply"))


def events_ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of three columns (query id, item, answer) in one column named by the header
    line. Some lines lack the answer, some have fields after it, one kind after a blank answer."""
    e = table(spark, sf_dir, "events")
    i, header = F.col("event_id"), f"{QUERY_ID},{ITEM},{RESPONSE}"
    full = F.concat(i.cast("string"), F.lit(',"type, '), F.col("event_type"), F.lit('",'))
    line = (
        F.when(F.pmod(i, F.lit(5)) == 0, F.concat(i.cast("string"), F.lit(","), F.col("event_type")))
        .when(F.pmod(i, F.lit(5)) == 1, F.concat(full, F.lit(",extra")))
        .when(F.pmod(i, F.lit(5)) == 2, F.concat(full, F.lit('"saved, and ""done"""')))
        .when(F.pmod(i, F.lit(5)) == 3, F.concat(full, F.lit("which one?,a,b")))
        .otherwise(F.concat(full, F.lit("pain,")))
    )
    return e.select(line.alias(header))


#: Letters that stand for the digits of a digest in planted noise: in no order of any language.
NOISE_LETTERS = "qxzjkvwbtaegioup"


def documents_with_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, planted, text): documents in which each seventh id has letters of a digest, cut
    into words, as its text."""
    digest = F.translate(F.sha2(F.col("doc_id").cast("string"), 256), "0123456789abcdef", NOISE_LETTERS)
    words = F.concat_ws(" ", *[F.substring(digest, at, n) for at, n in ((1, 9), (10, 5), (15, 12), (27, 7), (34, 11), (45, 8), (53, 12))])
    planted = F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", planted.alias("planted"), F.when(planted, words).otherwise(F.col("text")).alias("text"))
