"""Conversation structure repair (13): a suffix-shared automaton over role/fault signatures.

A conversation is the list of its rows by turn (nulls first; equal turns by role, then by
the md5 of the text). Its first faults: ``blank`` (nothing but ``[\\x20\\x09-\\x0D]``),
``duplicate`` (role and text seen earlier in the conversation), ``truncated`` (the last
other character is not one of ``.!?``). The repair makes the initials of its roles spell
``(s?(ua)+)?`` at the least cost: Keep 0, Rerole to user or assistant 1, Delete 2 (the only
edit of a blank or duplicate row), Insert an empty user or assistant turn 5; a truncated
row that stays costs 5 more. The audit is the edits' initials in order; of all cheapest
ones the ASCII-least.

How. One byte for each row, its role class and fault, makes the conversation's signature.
Distinct signatures of all conversations are sorted from their ends, so those with a common
suffix are neighbours, and a task walks them as a tree of suffixes: a suffix that several
share is one node. Nodes are minimised further: two suffixes whose costs-to-go differ by
the same amount in every grammar state have the same edits in front of them, so they are
one state of the automaton, and each (symbol, state) is solved once. A node knows for each of
the four grammar states the cost to go and the edits at its first symbol; the audit is read
off along the nodes. Signatures meet their conversations by a join.

Scale. Two shuffles by conversation, one without texts; sorted partitions are walked as
streams, so a conversation of any length takes a byte for each of its rows (its signature and its
audit, which are results) and never its texts. Its SHA-256 is one stream by
definition, so one conversation's texts pass through one task, batch by batch.

Defined cases: a null role or text is one space; a null conv_id is a conversation, a
null turn sorts first and counts in no gap; an empty role has no initial and can't be kept;
of any other role the first letter counts; repeated rows are duplicates; a conversation
without rows has an empty audit; an empty table gives an empty result; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, quoted, read_table, ship_package, stage, text_slices

#: Costs of the edits, the roles that edits give, blanks and ends of a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_CHARS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = (".", "!", "?")

# Grammar states: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Role that an edit gives in a state, and the state behind it.
NEXT = (("user", AFTER_U), ("user", AFTER_U), ("assistant", AFTER_A), ("user", AFTER_U))
#: What may be kept in a state.
KEEPS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
MUST_GO, LOST = "x", "-"  # symbols: a row to delete, a row that damage dropped


def _settled(options: list[list[tuple[int, str, int | None]]]) -> tuple:
    """For each state the cheapest (cost, letters, next state), inserts included.

    ``options[s]``: (cost, letter, next state) of the edits that consume the symbol. The
    first letters of the choices differ, so the ASCII-least audit takes the least letter.
    """
    own = [min(o, default=None) for o in options]
    best = list(own)
    # two inserts in a row lead back to the same state, so one is looked at behind u and a
    for s, after in ((AFTER_U, own[AFTER_A]), (AFTER_A, own[AFTER_U]), (START, None), (AFTER_S, None)):
        after = after or best[NEXT[s][1]]
        if after is not None:
            turn = (after[0] + INSERT, "I" + after[1], after[2])
            best[s] = turn if own[s] is None else min(own[s], turn, key=lambda b: b[:2])
    return tuple(best)


class Automaton:
    """Solves (symbol, costs to go) once; the costs are kept relative to the least."""

    def __init__(self):
        end = _settled([[(0, "", None)], [], [], [(0, "", None)]])
        self.end = self._node(end)
        self.made: dict[tuple[str, tuple[int, ...]], tuple] = {}

    @staticmethod
    def _node(best) -> tuple:
        """(least cost, relative costs, (letters, next state) for each state)."""
        least = min(b[0] for b in best)
        return least, tuple(b[0] - least for b in best), tuple((b[1], b[2]) for b in best)

    def before(self, symbol: str, child: tuple) -> tuple:
        """The node of ``symbol`` in front of ``child``."""
        found = self.made.get((symbol, child[1]))
        if found is None:
            found = self.made[symbol, child[1]] = self._node(self._solve(symbol, child[1]))
        return child[0] + found[0], found[1], found[2]

    @staticmethod
    def _solve(symbol: str, to_go: tuple[int, ...]) -> tuple:
        stays = TRUNCATED if symbol.isupper() else 0
        options = []
        for s in range(4):
            own = [(DELETE + to_go[s], "D", s)]
            if symbol != MUST_GO:
                role, after = NEXT[s]
                own.append((REROLE + stays + to_go[after], "R", after))
                kept = KEEPS[s].get(symbol.lower())
                if kept is not None:
                    own.append((stays + to_go[kept], "K", kept))
            options.append(own)
        return _settled(options)


def audit_of(nodes: list[tuple]) -> str:
    """The audit from the start, along ``nodes`` (the whole signature's node first)."""
    state, out = START, []
    for _, _, steps in nodes:
        letters, state = steps[state]
        out.append(letters)
    return "".join(out)


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, cost long, audit) for each distinct ``signature``."""
    ship_package(signatures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton()
        path, before = [machine.end], ""
        for batch in batches:
            names, costs, audits = [], [], []
            for backwards in batch.column(0).to_pylist():
                shared = 0
                while shared < min(len(before), len(backwards)) and before[shared] == backwards[shared]:
                    shared += 1
                del path[shared + 1:]
                for symbol in backwards[shared:]:
                    path.append(machine.before(symbol, path[-1]))
                before = backwards
                least, to_go, _ = path[-1]
                names.append(backwards[::-1])
                costs.append(least + to_go[START])
                audits.append(audit_of(path[::-1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                                             ["signature", "cost", "audit"])

    ends = signatures.select(F.reverse("signature").alias("backwards")).distinct()
    parts = max(int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    return ends.repartitionByRange(parts, "backwards").sortWithinPartitions("backwards").mapInArrow(run, "signature string, cost long, audit string")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls of role and text one space; ``dropped`` is false."""
    return conversations.select(
        quoted("conv_id").alias("conv_id"), quoted("turn").alias("turn"),
        *[F.coalesce(quoted(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("dropped"))


def damage(conversations: DataFrame) -> DataFrame:
    """``turns`` with the damage that crc32 of ``conv_id:turn`` mod 20 deals; dropped rows stay, marked."""
    rows = turns(conversations)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("dealt", F.crc32(key.cast("binary")) % 20)
    rows = rows.withColumns({
        "dropped": F.col("dealt") == 0,
        "text": F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", "".join(SENTENCE_ENDS), "")).otherwise(F.col("text")),
        "role": F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")),
        "copies": F.explode(F.when(F.col("dealt") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    })
    return rows.drop("dealt", "copies")


def _order():
    return (F.col("turn").asc_nulls_first(), F.col("role"), F.md5(F.col("text").cast("binary")))


def signatures(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (as ``turns`` makes them): conv_id, gaps, blank,
    duplicate, truncated, illegal (longs), signature."""
    ship_package(rows.sparkSession)
    ended = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    narrow = rows.select(
        "conv_id", "turn", "role", "dropped", F.md5(F.col("text").cast("binary")).alias("digest"),
        (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(*SENTENCE_ENDS)).alias("truncated"))
    again = W.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    # the window keeps the partitioning by conversation, so rows move once
    marked = narrow.repartition("conv_id").withColumn("again", F.row_number().over(again) > 1).select(
        "conv_id", "turn", "role", "digest", "again", initial.alias("initial"),
        F.when(F.col("dropped"), LOST).when(F.col("blank"), "b").when(F.col("again"), "d")
        .when(F.col("truncated"), F.upper(symbol)).otherwise(symbol).alias("mark"))
    marked = marked.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "digest", "again")
    key = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for conv, turn, initial, mark in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or now.conv != conv:
                    out += [now.row()] if now is not None else []
                    now = _Conversation(conv)
                now.add(turn, initial, mark)
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in out], schema=target)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, now.row(), strict=True))], schema=target)

    return marked.select("conv_id", "turn", "initial", "mark").mapInArrow(run, schema)


class _Conversation:
    """Counts of one conversation whose rows come in order."""

    def __init__(self, conv):
        self.conv, self.marks, self.before, self.illegal = conv, bytearray(), None, 0
        self.first = self.last = None
        self.different = 0
        self.counts = dict.fromkeys("bdt", 0)

    def add(self, turn, initial: str, mark: str) -> None:
        if mark == LOST:
            return
        if turn is not None and turn != self.last:
            self.first, self.last = turn if self.first is None else self.first, turn
            self.different += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        fault = mark if mark in "bd" else "t" if mark.isupper() else ""
        if fault:
            self.counts[fault] += 1
        self.marks += MUST_GO.encode() if fault in ("b", "d") else mark.encode()

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.different
        return (self.conv, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.marks.decode())


class Replay:
    """Applies an audit to rows that come in order: (edit, role, text) of each repaired row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            role, self.state = NEXT[self.state]
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            role, self.state = NEXT[self.state]
        elif edit == "K":
            self.state = KEEPS[self.state][role[:1]]
        if edit != "D":
            yield edit, role, text


def reports(rows: DataFrame) -> DataFrame:
    """``signatures`` with cost and audit."""
    found = stage(signatures(rows), "repair-signatures")
    return found.join(solve_signatures(found.select("signature")), "signature").drop("signature")


def _walk(rows: DataFrame, audits: DataFrame, schema: str, begin, emit_row, finish) -> DataFrame:
    """Streams each conversation's audit and then its rows through ``begin(report)``,
    ``emit_row(state, edit, role, text)`` and ``finish(state)``; both of the latter return output tuples."""
    ship_package(rows.sparkSession)
    report = [c for c in audits.columns if c != "conv_id"]
    head = audits.select("conv_id", F.lit(0).alias("kind"), F.struct(*report).alias("report"))
    body = rows.where("not dropped").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = head.unionByName(body, allowMissingColumns=True).repartition("conv_id")
    target = arrow_schema(schema)
    both = both.sortWithinPartitions("conv_id", "kind", *_order()).select("report", "kind", "conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out):
            return pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in out], schema=target)

        state = replay = None
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(4)):
                part, done, out = batch.slice(done, len(texts)), done + len(texts), []
                for given, kind, conv, role, text in zip(*(part.column(i).to_pylist() for i in range(4)), texts, strict=True):
                    if kind == 0:
                        if replay is not None:
                            for edit in replay.inserted():
                                out += emit_row(state, *edit)
                            out += finish(state)
                        state, replay = begin(conv, given), Replay(given["audit"])
                    else:
                        for edit in replay.row(role, text):
                            out += emit_row(state, *edit)
                yield made(out)
        if replay is not None:
            out = []
            for edit in replay.inserted():
                out += emit_row(state, *edit)
            yield made(out + list(finish(state)))

    return both.mapInArrow(run, schema)


def _bytes(text) -> bytes:
    return text if isinstance(text, bytes) else text.encode()


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place long, edit, role, text) of the repaired conversations, places from 1."""
    key = rows.schema["conv_id"].dataType.simpleString()

    def begin(conv, report):
        return [conv, 0]

    def emit_row(state, edit, role, text):
        state[1] += 1
        return [(state[0], state[1], edit, role, _bytes(text).decode())]

    return _walk(rows, audits, f"conv_id {key}, place long, edit string, role string, text string", begin, emit_row, lambda state: [])


def repair_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256 (of ``role:text``, joined by line breaks)."""
    report = [c for c in audits.columns if c != "conv_id"]
    fields = [f"{c} {audits.schema[c].dataType.simpleString()}" for c in ("conv_id", *report)]

    def begin(conv, given):
        return [hashlib.sha256(), b"", (conv, *[given[c] for c in report])]

    def emit_row(state, edit, role, text):
        state[0].update(state[1] + role.encode() + b":")
        state[0].update(_bytes(text))
        state[1] = b"\n"
        return []

    return _walk(rows, audits, ", ".join([*fields, "repaired_sha256 string"]), begin, emit_row, lambda state: [(*state[2], state[0].hexdigest())])


def q_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(read_table(spark, sf_dir, "conversations"))
    return repair_digests(rows, reports(rows)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
