import hashlib
import itertools
import random
import zlib

import pytest
from replysift.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        dealt = zlib.crc32(key.encode()) % 20
        if dealt == 0:
            continue
        text = "" if dealt == 1 else "".join(c for c in text if c not in ".!?") if dealt == 2 else text
        for _ in range(2 if dealt == 3 else 1):
            yield conv, turn, "user" if dealt == 4 else role, text


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(BLANKS)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return not initials or (len(body) > 0 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def cheapest(rows, found):
    """(cost, audit, repaired rows) by trying every sequence of edits with up to four inserts."""
    choices = [["D"] if f in ("b", "d") else ["D", "K", "R:user", "R:assistant"] for f in found]
    best = None
    for edits in itertools.product(*choices):
        for n_inserts in range(5):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n_inserts):
                for roles in itertools.product(("user", "assistant"), repeat=n_inserts):
                    out, audit, cost, put = [], "", 5 * n_inserts, list(zip(places, roles, strict=True))
                    for i in range(len(rows) + 1):
                        for place, role in put:
                            if place == i:
                                out.append((role, ""))
                                audit += "I"
                        if i < len(rows):
                            edit = edits[i]
                            audit += edit[0]
                            cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + (5 if edit != "D" and found[i] == "t" else 0)
                            if edit != "D":
                                out.append((edit[2:] or rows[i][2], rows[i][3]))
                    if legal("".join(r[:1] for r, _ in out)) and all(r for r, _ in out):
                        best = min(best, (cost, audit, out)) if best else (cost, audit, out)
    return best


def brute(rows):
    """The contract's row of each conversation."""
    by_conv = {r[0]: [] for r in rows}
    for r in hurt(rows):
        by_conv[r[0]].append(r)
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        found = faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        cost, audit, out = cheapest(mine, found)
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("b"), found.count("d"), found.count("t"),
               sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
               hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_edit_tried(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "unknown", "User"]
    texts = ["Yes.", "No!", "and then", "Why? ", "x", "", "\n \t", "été…", "End.\r\n"]
    rows = [(conv, rng.choice([None, *range(9)]) if rng.random() < 0.4 else i, rng.choices(roles, (6, 6, 2, 1, 1, 1))[0], rng.choice(texts))
            for conv in range(seed * 100, seed * 100 + 30) for i in range(rng.randint(1, 4))]
    want = sorted(map(str, brute(rows)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    damaged = tr.damage(df)
    assert rows_of(tr.repair_digests(damaged, tr.reports(damaged))) == want


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 2, "user", "Hello."), (7, 1, None, "No role."), (8, 3, "", "Empty role."), (9, 1, "user", None),
            (10, 1, "user", "Same."), (10, 1, "user", "Same."), (11, 5, "user", "word " * 200_000), (11, 9, "assistant", "x" * 300_000 + ".")]
    rows += [(12, t, r, f"{t}.") for t, r in enumerate(["system", "user", "assistant"])]
    rows += [(50 + i, 1, "user", "Gone?") for i in range(80)]  # some lose their only row
    df = spark.createDataFrame(rows, SCHEMA)
    assert any(zlib.crc32(f"{50 + i}:1".encode()) % 20 == 0 for i in range(80))
    clash = df.selectExpr("*", "'own' as dropped", "'own' as digest", "1 as kind", "2 as audit", "'own' as signature")
    damaged = tr.damage(clash)
    out = tr.repair_digests(damaged, tr.reports(damaged))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(out) == sorted(map(str, brute(rows)))
    empty = tr.damage(spark.createDataFrame([], SCHEMA))
    assert tr.repair_digests(empty, tr.reports(empty)).count() == 0


def test_repaired_rows_keep_the_grammar(spark):
    """The operator on undamaged rows: repaired turns are legal, numbered and hash to the digest."""
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = tr.turns(df)
    audits = tr.reports(rows)
    out = {}
    for r in tr.repaired_turns(rows, audits).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(r)
    for r in tr.repair_digests(rows, audits).collect():
        mine = out.get(r.conv_id, [])
        assert legal("".join(t.role[:1] for t in mine)) and [t.place for t in mine] == list(range(1, len(mine) + 1))
        assert "".join(t.edit for t in mine) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == r.repaired_sha256


def test_long_conversation_and_shared_suffixes(spark):
    """A conversation of 30,000 turns; the automaton solves few (symbol, state) pairs."""
    rng = random.Random(4)
    symbols = "".join(rng.choice("uaUAsox") for _ in range(30_000))
    names = [symbols[i:] for i in range(0, 300, 10)] + ["", "ua", "sua"]
    df = spark.createDataFrame([(s,) for s in names for _ in range(2)], "signature string")
    got = {r.signature: (r.cost, r.audit) for r in tr.solve_signatures(df).collect()}
    assert set(got) == set(names) and got["sua"] == (0, "KKK") and got[""] == (0, "")
    machine, node = tr.Automaton(), None
    for s in names:
        node, path = machine.end, [machine.end]
        for symbol in reversed(s):
            node = machine.before(symbol, node)
            path.append(node)
        assert got[s] == (node[0] + node[1][tr.START], tr.audit_of(path[::-1]))
        spent = {"K": 0, "R": 1, "D": 2, "I": 5}
        edits = [e for e in got[s][1] if e != "I"]
        stays = sum(5 for e, c in zip(edits, s, strict=True) if c.isupper() and e != "D")
        assert sum(spent[e] for e in got[s][1]) + stays == got[s][0]
    assert len(machine.made) < 500
