import random

from odd import ROWS, no_documents, odd_documents
from pyspark.sql import functions as F
from replysift.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    terms = [("worthless", False), ("loser", False), ("scum", False), ("loses", False), ("trashbag", False), ("vequ", True), ("lostras", True)]
    auto = tx.Automaton(terms)

    def brute(word):
        best = None
        for i, (t, stem) in enumerate(terms):
            if word[:1] != t[0]:
                continue
            # the first letter has to fit; edits are in the rest
            ends = [word[1:n] for n in range(1, len(word) + 1)] if stem else [word[1:]]
            d = min(distance(e, t[1:]) for e in ends)
            if d <= tx.allowed_edits(len(t), stem) and (best is None or (d, i) < best):
                best = (d, i)
        return best

    words = {t for t, _ in terms} | {"", "l", "loooser", "vequaire", "lostrasung", "lostrung", "vequ", "veq"}
    for _ in range(3000):
        w = list(rng.choice(terms)[0] + rng.choice(["", "", "er", "s"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.choice([0, 1])] = rng.choice([[], ["a"], ["s"], ["e"]])
        words.add("".join(w))
    assert {w: auto.match(w) for w in words} == {w: brute(w) for w in words}
    assert sum(auto.match(w) is not None for w in words) > 200


def model():
    return tx.Model([("worthless", False), ("idiot", False)], [5.0, 6.0], -4.0)


def test_context_and_misspelling():
    score = tx.Scorer(model())
    plain, quoted = score.margin("What an idiot he is."), score.margin('He wrote "What an idiot" on the wall.')
    assert plain > 1 > quoted
    assert score.margin("The word idiot is old.") == quoted
    assert score.margin("you are an idiot") == score.margin("you idiot") > plain
    assert score.margin("you see there was an idiot") == plain  # too far for the address
    assert plain > score.margin("such a wortlhess thing") > score.margin("nothing") == -4.0
    assert score.margin("1d10t") == plain and score.margin("") == -4.0
    assert score.hits("“idiot”")[0][2] == tx.QUOTED and score.hits('" x\nidiot "')[0][2] == 1.0
    assert score.margin("İdiot idiot") > 1  # a letter that grows in lower case


def test_lexicon_prefers_words_and_stems():
    counts = [("lose", 40, 0), ("loser", 40, 0), ("loser ", 40, 0), ("vequ", 30, 0), ("vequa", 10, 0), ("vequa ", 9, 0), ("vequi ", 8, 0), ("other ", 5, 50)]
    got = {(t, s) for t, s, _ in tx.choose_terms(counts, 100, 1000)}
    assert got == {("loser", False), ("vequ", True)}


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = tx.q_toxicity(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows["predicted"][rows["toxic"] == 1]).mean() > 0.6 and (rows["predicted"][rows["toxic"] == 0]).mean() < 0.03
    assert rows["score"][rows["toxic"] == 1].mean() > rows["score"][rows["toxic"] == 0].mean() + 0.4


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = tx.fold_of(F.col("doc_id"), 3) == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.fit_toxicity(docs, x, tx.usable_fold()) for x in (labels, turned))
    assert (a.terms, a.weights, a.prior, a.misspelled) == (b.terms, b.weights, b.prior, b.misspelled)


def test_odd_documents(spark):
    docs = odd_documents(spark, ("score", "g", "y"))
    labels = spark.createDataFrame([(5, 0, 1), (5, 0, 0), (9, 1, 0), (11, 0, 0), (None, 1, 1), (15, 1, None)], "doc_id long, quality int, toxic int")
    out = tx.score_toxicity(docs, tx.fit_toxicity(docs, labels, F.col("doc_id").isNotNull())).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    empty = tx.fit_toxicity(no_documents(spark), labels, F.lit(True))
    assert empty.terms == [] and {round(r.score, 9) for r in tx.score_toxicity(docs, empty).collect()} == {0.5}
    assert tx.score_toxicity(no_documents(spark), empty).count() == 0


def test_edits_and_signs_at_the_first_letter():
    rng = random.Random(8)
    terms = [("worthless", False), ("loser", False), ("scum", False), ("stupid", False), ("asshole", False), ("lostras", True), ("vequent", True)]
    auto = tx.Automaton(terms, any_first=True)

    def brute(word):
        near = [(min(distance(word[:n], t) for n in range(len(word) + 1)) if s else distance(word, t), i) for i, (t, s) in enumerate(terms)]
        return min(((d, i) for d, i in near if d <= tx.allowed_edits(len(terms[i][0]), terms[i][1])), default=None)

    words = {t for t, _ in terms} | {"", "l", "ztupid", "tupid", "tsupid", "xstupid", "orthless", "rthless", "ostrasung", "xlostrasung"}
    for _ in range(3000):
        w = list(rng.choice(terms)[0] + rng.choice(["", "", "er", "s"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.choice([0, 0, 1, rng.randrange(len(w) + 1)])
            w[at:at + rng.choice([0, 1])] = rng.choice([[], ["a"], ["s"], ["e"]])
        words.add("".join(w))
    want = {w: brute(w) for w in words}
    assert {w: auto.match(w) for w in words} == want and want["ztupid"] == (1, 3)
    for w in sorted(words)[:300]:  # the states are made anew, the answers stay
        auto.held = tx.MOST_HELD + 1
        assert auto.match(w) == want[w]

    score = tx.Scorer(tx.Model([(t, s) for t, s in terms], [5.0] * len(terms), -4.0))
    for text, hit in (("$tupid", (3, 0)), ("a ztupid one", (3, 1)), ("@sshole!!", (4, 0)), ("$cum", (2, 0)), ("stupid!!!", (3, 0)),
                      ("!!!stupid", (3, 0)), ("loser$", (1, 0)), ("“@sshole”", (4, 0))):
        assert [h[:2] for h in score.hits(text)] == [hit], text
    assert score.hits("$5 @455 !!! cum " + "$" * 50_000 + " tupidity@") == [] and score.hits("you !!$tupid")[0][2] == tx.ADDRESSED


def test_only_near_copies_count_once():
    rng = random.Random(3)
    words = [f"word{i:04d}" for i in range(2000)]
    least = min(words, key=lambda w: tx.xxhash.xxh3_64_intdigest(w.encode()))
    unlike = [" ".join([least, *rng.sample(words, 40)]).encode() for _ in range(300)]
    key = tx._Group()([*unlike, b"a b c", b"d e f", b"b c a c", b"", unlike[0].upper()])[0].to_pylist()
    assert len(set(key[:300])) > 290 and len({key[300], key[301], key[303]}) == 3
    assert key[302] == key[300] and key[304] == key[0]
    long = [" ".join(rng.sample(words, 400)) for _ in range(100)]
    near = tx._Group()([t.encode() for x in long for t in (x, x + " added")])[0].to_pylist()
    assert sum(near[2 * i] == near[2 * i + 1] for i in range(100)) > 90


def test_one_long_line_is_read_in_linear_time():
    """5 MB on one line with 100,000 quoted hits; quotes count from the line's start."""
    import time

    model = tx.Model([("stupid", False)], [4.0], -2.0)
    score = tx.Scorer(model)
    text = 'he put it so: "stupid" and left it there then went a way on. ' * 84_000
    assert len(text) > 5_000_000
    start = time.monotonic()
    hits = score.hits(text)
    assert time.monotonic() - start < 10
    assert len(hits) == 84_000 and {h[2] for h in hits} == {tx.QUOTED}


def test_quote_marks_along_lines():
    """Hits in text order give what each gives by itself."""
    text = 'a "stupid b" stupid "c\nstupid" and „stupid“ x "y" stupid\n"stupid" “stupid” "stupid'
    quotes, found = tx.Quotes(text), []
    at = text.find("stupid")
    while at >= 0:
        alone = text[:at].rsplit("\n", 1)[-1].count('"') % 2 == 1
        got = quotes.around(at, at + 6)
        assert got == tx.is_quoted(text, at, at + 6)
        found.append((alone, got))
        at = text.find("stupid", at + 1)
    assert [g for _, g in found] == [True, False, False, True, False, True, True, False]


def test_long_words_are_terms_of_their_own():
    head = "x" * 45
    rows = [(f"{head}bad ", 30, 0), (f"{head}good ", 0, 30)]
    (text, stem, _), = tx.choose_terms(rows, 30, 30)
    assert text == head + "bad" and not stem
    assert len(tx.choose_terms([(f"w{i} ", 30, 0) for i in range(9)], 30, 30, max_terms=4)) == 4
