"""Toxicity (1): a lexicon trie crossed with Levenshtein automata, scored by context.

Learning. From at most ``max_rows`` labelled documents (least hashes of the ids, the
bound is a parameter; documents that share four least word hashes, so near copies,
count once) every word and word beginning is counted in toxic and in clean
documents. Terms that are much likelier in toxic ones form the lexicon: whole words,
and stems where many words with one beginning behave alike. A term's weight is its
smoothed log odds. The lexicon holds ``max_terms`` terms at most (the model's size, a parameter).

Matching. The terms stand in a trie. Running the Levenshtein automata of all terms
over it side by side gives one automaton; its states (trie nodes with the edits spent)
are made when a word first needs them, so each character of a word costs one lookup
and most words end in the dead state after a few. Long terms may differ by one or two
edits, in the first letter as in any other; whole words below five letters and stems
below seven must fit. Digits and signs that stand for letters are read as these; signs
before or behind a word are read both ways, as letters and as signs.

Scoring. Each hit is weighed by its window: between quotation marks or after words of
reporting it counts little, beside a word of address it counts more. What a misspelled
hit is worth is learned too: the share of clean documents that hold one counts against
it. The score is the logistic of the prior plus the weights of the distinct terms, each next
one counting 0.7 times the one before. A text is read twice from front to back, whatever its lines.

Only the text is an input of a score. Defined cases: a null or empty text scores like
any text without a hit; without usable labels, or without toxic ones among them, every
document gets the prior; a document with several labels counts as toxic if one says
so; repeated rows score alike; a document without an id is never learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, map_texts, quoted, ship_package, stage, text_slices

MAX_ROWS, MAX_TERMS = 20_000, 2_000
LEAST_ODDS, SUPPORT, SUPPORT_SHARE = 3.0, 4, 0.004
STEM_CHARS, LONGEST_PREFIX = 4, 12
QUOTED, ADDRESSED, EDIT_FACTOR = 0.25, 1.25, 0.6
WINDOW_CHARS, WINDOW_WORDS = 80, 4
TOKEN = re.compile(r"[^\W_](?:[\w@$!*'’]*[^\W_])?")
SIGNS = "@$!"
SIGNED = re.compile(rf"(?:(?<![{SIGNS}])[{SIGNS}]++)?+{TOKEN.pattern}[{SIGNS}]*+")  # a token with the signs around it
MOST_HELD, MOST_WORDS, LONGEST_KEPT = 1_000_000, 100_000, 64  # bounds of what a task remembers
STANDS_FOR = str.maketrans("013457@$!", "oieastasi")
OPEN_QUOTES, CLOSE_QUOTES = "\"“„«‹‘", "\"”“»›’"
REPORTING = frozenset("word words term called said says wrote quote quoted quoting insult insults phrase reported".split())
ADDRESS = frozenset("you your you're youre u are".split())


def folded(token: str) -> str:
    """Signs and digits inside a word with letters read as the letters they stand for."""
    if token.isalpha() or not any(c.isalpha() for c in token):
        return token
    return token.translate(STANDS_FOR).replace("'", "").replace("’", "").replace("*", "")


def allowed_edits(size: int, stem: bool) -> int:
    if stem:
        return 0 if size < 7 else 1
    return 0 if size < 5 else 1 if size < 8 else 2


class Automaton:
    """All terms' Levenshtein automata, run over the trie of the terms. With ``any_first``
    the first letter may be an edit like any other, else it must fit."""

    def __init__(self, terms: list[tuple[str, bool]], any_first: bool = False):
        self.terms, self.any_first = terms, any_first
        self.longest = max((len(t) for t, _ in terms), default=0) + 2  # no text longer than this is a whole word
        self.children: list[dict[str, int]] = [{}]
        self.word_end: dict[int, int] = {}
        self.stem_end: dict[int, int] = {}
        self.room = [0]  # most edits that a term below the node allows
        self.edits = [allowed_edits(len(t), s) for t, s in terms]
        self.room[0] = max(self.edits, default=0)
        for i, (text, stem) in enumerate(terms):
            node = 0
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], self.edits[i])
            (self.stem_end if stem else self.word_end)[node] = i
        self._begin()

    def _begin(self) -> None:
        """No state but the dead one and those of the start."""
        self.number: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.next: list[dict[str, int]] = [{}]
        self.accept: list = [None]
        self.held = 0  # entries of all states, and four for each
        if self.any_first:
            self.start = self._state({0: 0})
        else:
            self.start = 1  # a state with the steps given here and no others
            self.states.append(())
            self.next.append({})
            self.accept.append(None)
            self.next[1] = {c: self._state({n: 0}) for c, n in self.children[0].items()}

    def _state(self, found: dict) -> int:
        """The state with these nodes, after the moves that spend an edit on a letter left out."""
        todo = list(found)
        while todo:
            node = todo.pop()
            if node < 0:
                continue
            spent = found[node]
            if node in self.stem_end and spent <= self.edits[self.stem_end[node]]:
                done = -1 - self.stem_end[node]
                found[done] = min(spent, found.get(done, 9))
            for child in self.children[node].values():
                if spent + 1 <= self.room[child] and spent + 1 < found.get(child, 9):
                    found[child] = spent + 1
                    todo.append(child)
        key = tuple(sorted(found.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.held += len(key) + 4
            self.next.append({})
            hits = [(e, -1 - n) for n, e in key if n < 0]
            hits += [(e, self.word_end[n]) for n, e in key if n in self.word_end and e <= self.edits[self.word_end[n]]]
            self.accept.append(min(hits) if hits else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        found: dict[int, int] = {}

        def put(node, spent):
            if spent < found.get(node, 9):
                found[node] = spent

        for node, spent in self.states[state]:
            if node < 0:  # a stem is complete: the rest of the word is free
                put(node, spent)
                continue
            for letter, child in self.children[node].items():
                cost = spent + (letter != c)
                if cost <= self.room[child]:
                    put(child, cost)
            if spent + 1 <= self.room[node]:
                put(node, spent + 1)  # a letter too many
        to = self._state(found) if found else 0
        self.next[state][c] = to
        return to

    def match(self, word: str, free: int = 0) -> tuple[int, int] | None:
        """(edits, term) of the nearest term; None if there is none near enough. The last
        ``free`` characters may be part of the word or not."""
        if self.held > MOST_HELD:
            self._begin()
        state, best, must = self.start, None, len(word) - free
        for i, c in enumerate(word):
            if not state:
                return best
            if free and i >= must:
                best = min(filter(None, (best, self.accept[state])), default=None)
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
        return min(filter(None, (best, self.accept[state])), default=None)


class Model:
    """Lexicon, weights and prior; what every task gets (``max_terms`` of the fit at most)."""

    def __init__(self, terms: list[tuple[str, bool]], weights: list[float], prior: float, misspelled: float = EDIT_FACTOR):
        self.terms, self.weights, self.prior, self.misspelled = terms, weights, prior, misspelled

    def setup(self):
        """Called once in each task."""
        return Scorer(self)


class Quotes:
    """Tells whether a hit stands between quotation marks. Hits come in text order, so marks
    are counted once along each line, however long it is and however many hits it holds."""

    def __init__(self, text: str):
        self.text, self.at, self.odd = text, 0, False

    def _odd_before(self, start: int) -> bool:
        """An odd number of plain marks on the line before ``start``."""
        line = self.text.rfind("\n", self.at, start) + 1
        if line:  # a new line has begun since the last hit
            self.at, self.odd = line, False
        self.odd ^= self.text.count('"', self.at, start) % 2 == 1
        self.at = start
        return self.odd

    def around(self, start: int, end: int) -> bool:
        """Between an opening and a closing quotation mark on the same line, not far away."""
        odd = self._odd_before(start)
        before = self.text[max(0, start - WINDOW_CHARS):start].rsplit("\n", 1)[-1]
        after = self.text[end:end + WINDOW_CHARS].split("\n", 1)[0]
        opened = max((before.rfind(q) for q in OPEN_QUOTES), default=-1)
        if opened < 0 or not any(q in after for q in CLOSE_QUOTES):
            return False
        if before[opened] == '"':  # the same mark opens and closes: an odd number since the line began
            return odd
        return not any(q in before[opened + 1:] for q in CLOSE_QUOTES if q != before[opened])


def is_quoted(text: str, start: int, end: int) -> bool:
    return Quotes(text).around(start, end)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms, any_first=True)
        self.seen: dict[str, tuple[int, int] | None] = {}

    def nearest(self, token: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, over all readings of the signs around the token."""
        if token in self.seen:
            return self.seen[token]
        core = token.strip(SIGNS)
        lead, tail = token[:token.index(core)], token[token.index(core) + len(core):]
        match = self.automaton.match
        best = match(folded(core))
        if (lead or tail) and any(c.isalpha() for c in core):
            # more signs before the word than any term has letters can't be its letters
            word, after = folded(core), tail.translate(STANDS_FOR)
            starts = [lead[i:].translate(STANDS_FOR) for i in range(max(0, len(lead) - self.automaton.longest), len(lead) + 1)]
            found = [match(start + word + after, len(after)) for start in starts]
            best = min(filter(None, [best, *found]), default=None)
        if len(token) <= LONGEST_KEPT:
            if len(self.seen) >= MOST_WORDS:
                self.seen.clear()
            self.seen[token] = best
        return best

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(term, edits, factor of the context) of every hit, in text order."""
        low = text.lower()
        if len(low) != len(text):  # a few characters grow in lower case; keep positions together
            text = low
        if not self.model.terms:
            return []
        found = {t: m for t in {m[0] for m in SIGNED.finditer(low)} if (m := self.nearest(t))}
        if not found:
            return []
        out, quotes, near = [], Quotes(text), deque(maxlen=WINDOW_WORDS)  # the words before
        for m in SIGNED.finditer(low):
            if m[0] in found:
                edits, term = found[m[0]]
                words = [w.strip(SIGNS) for w in near]
                factor = QUOTED if quotes.around(m.start(), m.end()) or REPORTING.intersection(words) else 1.0
                if factor == 1.0 and ADDRESS.intersection(words[-2:]):
                    factor = ADDRESSED
                out.append((term, edits, factor))
            near.append(m[0])
        return out

    def margin(self, text: str) -> float:
        best: dict[int, float] = {}
        for term, edits, factor in self.hits(text):
            value = self.model.weights[term] * factor * (self.model.misspelled ** edits)
            best[term] = max(best.get(term, 0.0), value)
        return self.model.prior + sum(v * 0.7 ** i for i, v in enumerate(sorted(best.values(), reverse=True)))

    def __call__(self, texts):
        return [pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(t.decode()))))) for t in texts], pa.float64())]


def words_of(text: str) -> set[str]:
    return {folded(t) for t in TOKEN.findall(text.lower())}


class _Group:
    """Least hashes of the longer words in four orders, together: the same for most near
    copies, hardly ever for others. Without longer words, a hash of all words."""

    ORDERS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def key(self, text: bytes) -> int:
        words = set(text.lower().split())
        longer = [xxhash.xxh3_64_intdigest(w) for w in words if len(w) > 4]
        if not longer:
            return xxhash.xxh3_64_intdigest(b" ".join(sorted(words)))
        least = [(np.array(longer, np.uint64) * order).min() for order in self.ORDERS]
        return xxhash.xxh3_64_intdigest(np.array(least, np.uint64).tobytes())

    def __call__(self, texts):
        return [pa.array([self.key(t) - (1 << 63) for t in texts], pa.int64())]


def count_terms(known: DataFrame) -> DataFrame:
    """(term, n1, n0): toxic and clean documents with each word ("word ") or beginning."""
    def run(batches):
        for batch in batches:
            labels, done = batch.column(1).to_pylist(), 0
            for texts in text_slices(batch.column(0)):
                counts = (Counter(), Counter())
                for text, y in zip(texts, labels[done:done + len(texts)], strict=True):
                    terms = set()
                    for w in words_of(text.decode()):
                        if len(w) > 2 and not w.isdigit():
                            terms.add(w + " ")
                            terms.update(w[:n] for n in range(STEM_CHARS, min(len(w), LONGEST_PREFIX) + 1))
                    counts[y].update(terms)
                done += len(texts)
                # rare terms of clean texts only can't become lexicon terms, but their absence must be certain: all are given
                names = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()),
                                                  pa.array([counts[0][x] for x in names], pa.int64())], ["term", "n1", "n0"])

    ship_package(known.sparkSession)
    return known.select("__text", "y").mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def choose_terms(counts: list[tuple[str, int, int]], n1: int, n0: int, max_terms: int = MAX_TERMS) -> list[tuple[str, bool, float]]:
    """(text, is a stem, weight) of the lexicon, the best ``max_terms``. A beginning gives way to the longer one, or
    the whole word, that holds nearly all of its toxic documents; of nested terms the
    shortest stays."""
    odds = {t: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) for t, a, b in counts}
    support = {t: a for t, a, _ in counts}
    follow: dict[str, int] = {}
    for t, a in support.items():
        follow[t[:-1]] = max(follow.get(t[:-1], 0), a)
    good = {t for t in support if odds[t] >= LEAST_ODDS and (t[-1] == " " or follow.get(t, 0) < 0.9 * support[t])}
    out = []
    for t in sorted(good, key=lambda t: (-odds[t] * math.log1p(support[t]), t)):
        whole = t[-1] == " "
        if not any(t[:n] in good for n in range(STEM_CHARS, len(t))):
            out.append((t.rstrip(), not whole, odds[t]))
    return out[:max_terms]


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable, label_col: str = "toxic", id_col: str = "doc_id",
                 text_col: str = "text", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """The model of the usable labels. ``max_rows`` bounds the labelled documents learned from; ``max_terms`` the
    lexicon, that is the model's size: of more candidates the best stay, chosen from the
    ``50 * max_terms`` found in most toxic documents (what reaches the driver)."""
    one = labels.where(quoted(label_col).isNotNull() & usable).groupBy(quoted(id_col).alias("__id")).agg(F.max(quoted(label_col)).cast("int").alias("y"))
    chosen = F.broadcast(one.orderBy(F.xxhash64("__id"), "__id").limit(max_rows))  # max_rows narrow rows
    known = docs.select(quoted(id_col).alias("__id"), quoted(text_col).cast("string").alias("__text")).join(chosen, "__id")
    known = map_texts(known, "g long", _Group(), "__text")
    known = known.groupBy("g", "y").agg(F.min_by("__text", F.struct("__id", "__text")).alias("__text"))
    known = stage(known, "toxicity-sample")  # max_rows texts at most
    size = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    n1, n0 = size.get(1, 0), size.get(0, 0)
    prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 or n0 else 0.0
    if not n1 or not n0:
        return Model([], [], prior)
    support = max(SUPPORT, math.ceil(SUPPORT_SHARE * n1))
    lift = math.exp(LEAST_ODDS) * (n1 + 1) / (n0 + 1)
    counts = count_terms(known).where((F.col("n1") >= support) & (F.col("n1") + 0.5 >= lift * (F.col("n0") + 0.5)))
    rows = counts.orderBy(F.desc("n1"), "term").limit(50 * max_terms).collect()  # bounded; the best supported terms
    lexicon = choose_terms([(r["term"], r["n1"], r["n0"]) for r in rows], n1, n0, max_terms)
    # texts without any hit: how much their share speaks against toxicity
    model = Model([(t, s) for t, s, _ in lexicon], [w for _, _, w in lexicon], prior)
    seen = map_texts(known, "exact boolean, near boolean", _Evidence(model), "__text").groupBy("y", "exact", "near").count().collect()  # eight rows at most
    model.prior, model.misspelled = _settle(model, seen, n1, n0)
    return model


class _Evidence:
    def __init__(self, model):
        self.model = model

    def setup(self):
        score = Scorer(self.model)

        def work(texts):
            hits = [score.hits(t.decode()) for t in texts]
            return [pa.array([any(not e for _, e, _ in h) for h in hits], pa.bool_()), pa.array([any(e for _, e, _ in h) for h in hits], pa.bool_())]

        return work


def _settle(model: Model, seen, n1: int, n0: int) -> tuple[float, float]:
    """Log odds of a text without hits, and the factor of a misspelled hit: its own
    smoothed log odds among texts without an exact hit, in units of a usual term's
    weight, between 0 and ``EDIT_FACTOR``."""
    count = Counter()
    for r in seen:
        count[r["y"], r["exact"], r["near"]] += r["count"]
    none = math.log((count[1, False, False] + 0.5) / (count[0, False, False] + 0.5))
    usual = float(np.median(model.weights)) if model.weights else 1.0
    rate1 = (count[1, False, True] + 1.0) / (n1 + 2)
    rate0 = (count[0, False, True] + 0.25) / (n0 + 2)
    factor = math.log(rate1 / rate0) / usual
    return min(none, 0.0), max(0.0, min(EDIT_FACTOR, factor))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 (higher: more toxic); no shuffle."""
    return map_texts(docs, f"`{score_col}` double", model, text_col)


def usable_fold():
    """Rows of ``labels`` that may be learned from: crc32 of the id mod 3 is not 1."""
    return F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1)


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels, usable_fold()))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
