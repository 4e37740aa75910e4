"""Encoding whole texts through the tokenizers library, one distinct piece at a time.

The encoders cut a text only where no token can cross, so the ids of the pieces in
order are the ids of the whole text. Arrow splits a slice of texts and numbers its
distinct pieces; each is encoded once, in batches (the library uses its own threads
if it may), and numpy lays the ids out in text order. Pieces that occur again are
remembered in a store of bounded size, one for each Python worker.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered in a worker; more are encoded where they occur.
REMEMBERED = 250_000
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WHITE = r"[\t-\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Two white characters in a row, or one at either end: such a text isn't cut at every space.
_ODD = rf"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$"
_MARKS = ".,;:!?"


class PieceEncoder:
    """Ids of texts as packed little-endian integers of ``width`` bytes.

    A text is cut before each single space between two other characters. Split
    patterns that put such a space at the start of a token make that a token boundary.
    Longer runs of white space stay inside one piece. A piece is known by what follows
    its space; the first one of a text by a 1-tuple. ``whole`` lists strings (special
    tokens): a text that holds one isn't cut."""

    def __init__(self, tokenizer, width: int, whole: list[str] = ()):
        self.tokenizer, self.width, self.whole = tokenizer, width, list(whole)
        self.kind = np.dtype(f"<u{width}")
        self.code = {2: "H", 4: "I"}[width]
        self.store: dict = {}

    def spell(self, piece) -> str:
        return piece[0] if type(piece) is tuple else " " + piece

    def encode_each(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() if len(e) > 64 else array(self.code, e.ids).tobytes() for e in done]

    def learn(self, missing: list) -> None:
        """Puts the ids of these pieces into the store."""
        for at in range(0, len(missing), 20_000):
            part = missing[at:at + 20_000]
            self.store.update(zip(part, self.encode_each([self.spell(p) for p in part]), strict=True))

    def _pieces(self, texts: pa.Array):
        """Offsets of the texts' pieces and all pieces in order (large_string)."""
        odd = pc.match_substring_regex(texts, _ODD)
        if not pc.any(odd).as_py():
            cut = pc.split_pattern(texts, " ")
            return cut.offsets.to_numpy(), cut.values
        lists = [_INNER_SPACE.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
        cut = pa.array(lists, pa.large_list(pa.large_string()))
        return cut.offsets.to_numpy(), cut.values

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """``texts``: strings without nulls."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return []
        if self.whole:
            uncut = pc.match_substring(texts, self.whole[0])
            for s in self.whole[1:]:
                uncut = pc.or_(uncut, pc.match_substring(texts, s))
            if pc.any(uncut).as_py():
                return [self.encode_each([t])[0] if u else self(pa.array([t], pa.large_string()))[0]
                        for t, u in zip(texts.to_pylist(), uncut.to_pylist(), strict=True)]
        offsets, pieces = self._pieces(texts)
        offsets = offsets - offsets[0]
        coded = pieces.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = offsets[:-1]
        known = coded.dictionary.to_pylist()
        lead = [(known[number[i]],) for i in firsts]
        number[firsts] = len(known) + np.arange(len(firsts))
        times = np.bincount(number, minlength=len(known) + len(lead))
        known += lead
        used = [known[i] for i in np.flatnonzero(times)]  # a piece that only begins texts isn't used without its tuple

        store = self.store
        missing = list(dict.fromkeys(p for p in used if p not in store))
        if len(store) >= REMEMBERED and len(missing) > 0.8 * len(used):  # other texts than it was filled with
            store.clear()
            missing = list(dict.fromkeys(used))
        self.learn(missing)
        packed = [store[p] if n else b"" for p, n in zip(known, times.tolist(), strict=True)]
        once = {known[i] for i in np.flatnonzero(times == 1)}
        for p in missing:
            if p in once or type(p) is tuple or len(store) > REMEMBERED:
                del store[p]

        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        values = np.frombuffer(b"".join(packed), self.kind)
        start = np.cumsum(size) - size
        count = size[number]
        ends = np.cumsum(count)
        out = values[np.repeat(start[number] - (ends - count), count) + np.arange(ends[-1])]
        stops = ends[offsets[1:] - 1]
        begins = np.concatenate(([0], stops[:-1]))
        return [out[a:b].tobytes() for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it is
    printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteLevelEncoder(PieceEncoder):
    """For byte-level BPE. A piece of letters only, after its space, is one word of the
    split pattern, so the library's model takes it directly, written in byte letters.
    End marks after letters are a word of their own."""

    def __init__(self, tokenizer, width: int, whole: list[str] = ()):
        super().__init__(tokenizer, width, whole)
        self.letters = _byte_letters()
        self.model = tokenizer.model

    def encode_word(self, word: str) -> bytes:
        word = " " + word
        if word.isascii():
            word = self.letters[32] + word[1:]
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def learn(self, missing: list) -> None:
        store, stems, marked, rest = self.store, {}, [], []
        for p in missing:
            stem = p.rstrip(_MARKS) if type(p) is str else ""
            if not stem.isalpha():  # letters as in the pattern
                rest.append(p)
                continue
            if stem not in store:
                stems[stem] = None
            if stem != p:
                marked.append((p, stem, (p[len(stem):],)))
        rest += {m for _, _, m in marked if m not in store}
        super().learn(rest)
        store.update(zip(stems, map(self.encode_word, stems), strict=True))
        for p, stem, mark in marked:
            store[p] = store[stem] + store[mark]
        wanted = set(missing)
        for stem in stems:
            if stem not in wanted:
                del store[stem]


__all__ = ["REMEMBERED", "ByteLevelEncoder", "PieceEncoder"]
