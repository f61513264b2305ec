"""Token ids of whole texts by a public vocabulary whose tokens never span white space.

Such a vocabulary cuts a text into runs of letters, single digits and runs of marks, and every piece on its own, so the ids of a
text are the ids of its pieces in order. Pieces repeat: a bounded memo makes a text a join of byte strings. Words with
characters outside ``PLAIN`` go through the whole tokenizer. Whole columns of texts are cut as arrays of bytes; their distinct
pieces are merged together (``Merges``), without a call for each.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

END_OF_TEXT = 49407
KNOWN = 500_000
#: Latin letters whose lower case is one letter in any implementation, digits, and marks that are neither letter nor apostrophe;
#: "<" is left out because special tokens begin with it.
UPPER, LOWER, MARKS = "A-ZÀ-ÖØ-ÞĀ-įĲ-ſ", "a-zß-öø-įĲ-ſ", r"""-.,!?;:*#$%&|()\[\]{}"/\\@+=_~^`>"""
PLAIN = f"{UPPER}{LOWER}0-9{MARKS}"
ODD = re.compile(rf"[^{PLAIN}\x20\x09-\x0D]")
PIECES = re.compile(rf"[{LOWER}]+|[0-9]|[{MARKS}]+")

SPACE, LETTER, DIGIT, MARK, WHOLE = range(5)
#: Kind and lower case of every byte; of two-byte characters by their code, as far as ``PLAIN`` goes.
KIND = np.array([
    SPACE if b in b" \t\n\v\f\r" else LETTER if 0x80 <= b < 0xC0 or 0xC3 <= b <= 0xC5
    else WHOLE if b > 0x7F or not re.match(rf"[{PLAIN}]", chr(b)) else DIGIT if chr(b).isdigit() else LETTER if chr(b).isalpha() else MARK
    for b in range(256)
], np.uint8)
LOW = np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], np.uint8)
ODD_CODES = np.array([not re.match(rf"[{PLAIN}]", chr(c)) for c in range(0x180)])
LOW_CODES = np.array([c if ODD_CODES[c] else ord(chr(c).lower()) for c in range(0x180)])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next unused one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordwiseTokens:
    """``encode(text)`` gives little-endian 16-bit ids. ``plain``: strings of special tokens in a text are ordinary text."""

    def __init__(self, vocabulary: str, plain: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.path, self.merges = vocabulary, None
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def _joined(self, pieces: list[str]) -> bytes:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        cut = self.model.tokenize
        for p in set(pieces).difference(known):
            shown = p if p.isascii() else "".join([self.letters[b] for b in p.encode("utf-8")])
            known[p] = array("H", [t.id for t in cut(shown)]).tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def _word(self, word: str) -> bytes:
        if not ODD.search(word):
            return self._joined(PIECES.findall(word.lower()))
        if word not in self.odd:
            if len(self.odd) > KNOWN:
                self.odd.clear()
            self.odd[word] = array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return self.odd[word]

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if ODD.search(text):
            ids = b"".join(self._word(w.decode("utf-8")) for w in text.encode("utf-8").split())
        else:
            ids = self._joined(PIECES.findall(text.lower()))
        return np.frombuffer(ids, "<u2")

    def _bytes(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased bytes of texts, and the kind of each byte; words with odd characters keep their case and are of kind ``WHOLE``."""
        kind, low = KIND[data], LOW[data]
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
        if len(lead):
            code = (data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63
            kind[lead[ODD_CODES[code]]] = WHOLE
            low[lead], low[lead + 1] = LOW_CODES[code] >> 6 | 0xC0, LOW_CODES[code] & 63 | 0x80
        odd = np.flatnonzero(kind == WHOLE)
        if len(odd):
            worded = kind != SPACE
            first = worded.copy()
            first[1:] &= ~worded[:-1]
            first[begins] = worded[begins]
            number = np.cumsum(first) - 1
            whole = np.zeros(number[-1] + 1, bool)
            whole[number[odd]] = True
            at = np.flatnonzero(whole[number] & worded)
            kind[at], low[at] = WHOLE, data[at]
        return low, kind

    def encode_pieces(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A column of texts, nulls empty, as pieces: ``ids`` and ``begin`` of the distinct pieces, ``codes`` of the pieces of all
        texts, and how many of these come before each text and at the end (``bounds``)."""
        import pyarrow as pa

        if self.merges is None:
            self.merges = Merges(self.path)
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        if ends[-1] == ends[0]:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]: ends[-1]], ends - ends[0]
        begins = ends[:-1][ends[:-1] < ends[1:]]
        low, kind = self._bytes(data, begins)
        first = kind == DIGIT
        first[1:] |= kind[1:] != kind[:-1]
        first[begins] = True
        worded = kind != SPACE
        last = np.append(first[1:] | ~worded[1:], True) & worded
        first &= worded
        at = np.flatnonzero(first)
        if not len(at):
            return np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - at)))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low[worded])])
        known = pieces.dictionary_encode()
        codes, distinct = known.indices.to_numpy(), known.dictionary
        ids, begin = self._distinct(distinct, np.unique(codes[kind[at] == WHOLE]))
        return ids, begin, codes, np.searchsorted(at, ends)

    def _distinct(self, pieces, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, and where each begins; ``whole``: numbers of the words that go through the tokenizer."""
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset: pieces.offset + len(pieces) + 1]
        sizes = np.diff(ends)
        alone = sizes > LONGEST
        alone[whole] = True
        found = self.merges.of(np.frombuffer(pieces.buffers()[2], np.uint8), ends[:-1], np.where(alone, 0, sizes))
        odd = set(whole.tolist())
        for i in np.flatnonzero(alone).tolist():
            piece = pieces[i].as_py().decode("utf-8")
            ids = np.frombuffer(self._word(piece) if i in odd else self._joined([piece]), "<u2")
            found.append((np.array([i]), ids[:, None]))
        counts = np.zeros(len(pieces), np.int64)
        for at, ids in found:
            counts[at] = len(ids)
        begin = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(begin[-1], np.uint16)
        for at, ids in found:
            flat[begin[at] + np.arange(len(ids))[:, None]] = ids
        return flat, begin


@functools.lru_cache(maxsize=2)
def tokens_of(vocabulary: str, plain: bool) -> WordwiseTokens:
    """A worker reads the vocabulary once for all its tasks; its memos are bounded."""
    return WordwiseTokens(vocabulary, plain)


#: Longest piece, in bytes, that is merged together with others; longer ones go one by one.
LONGEST = 32
NO_RANK = 1 << 20


class Merges:
    """The merges of a byte-level vocabulary, applied to many pieces at once.

    Pieces of equal length are merged together. A round does one merge in each, the first of those of lowest rank, which is the order
    of the tokenizer, so pieces that still change stay equally long.
    """

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)["model"]
        number, suffix = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([number[c] for c in byte_letters()], np.uint32)
        self.last = np.array([number[c + suffix] for c in byte_letters()], np.uint32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([number[a + b] for a, b in pairs], np.uint32)
        keys = np.array([number[a] << 16 | number[b] for a, b in pairs], np.uint32)
        self.bits = max(1, len(keys)).bit_length() + 2
        self.keys, self.ranks = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, NO_RANK, np.int32)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):  # each free slot takes one of those that ask for it, the others try the next slot
            slot = slots[left]
            free = self.ranks[slot] == NO_RANK
            taken, who = np.unique(slot[free], return_index=True)
            who = left[free][who]
            self.keys[taken], self.ranks[taken] = keys[who], who
            left = np.setdiff1d(left, who)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NO_RANK`` without one."""
        shape, keys = a.shape, (a << np.uint32(16) | b).ravel()
        slots = self._slots(keys)
        out = self.ranks[slots]
        left = np.flatnonzero((self.keys[slots] != keys) & (out != NO_RANK))
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            out[left] = self.ranks[slots]
            more = (self.keys[slots] != keys[left]) & (out[left] != NO_RANK)
            left, slots = left[more], slots[more]
        return out.reshape(shape)

    def of(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of pieces, their ids, a column for each); pieces of size 0 are left out."""
        done = []
        for size in np.flatnonzero(np.bincount(sizes, minlength=1)).tolist():
            if not size:
                continue
            at = np.flatnonzero(sizes == size)
            letters = data[begins[at] + np.arange(size)[:, None]]
            ids = self.inner[letters]
            ids[-1] = self.last[letters[-1]]
            ranks = self.rank(ids[:-1], ids[1:])
            while len(at):
                places = np.arange(len(ranks), dtype=np.int32)[:, None]
                best = (ranks << 5 | places).min(axis=0, initial=NO_RANK << 5)
                live = best < NO_RANK << 5
                if not live.all():
                    done.append((at[~live], ids[:, ~live]))
                    at, ids, ranks, best = at[live], ids[:, live], ranks[:, live], best[live]
                if not len(at):
                    break
                place, column = best & 31, np.arange(len(at))
                ids = np.where(places > place, ids[1:], ids[:-1])
                ids[place, column] = self.made[best >> 5]
                ranks = np.where(places[:-1] >= place, ranks[1:], ranks[:-1])
                before, after = np.flatnonzero(place > 0), np.flatnonzero(place < len(ids) - 1)
                p = place[before]
                ranks[p - 1, before] = self.rank(ids[p - 1, before], ids[p, before])
                p = place[after]
                ranks[p, after] = self.rank(ids[p, after], ids[p + 1, after])
        return done


def gathered(flat: np.ndarray, begin: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``codes`` of ``flat`` one after the other, and where each begins there, its end included."""
    sizes = np.diff(begin)
    if (sizes == 1).all():
        return flat[codes], np.arange(len(codes) + 1)
    sizes = sizes[codes]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(begin[codes] - starts[:-1], sizes) + np.arange(starts[-1])], starts
