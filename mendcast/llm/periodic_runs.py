"""Periodic runs of words, found online by a sparse dynamic program over diagonals.

A lag is a diagonal of the table of a text's words against themselves; its match length at a word counts the words up to there that
equal the word ``lag`` places earlier. A word's earlier occurrences increment the lengths of their lags; a lag that a word does not
increment ends, and if it was long enough the run is emitted at once: start, length, smallest period.

All earlier occurrences of a frequent word would be a number of pairs that grows with the square of the text. The table is kept sparse
without losing a run. A run of period q has at least 4 q words, so its lag matches 3 q words in a row. Lags are split into bands
``lo..hi`` with a context of ``s = 2 hi <= 3 lo`` words: an earlier occurrence counts once the ``s`` words that begin here equal
those that begin there, and only the nearest occurrence counts. Inside a run of smallest period q that is always the one at lag q: one
at a smaller lag would give the ``s >= 2 q`` words both periods, hence (Fine and Wilf) their greatest common divisor, and q would not be
smallest. So each word has at most one active lag per band, there are O(log n) bands, and contexts are compared by exact ranks:
a context is the pair of ranks of two overlapping contexts of half its length. Words whose context does not occur twice drop out.

Defined results: a null or empty text, or one without words, has no runs and collapses to the empty text; every row is judged
by itself, so ties and repeated rows need no rule; texts are read whole, in one row of one task; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mendcast.llm.common import map_batches, utf8

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Texts of one Arrow batch are searched together up to so many bytes; a longer text alone.
TOGETHER = 1 << 23


def bands(longest: int):
    """(lo, hi, context) of the lags that a text of ``longest`` words can have, from 2."""
    lo = 2
    while 4 * lo <= longest:
        hi = 3 * lo // 2
        yield lo, hi, 2 * hi
        lo = hi + 1


def stretches(at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word and lag of every sequence of neighbouring words that increment the same lag."""
    if not len(at):
        return at, at, lag
    ends = np.flatnonzero((at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]))
    first = np.concatenate(([0], ends + 1))
    return at[first], at[np.concatenate((ends, [len(at) - 1]))], lag[first]


class Ranks:
    """Exact ranks of contexts of 2^k words; -1 where a context leaves its text or occurs only once in it."""

    def __init__(self, words: np.ndarray, text: np.ndarray, end: np.ndarray):
        size = int(words.max()) + 1
        self.text, self.end, self.width = text, end, 1
        at = np.arange(len(words))
        self.rank, self.n = np.full(len(words), -1, np.int64), 0
        self._rank(at, text * size + words)

    def _rank(self, at: np.ndarray, key: np.ndarray):
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        change = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, bool)
        group = np.cumsum(change) - 1
        twice = np.bincount(group)[group] > 1 if len(key) else change
        self.rank = np.full(len(self.end), -1, np.int64)
        self.rank[at[order[twice]]] = group[twice]
        self.n = int(group[-1]) + 1 if len(key) else 0

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words with a context of ``width`` (from this one's to twice this one's) that may occur twice, and its exact key."""
        at = np.flatnonzero(self.rank >= 0)
        at = at[at + width <= self.end[at]]
        second = self.rank[at + width - self.width]
        at, second = at[second >= 0], second[second >= 0]
        return at, self.rank[at] * self.n + second

    def double(self):
        at, key = self.pairs(2 * self.width)
        self.width *= 2
        self._rank(at, key)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of several texts laid end to end, in order: first word, length, period (``sizes``: words of each text)."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    found = []
    if len(words):
        # lag 1: a word's earlier occurrence is its neighbour
        at = 1 + np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1]))
        first, last, lag = stretches(at, np.ones(len(at), np.int64))
        found.append((first - 1, last - first + 2, lag))
        ranks = Ranks(words, text, end)
        for lo, hi, context in bands(int(sizes.max())):
            while 2 * ranks.width <= context:
                ranks.double()
            at, key = ranks.pairs(context)
            if not len(at):
                break  # no context of this length occurs twice, so no longer one does
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            now, before = at[order[1:][same]], at[order[:-1][same]]
            near = (now - before >= lo) & (now - before <= hi)
            now, lag = now[near], (now - before)[near]
            order = np.argsort(now, kind="stable")
            first, last, lag = stretches(now[order], lag[order])
            found.append((first - lag, last + context - first + lag, lag))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    long = (length >= LEAST_WORDS) & (length >= LEAST_EXPONENT * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of_texts(texts: list[bytes]):
    """For every text: its runs as (start, length, period), and the text without words that repeat a run's first period."""
    number: dict = {}
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, total)
    start, length, period = find_runs(words, sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    edge = np.zeros(total + 1, np.int64)  # repeated words lie between a step up and a step down
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge)[:total] == 0
    cut = np.searchsorted(start, begin)
    for i, ws in enumerate(split):
        low, high = cut[i], cut[i + 1]
        if low == high:
            yield [], b" ".join(ws)
        else:
            runs = list(zip((start[low:high] - begin[i]).tolist(), length[low:high].tolist(), period[low:high].tolist()))
            yield runs, b" ".join(w for w, k in zip(ws, kept[begin[i]: begin[i + 1]]) if k)


def groups(texts, limit: int):
    """Neighbouring texts with up to ``limit`` bytes together."""
    out, held = [], 0
    for text in texts:
        if out and held + len(text) > limit:
            yield out
            out, held = [], 0
        out.append(text)
        held += len(text)
    if out:
        yield out


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(rows: DataFrame, text_col: str = "text", id_col: str = "doc_id", prepare=None) -> DataFrame:
    """``_id, runs, collapsed``: every maximal run of each text by start and period, and its words without the repeats.

    ``prepare(id, text)`` may edit the UTF-8 bytes of a text first.
    """
    import pyarrow as pa

    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make():
        def work(batch):
            texts = (t.as_py() or b"" for t in utf8(batch.column(batch.schema.get_field_index("_text"))))
            if prepare is not None:
                texts = map(prepare, (i.as_py() for i in batch.column(batch.schema.get_field_index("_id"))), texts)
            runs, collapsed = [], []
            for some in groups(texts, TOGETHER):
                for found, rest in runs_of_texts(some):
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    collapsed.append(rest)
            return {"runs": pa.array(runs, run), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}

        return work

    return map_batches(
        rows.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), make,
        {"runs": RUN, "collapsed": "string"})


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equals the first."""
    def better(a, b):
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(RUN[6:-1]), better)


def with_planted_period(doc_id, text: bytes) -> bytes:
    """Every tenth text, by the hash of its id, repeats some words from a place on: known runs for a test on a corpus."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return text
    words, g = text.split(), h // 10
    n = len(words)
    if n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = (words[a: a + p] * ((n - a) // p + 1))[: n - a]
    return b" ".join(words)
