"""Removal of every byte that lies in a string of ``LENGTH`` bytes which starts more than once, by sorting suffixes.

Only suffixes that can be repeated are sorted. A string of 200 bytes has a *mark*: the leftmost of its 64-byte windows with the
smallest hash. Equal strings have equal marks in equal places, so a string is compared with those of the same mark only, and
starts whose mark occurs once need no comparison. Neighbouring starts share their mark, so a document is a row of short runs.

The suffixes of one mark are ordered by deep-shallow sorting, each read to 200 bytes. Multikey quicksort partitions them by
eight bytes at a time to a shallow depth of 64; groups that are still equal then go into a blind trie: the suffixes of a
group are compared with one leader, branch at the first word that differs, and every branch becomes a group with a leader
of its own, until all members of a group equal their leader. Each round handles all groups of a task as arrays.

Identical texts and identical runs are reduced to one before they are sorted. A mark with more than ``hot`` runs is split by
a hash of the whole 200 bytes, so no task holds an unbounded group.

Defined results: a null text is empty; repeated rows and exact copies of at least 200 bytes are removed whole; overlapping
strings inside one document count; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from mendcast.layout import materialise
from mendcast.llm.common import mix64, text_or_empty

LENGTH = 200
MARK = 64
WINDOWS = LENGTH - MARK + 1
SHALLOW = 64
HOT = 4096
CHUNK = 1 << 20
POSITION = np.uint64(CHUNK - 1)
BASE = 0x9E3779B97F4A7C15
#: Positions that one sort of a task takes together, about 100 bytes of memory each.
AT_ONCE = 1 << 20


class Marks:
    """Splits a text into runs of starts that share their mark."""

    def __init__(self):
        size = CHUNK + 1
        self.value = mix64(np.arange(1, 257, dtype=np.uint64))
        self.power, self.inverse = self._powers(BASE, size), self._powers(pow(BASE, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    def runs(self, data: bytes):
        """(mark, first start, number of starts) as arrays."""
        found = []
        step = CHUNK - LENGTH + 1
        for begin in range(0, max(len(data) - LENGTH + 1, 0), step):
            part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - begin), begin)
            mark, first, n = self._part(part)
            found.append((mark, first + begin, n))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _part(self, part: np.ndarray):
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[part] * self.inverse[:n], out=total[1:])
        mark = mix64((total[MARK:] - total[:-MARK]) * self.power[: n - MARK + 1])
        least = (mark & ~POSITION) | np.arange(len(mark), dtype=np.uint64)
        size = 1
        while 2 * size <= WINDOWS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < WINDOWS:
            least = np.minimum(least[: len(least) - (WINDOWS - size)], least[WINDOWS - size:])
        at = (least & POSITION).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        return mark[at[first]], first, np.diff(np.concatenate((first, [len(at)])))


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place, as one number each."""
    out = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        out |= data[k: len(out) + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _regroup(keys: list[np.ndarray]):
    """Order by the keys (first key first) and the numbered groups of equal keys in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def _shared(order: np.ndarray, group: np.ndarray):
    """The part of a grouping whose groups have at least two members."""
    big = np.bincount(group)[group] > 1
    return order[big], group[big]


def equal_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``at`` agree in their first LENGTH bytes with another of the same group: deep-shallow sorting."""
    equal = np.zeros(len(at), bool)
    words = words_of(data)
    live = np.arange(len(at))
    order, sub = _shared(*_regroup([group]))
    live, group = live[order], sub
    for depth in range(0, SHALLOW, 8):  # multikey quicksort, one eight-byte character per level
        if not len(live):
            return equal
        order, sub = _shared(*_regroup([group, words[at[live] + depth]]))
        live, group = live[order], sub
    steps = (*range(SHALLOW, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else []))
    while len(live):  # blind trie, one level of branches per round
        leads = np.concatenate(([True], group[1:] != group[:-1]))
        leader = live[np.flatnonzero(leads)[np.cumsum(leads) - 1]]
        branch = np.full(len(live), len(steps), np.int64)
        word = np.zeros(len(live), np.uint64)
        open_ = np.arange(len(live))
        for k, depth in enumerate(steps):
            mine = words[at[live[open_]] + depth]
            differs = mine != words[at[leader[open_]] + depth]
            gone = open_[differs]
            branch[gone], word[gone] = k, mine[differs]
            open_ = open_[~differs]
        same = branch == len(steps)
        followers = np.bincount(np.cumsum(leads) - 1, weights=same)[np.cumsum(leads) - 1] > 1
        equal[live[same & followers]] = True
        rest = ~same
        order, sub = _shared(*_regroup([group[rest], branch[rest], word[rest]]))
        live, group = live[rest][order], sub
    return equal


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_or_empty(text_col).alias("_text")).select(
        F.xxhash64("_text").alias("_h"), F.octet_length("_text").alias("_len"), "_text"
    )


def marked_runs(texts: DataFrame) -> DataFrame:
    """(``mark``, ``_h``, ``_len``, ``start``, ``n``, ``more``): one row for each mark of a text.

    ``more`` packs the further runs of the same mark in the same text, as periodic text has them, so a mark has as many rows
    as texts. Each task gives equal texts once.
    """
    import pyarrow as pa

    def one(data: bytes, marks: Marks):
        mark, first, n = marks.runs(data)
        order = np.argsort(mark, kind="stable")
        ranked = mark[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        more = [None] * len(heads)
        for k in np.flatnonzero(np.diff(np.append(heads, len(ranked))) > 1):
            rest = order[heads[k] + 1: heads[k + 1] if k + 1 < len(heads) else len(ranked)]
            more[k] = np.stack((first[rest], n[rest])).astype("<i4").tobytes()
        lead = order[heads]
        return mark[lead].view(np.int64), first[lead].astype(np.int32), n[lead].astype(np.int32), more

    def run(batches):
        marks, seen = Marks(), set()
        for batch in batches:
            for h, size, text in zip(batch.column("_h").to_pylist(), batch.column("_len").to_pylist(), batch.column("_text")):
                if size < LENGTH or (h, size) in seen:
                    continue
                seen.add((h, size))
                mark, first, n, more = one(text.as_py().encode("utf-8"), marks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark), pa.array(np.full(len(mark), h)), pa.array(np.full(len(mark), size, np.int32)),
                     pa.array(first), pa.array(n), pa.array(more, pa.binary())],
                    ["mark", "_h", "_len", "start", "n", "more"],
                )

    return texts.mapInArrow(run, "mark long, _h long, _len int, start int, n int, more binary")


def shared_runs(texts: DataFrame) -> DataFrame:
    """Runs whose mark also belongs to another run, gathered per text; ``count`` is the number of texts with the mark."""
    place = F.xxhash64("_h", "_len")
    of_mark = W.partitionBy("mark")
    return (
        marked_runs(texts).withColumn("_place", place)
        .withColumn("_low", F.min("_place").over(of_mark)).withColumn("_high", F.max("_place").over(of_mark))
        .withColumn("count", F.count("*").over(of_mark))
        .where((F.col("_low") != F.col("_high")) | F.col("more").isNotNull())
        .groupBy("_h", "_len").agg(F.collect_set(F.struct("start", "n", "mark", "count", "more")).alias("runs"))
    )


def run_bytes(suspects: DataFrame, hot: int) -> DataFrame:
    """(``mark``, ``salt``, ``content``, ``bytes``, ``_h``, ``_len``, ``starts``): each different run of a text with all its places.

    Runs of hot marks come as single starts.
    """
    import pyarrow as pa

    kinds = {
        "mark": pa.int64(), "salt": pa.int32(), "content": pa.binary(), "bytes": pa.binary(), "_h": pa.int64(), "_len": pa.int32(),
        "starts": pa.list_(pa.int32()),
    }

    def pieces(data: bytes, r: dict):
        first, n = [r["start"]], [r["n"]]
        if r["more"] is not None:
            more = np.frombuffer(r["more"], "<i4").reshape(2, -1).tolist()
            first, n = first + more[0], n + more[1]
        salts = r["count"] // hot + 1
        for p, k in zip(first, n):
            if salts == 1:
                yield 0, data[p: p + k + LENGTH - 1], p
                continue
            for q in range(p, p + k):
                part = data[q: q + LENGTH]
                yield zlib.crc32(part) % salts, part, q

    def cut(batches):
        for batch in batches:
            rows = []
            for h, size, text, runs in zip(*(batch.column(c) for c in ("_h", "_len", "_text", "runs"))):
                h, size, data = h.as_py(), size.as_py(), text.as_py().encode("utf-8")
                for r in runs.as_py():
                    places: dict = {}
                    for salt, part, p in pieces(data, r):
                        places.setdefault((salt, part), []).append(p)
                    rows.extend((r["mark"], salt, hashlib.md5(part).digest(), part, h, size, ps) for (salt, part), ps in places.items())
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

    return suspects.mapInArrow(cut, "mark long, salt int, content binary, bytes binary, _h long, _len int, starts array<int>")


def repeated_starts(runs: DataFrame) -> DataFrame:
    """(``mark``, ``salt``, ``content``, ``spans``): the starts of a run, from 0, whose 200 bytes begin elsewhere too."""
    import pyarrow as pa

    distinct = runs.groupBy("mark", "salt", "content", "bytes").agg(F.sum(F.size("starts")).alias("times"))
    spans_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def solve(rows):
        number: dict = {}
        sizes = np.array([len(r[3]) for r in rows])
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        counts = sizes - LENGTH + 1
        data = np.frombuffer(b"".join(r[3] for r in rows) + bytes(8), np.uint8)
        owner = np.repeat(np.arange(len(rows)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        group = np.array([number.setdefault(r[:2], len(number)) for r in rows])
        equal = equal_suffixes(data, begins[owner] + within, group[owner])
        equal |= np.array([r[4] > 1 for r in rows])[owner]
        cuts = np.cumsum(counts)[:-1]
        found = [(r, spans_of(f)) for r, f in zip(rows, np.split(equal, cuts))]
        found = [(r, s) for r, s in found if s]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r, _ in found], pa.int64()), pa.array([r[1] for r, _ in found], pa.int32()), pa.array([r[2] for r, _ in found], pa.binary()),
             pa.array([[{"from": a, "to": b} for a, b in s] for _, s in found], spans_type)],
            ["mark", "salt", "content", "spans"],
        )

    def sort(batches):
        held, positions = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("mark", "salt", "content", "bytes", "times"))):
                if positions >= AT_ONCE and row[:2] != held[-1][:2]:
                    yield solve(held)
                    held, positions = [], 0
                held.append(row)
                positions += len(row[3]) - LENGTH + 1
        if held:
            yield solve(held)

    gathered = distinct.repartition("mark", "salt").sortWithinPartitions("mark", "salt")
    return gathered.mapInArrow(sort, "mark long, salt int, content binary, spans array<struct<from:int,to:int>>")


def removed_spans(docs: DataFrame, text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Suspect texts (stored) and their repeated starts: (``_h``, ``_len``, ``starts``)."""
    texts = _texts(docs, text_col)
    distinct = texts.where(F.col("_len") >= LENGTH).groupBy("_h", "_len").agg(F.first("_text").alias("_text"))
    suspects = materialise(distinct.join(shared_runs(texts), ["_h", "_len"]))
    runs = run_bytes(suspects, hot)
    solved = repeated_starts(runs)
    spans = (
        runs.drop("bytes").join(solved, ["mark", "salt", "content"])
        .select("_h", "_len", "starts", F.explode("spans").alias("s"))
        .select("_h", "_len", "s", F.explode("starts").alias("start"))
        .groupBy("_h", "_len")
        .agg(F.collect_list(F.struct((F.col("start") + F.col("s.from")).alias("from"), (F.col("start") + F.col("s.to")).alias("to"))).alias("starts"))
    )
    return suspects.select("_h", "_len", "_text"), spans


def cut_texts(suspects: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """(``_h``, ``_len``, ``n_removed``, ``n_spans``, ``kept_sha256``) of every text that loses bytes."""
    import pyarrow as pa

    kinds = {"_h": pa.int64(), "_len": pa.int32(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}

    def cut(batches):
        for batch in batches:
            rows = []
            for h, size, text, starts in zip(*(batch.column(c) for c in ("_h", "_len", "_text", "starts"))):
                data = np.frombuffer(text.as_py().encode("utf-8"), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                for s in starts.as_py():
                    change[s["from"]] += 1
                    change[s["to"] + LENGTH - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = data[~gone].tobytes()
                rows.append((h.as_py(), size.as_py(), int(gone.sum()), len(spans_of(gone)), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

    return suspects.join(spans, ["_h", "_len"]).mapInArrow(
        cut, "_h long, _len int, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked, the ``kept`` bytes
    of documents that lost some but not all."""
    suspects, spans = removed_spans(docs, text_col, hot)
    cut = cut_texts(suspects, spans, with_text)
    ids = materialise(
        docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).select(
            "_id", F.xxhash64("_text").alias("_h"), F.octet_length("_text").alias("_len"), F.sha2("_text", 256).alias("_sha")
        )
    )
    copies = ids.groupBy("_h", "_len").agg(F.count("*").alias("_copies")).where((F.col("_copies") > 1) & (F.col("_len") >= LENGTH))
    facts = cut.join(copies, ["_h", "_len"], "full")
    whole = F.coalesce(F.col("_copies") > 1, F.lit(False))
    n_bytes = F.col("_len").cast("long")
    out = ids.join(facts, ["_h", "_len"], "left").select(
        F.col("_id").alias(id_col), n_bytes.alias("n_bytes"),
        F.when(whole, n_bytes).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"),
    )
    return out if with_text else out.drop("kept")
