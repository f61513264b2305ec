"""Packing by lexical retrieval: a seed document's window is filled with its nearest unused neighbours by BM25.

Documents are tokenised once and stored. They are then dealt into shards by the smallest hashes of their words, so that
texts with common words tend to meet; a range partitioning that ends with the id cuts even a group of equal texts into shards of
bounded size. Each shard builds an inverted index (words hashed to ``BUCKETS``, document frequencies counted over the whole
table) and packs greedily: the window of a seed takes the unused documents with the highest BM25 score for the seed's words,
the one that does not fit whole is cut and its rest seeds the next window. What is left at the end of a shard is
cut into sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is its end id alone; repeated rows are rows of their own; ties go to the earlier
document of the shard; a document longer than a window fills windows of its own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mendcast.layout import materialise
from mendcast.llm.common import mix64, portions
from mendcast.llm.tokens import gathered, tokens_of

WINDOW, END = 2048, 1
BUCKETS = 1 << 18
SHARD_TOKENS = 1 << 22
PORTION, BLOCK = 1 << 23, 1 << 17
K1, B = 1.2, 0.75
#: Used documents leave the index whenever this share of those in it is left.
KEEP = 0.9


class Words:
    """Buckets of the words in a row of token ids; a word ends with an id that the vocabulary marks as final."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        names = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True)
        size = max(names.values()) + 1
        self.final = np.ones(size, bool)
        for name, i in names.items():
            self.final[i] = name.endswith("</w>") or name.startswith("<|")
        self.hash = mix64(np.arange(1, size + 1, dtype=np.uint64))

    def of(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words in rows laid one after the other, and where each row's begin there, the end of the last included."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
        starts = np.concatenate(([True], self.final[ids[:-1]]))
        starts[begin[:-1][begin[:-1] < begin[1:]]] = True
        first = np.flatnonzero(starts)
        within = np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
        parts = self.hash[ids] * (2 * within.astype(np.uint64) + np.uint64(1))
        return (mix64(np.add.reduceat(parts, first)) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(first, begin)

    def of_rows(self, rows: list[np.ndarray], lengths: np.ndarray) -> list[np.ndarray]:
        """Buckets of the words of every row, whose last id is not read; blocks of rows are small enough for a processor's cache."""
        out, block = [], np.cumsum(lengths) // BLOCK
        cuts = np.flatnonzero(np.diff(block)) + 1
        for at, until in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            begin = np.concatenate(([0], np.cumsum(lengths[at: until] - 1)))
            of, begin = self.of(np.concatenate([r[:-1] for r in rows[at: until]]), begin)
            out += np.split(of, begin[1:-1])
        return out


@functools.lru_cache(maxsize=2)
def words_of(vocabulary: str) -> Words:
    """A worker reads the vocabulary once for all its tasks."""
    return Words(vocabulary)


def distinct_words(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and number of every distinct bucket of a row, in order of row and bucket."""
    pairs = np.sort(np.repeat(np.arange(len(begin) - 1) * BUCKETS, np.diff(begin)) + words)
    first = np.flatnonzero(np.concatenate((np.ones(len(pairs[:1]), bool), pairs[1:] != pairs[:-1])))
    return pairs[first] // BUCKETS, pairs[first] % BUCKETS, np.diff(first, append=len(pairs))


def two_least(row: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest word hashes of every row; the smallest again where there is one, 0 where there is none."""
    least, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(row):
        hashes = mix64(bucket.astype(np.uint64) + np.uint64(1)).view(np.int64)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        sizes = np.diff(first, append=len(row))
        low = np.minimum.reduceat(hashes, first)
        others = np.where(hashes == np.repeat(low, sizes), np.iinfo(np.int64).max, hashes)
        least[row[first]], second[row[first]] = low, np.where(sizes > 1, np.minimum.reduceat(others, first), low)
    return least, second


def tokenise(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored documents and stored word counts.

    Documents: ``_id``, ``ids`` (16-bit, with the end id), ``tokens`` and the two smallest word hashes ``near``, ``next``. Counts: one row per
    task, written after its documents; ``ids`` packs buckets and document frequencies, ``near`` and ``next`` are documents and words.
    """
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names, kinds = ["_id", "ids", "tokens", "near", "next"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        tokens, words = tokens_of(vocabulary, plain=False), words_of(vocabulary)
        seen, n_docs, n_words, kind = np.zeros(BUCKETS, np.int32), 0, 0, None
        for batch in batches:
            kind = batch.schema.field("_id").type
            for at, until in portions(batch.column("_text"), PORTION):
                ids, begin, codes, bounds = tokens.encode_pieces(batch.column("_text").slice(at, until - at))
                n = until - at
                of, of_begin = gathered(*words.of(ids, begin), codes)
                row, bucket, _ = distinct_words(of, of_begin[bounds])
                seen += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
                n_docs, n_words = n_docs + n, n_words + len(of)
                flat, starts = gathered(ids, begin, codes)
                ends = starts[bounds]
                flat = np.insert(flat, ends[1:], np.uint16(END)).astype("<u2")
                rows = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(2 * (ends + np.arange(n + 1))), pa.py_buffer(flat)]).cast(pa.binary())
                columns = [pa.array(c) for c in (np.diff(ends) + 1, *two_least(row, bucket, n))]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, n), rows, *columns], names)
        if kind is not None:
            at = np.flatnonzero(seen)
            packed = np.stack((at, seen[at])).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), *[pa.array([v], t) for v, t in zip((packed, -1, n_docs, n_words), kinds)]], names
            )

    kind = dict(rows.dtypes)["_id"]
    stored = materialise(rows.mapInArrow(run, f"_id {kind}, ids binary, tokens long, near long, next long"))
    return stored.where("tokens > 0"), stored.where("tokens < 0")


def word_statistics(counts: DataFrame) -> tuple[np.ndarray, float]:
    """Inverse document frequency per bucket and mean words per document over all documents."""
    import pyarrow as pa

    def unpack(batches):
        for batch in batches:
            for ids in batch.column("ids"):
                at, n = np.frombuffer(ids.as_buffer(), "<i4").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["bucket", "n"])

    sums = counts.select("ids").mapInArrow(unpack, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    docs, length = counts.agg(F.coalesce(F.sum("near"), F.lit(0)), F.coalesce(F.sum("next"), F.lit(0))).first()
    df = np.zeros(BUCKETS)
    df[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return np.log(1 + (docs - df + 0.5) / (df + 0.5)).astype(np.float32), length / docs if docs else 1.0


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, terms: list[np.ndarray], idf: np.ndarray, mean_words: float):
        begin = np.concatenate(([0], np.cumsum([len(t) for t in terms], dtype=np.int64)))
        doc, term, tf = distinct_words(np.concatenate([np.zeros(0, np.int64), *terms]), begin)
        self.n = len(terms)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.n))))
        tf, length = tf.astype(float), np.diff(begin).astype(float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_words, 1e-9)))
        place = np.arange(len(term))
        order = np.sort(term << 40 | place) & ((1 << 40) - 1)
        self.doc, self.weight = doc[order], weight[order]
        ranked = term[order]
        new = np.concatenate((np.zeros(len(ranked[:1]), bool), ranked[1:] != ranked[:-1]))
        self.post = np.concatenate(([0], np.flatnonzero(new), [len(ranked)]))
        self.rank = np.empty(len(term), np.int64)
        self.rank[order] = np.cumsum(new)
        self.count, self.met, self.gain = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def keep(self, wanted: np.ndarray) -> None:
        """From now on only the documents that are ``wanted`` are scored; all others score 0."""
        kept = wanted[self.doc]
        before = np.concatenate(([0], np.cumsum(kept)))
        self.doc, self.weight, self.post = self.doc[kept], self.weight[kept], before[self.post]

    def scores(self, d: int) -> np.ndarray:
        """Score of every document of the shard for the words of document ``d``."""
        ranks = self.rank[self.begin[d]: self.begin[d + 1]]
        first, sizes = self.post[ranks], self.post[ranks + 1] - self.post[ranks]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        if total > len(self.met):  # kept from call to call
            self.count, self.met, self.gain = np.arange(2 * total), np.empty(2 * total, np.int64), np.empty(2 * total)
        at = np.repeat(first - ends + sizes, sizes)
        at += self.count[:total]
        met, gain = self.met[:total], self.gain[:total]
        np.take(self.doc, at, out=met, mode="clip")
        np.take(self.weight, at, out=gain, mode="clip")
        return np.bincount(met, weights=gain, minlength=self.n)


def retrieval_order(index: Index, lengths: np.ndarray, window: int) -> list[int]:
    """Documents in the order in which they fill consecutive windows. The index is used up."""
    unused = np.ones(len(lengths), bool)
    order, filled, seed, cursor, kept = [], 0, None, 0, len(lengths)
    while len(order) < len(lengths):
        picks: list[int] = []
        if len(lengths) - len(order) < KEEP * kept:
            index.keep(unused)
            kept = len(lengths) - len(order)
        if seed is not None:
            scores = np.where(unused, index.scores(seed), 0.0)
            k = min(len(scores), 32)
            best = np.argpartition(-scores, k - 1)[:k]
            best = best[np.lexsort((best, -scores[best]))]
            picks = [int(i) for i in best if scores[i] > 0]
        if not picks:
            while not unused[cursor]:
                cursor += 1
            picks, seed = [cursor], None
        for d in picks:
            unused[d] = False
            order.append(d)
            room = window - filled
            filled = (filled + int(lengths[d])) % window
            if lengths[d] >= room or seed is None:
                seed = d
                break
    return order


def cut_sequences(order: list[int], lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; the last, partial window is cut at powers of two."""
    total = int(lengths.sum())
    sizes = [window] * (total // window)
    rest = total % window
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    pieces, sequence, offset = [], 0, 0
    for d in order:
        start, left = 0, int(lengths[d])
        while left:
            n = min(left, sizes[sequence] - offset)
            pieces.append((d, start, n, sequence, offset))
            start, left, offset = start + n, left - n, offset + n
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0
    return pieces


def pack_by_retrieval(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked, ``ids``."""
    import pyarrow as pa

    stored, counts = tokenise(docs, vocabulary, id_col, text_col)
    idf, mean_words = word_statistics(counts)
    shared = docs.sparkSession.sparkContext.broadcast((idf, mean_words))
    total = stored.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    kind = dict(stored.dtypes)["_id"]
    kinds = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def pack(batches):
        from pyspark import TaskContext

        words, (idf, mean_words) = words_of(vocabulary), shared.value
        base = TaskContext.get().partitionId() << 33

        def shard(keys, rows):
            nonlocal base
            lengths = np.array([len(r) for r in rows])
            index = Index(words.of_rows(rows, lengths), idf, mean_words)
            pieces = cut_sequences(retrieval_order(index, lengths, window), lengths, window)
            parts = [rows[d][s: s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces]
            d, s, n, q, o = (np.array(c, np.int64) for c in zip(*pieces))
            arrays = [pa.concat_arrays(keys).take(pa.array(d)), s, n, [zlib.crc32(p) for p in parts], lengths[d], q + base, o]
            names = ["_id", *kinds]
            base += int(q.max()) + 1
            columns = [arrays[0], *[pa.array(a, t) for a, t in zip(arrays[1:], kinds.values())]]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        keys, rows, held = [], [], 0
        for batch in batches:
            for i, ids in enumerate(batch.column("ids")):
                row = np.frombuffer(ids.as_py(), "<u2")
                keys.append(batch.column("_id").slice(i, 1))
                rows.append(row)
                held += len(row)
                if held >= shard_tokens:
                    yield shard(keys, rows)
                    keys, rows, held = [], [], 0
        if rows:
            yield shard(keys, rows)

    near = stored.repartitionByRange(shards, "near", "next", "_id", F.xxhash64("ids")).sortWithinPartitions("near", "next", "_id")
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return near.select("_id", "ids").mapInArrow(pack, schema + (", ids binary" if with_ids else "")).withColumnRenamed("_id", id_col)
