"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time over an inverted index in shards.

Documents are scanned once per block of queries. Every task cuts its documents into shards and stores an inverted index of
each: postings of the terms that the queries hold, and the counts of all its terms. Document frequencies, the number of documents
and their length are sums over the shards. In each shard a query's short posting lists are summed term at a time into accumulators,
whose largest sum bounds them like a list of their own. They then move as one iterator beside the long lists through ranges of
documents: ranges and documents whose bounds stay below the k-th best score so far are skipped, the others are looked up
in the remaining lists from the largest bound down. Nothing is approximated: bounds are largest values, the k-th score is one that
k documents reach.

Scores are 64-bit integers: a term's weight is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``, its part of a score
``w * ((10^9 tf) div (1000 tf + 20 m))`` with ``m = 50 + ((50 n N) div L)`` for a document of ``n`` terms.

Defined results: a null or empty text holds no term, so it is neither counted nor found, and as a query finds nothing; equal scores
are ordered by ascending id, missing ids last; repeated documents are documents of their own, repeated queries are answered
each; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from mendcast.layout import materialise
from mendcast.llm.common import ascii_terms, numbered, utf8

K = 50
#: A block of queries is complete with so many distinct terms, terms or queries; the last query may exceed the first two.
BLOCK_TERMS, BLOCK_USES, BLOCK_QUERIES = 1 << 16, 1 << 18, 4096
#: A shard is complete with so many postings or documents.
SHARD_POSTINGS, SHARD_DOCUMENTS = 1 << 20, 1 << 14
#: Documents of a shard that are decided together.
RANGE = 1 << 11
#: Short lists fill accumulators for at most this share of a shard's documents.
SHORT = 1 / 8


def query_blocks(queries: DataFrame):
    """Blocks of (row, distinct terms) in the order of the table; the driver holds one block at a time."""
    block, terms, uses = [], {}, 0
    for row, text in queries.select("_row", F.col("_doc._text").cast("string")).toLocalIterator():
        used = sorted(set(ascii_terms((text or "").encode())))
        if used:
            block.append((row, [terms.setdefault(t, len(terms)) for t in used]))
            uses += len(used)
        if len(terms) >= BLOCK_TERMS or uses >= BLOCK_USES or len(block) >= BLOCK_QUERIES:
            yield block, terms
            block, terms, uses = [], {}, 0
    if block:
        yield block, terms


class ShardWriter:
    """Collects documents and turns them into one row with their inverted index."""

    names = ["docs", "n", "term", "size", "doc", "tf", "n_docs", "n_words"]

    def __init__(self, kind):
        self.kind = kind
        self.reset()

    def reset(self):
        self.ids, self.n, self.term, self.tf, self.postings, self.n_docs, self.n_words = [], [], [], [], 0, 0, 0

    def add(self, doc, n: int, term: np.ndarray, tf: np.ndarray):
        self.n_docs, self.n_words = self.n_docs + 1, self.n_words + n
        if len(term):
            self.ids.append(doc)
            self.n.append(n)
            self.term.append(term)
            self.tf.append(tf)
            self.postings += len(term)

    @property
    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or self.n_docs >= SHARD_DOCUMENTS

    def row(self):
        import pyarrow as pa

        term = np.concatenate(self.term) if self.term else np.zeros(0, np.int32)
        tf = np.concatenate(self.tf) if self.tf else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.n), dtype=np.int32), [len(t) for t in self.term])
        order = np.argsort(term, kind="stable")
        known, size = np.unique(term, return_counts=True)
        packed = [np.array(self.n, "<i8"), known.astype("<i4"), size.astype("<i4"), doc[order].astype("<i4"), tf[order].astype("<i8")]
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), pa.array(self.ids, self.kind))
        out = [ids, *[pa.array([a.tobytes()], pa.binary()) for a in packed], *[pa.array([v], pa.int64()) for v in (self.n_docs, self.n_words)]]
        self.reset()
        return pa.RecordBatch.from_arrays(out, self.names)


def build_index(rows: DataFrame, terms: dict) -> DataFrame:
    """Stored: a row per shard of ``rows`` (``_id``, ``_text``) with the postings of ``terms``."""
    def run(batches):
        writer, get = None, terms.get
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id"))
            writer = writer or ShardWriter(ids.type)
            for doc, text in zip(ids, utf8(batch.column(batch.schema.get_field_index("_text")))):
                words = ascii_terms(text.as_py() or b"")
                if words:
                    found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    writer.add(doc.as_py(), len(words), *np.unique(found[found >= 0], return_counts=True))
                    if writer.full:
                        yield writer.row()
        if writer is not None and writer.n_docs:
            yield writer.row()

    kind = dict(rows.dtypes)["_id"]
    return materialise(rows.mapInArrow(
        run, f"docs array<{kind}>, n binary, term binary, size binary, doc binary, tf binary, n_docs long, n_words long"))


def term_weights(index: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of every term of the queries, number of documents and of their terms, over all shards."""
    import pyarrow as pa

    def unpack(batches):
        for batch in batches:
            for term, size in zip(batch.column("term"), batch.column("size")):
                arrays = [pa.array(np.frombuffer(v.as_buffer(), "<i4").astype(np.int64)) for v in (term, size)]
                yield pa.RecordBatch.from_arrays(arrays, ["term", "df"])

    n, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    sums = index.select("term", "size").mapInArrow(unpack, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    weight = np.zeros(n_terms, np.int64)
    for term, df in zip(sums["term"], sums["df"]):
        weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return weight, n, length


class Shard:
    """One stored shard: scores for a term's postings, and the search for a query's best documents."""

    def __init__(self, row: dict, weight: np.ndarray, n_docs: int, n_words: int):
        import pyarrow as pa

        self.docs = row["docs"].values if row["docs"].values is not None else pa.array([])
        n, tf = (np.frombuffer(row[c].as_buffer(), "<i8") for c in ("n", "tf"))
        self.term, size, self.doc = (np.frombuffer(row[c].as_buffer(), "<i4") for c in ("term", "size", "doc"))
        self.begin = np.concatenate(([0], np.cumsum(size)))
        if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:  # beyond 64 bits: Python's integers
            m = np.array([50 + 50 * int(v) * n_docs // n_words for v in n], np.int64)
        else:
            m = 50 + 50 * n * n_docs // max(n_words, 1)
        self.part = (10**9 * tf) // (1000 * tf + 20 * m[self.doc]) * np.repeat(weight[self.term], size)
        self.ranges = np.arange(0, len(n) + RANGE, RANGE)

    def lists(self, query: np.ndarray) -> list:
        at = np.searchsorted(self.term, query)
        query, at = query[at < len(self.term)], at[at < len(self.term)]
        at = at[self.term[at] == query]
        return [(self.doc[b:e], self.part[b:e]) for b, e in zip(self.begin[at], self.begin[at + 1])]

    def iterators(self, query: np.ndarray) -> tuple[list, np.ndarray]:
        """The accumulators of the short lists as one iterator, then the long lists; and the accumulated sums."""
        lists = sorted(self.lists(query), key=lambda x: len(x[0]))
        room = max(int(SHORT * len(self.docs)), 1)
        filled = np.cumsum([len(d) for d, _ in lists])
        n_short = int(np.searchsorted(filled, room, "right"))
        short, out, sums = lists[:n_short], lists[n_short:], np.zeros(0, np.int64)
        if short:
            doc, part = (np.concatenate(x) for x in zip(*short))
            order = np.argsort(doc, kind="stable")
            doc, part = doc[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            sums = np.add.reduceat(part, first)
            out = [(doc[first], sums), *out]
        return out, sums

    def search(self, query: np.ndarray, best: "Best") -> None:
        iterators, sums = self.iterators(query)
        if not iterators:
            return
        if len(sums) >= best.k:  # so many documents reach this score at least
            best.raise_to(int(np.partition(sums, -best.k)[-best.k]))
        cuts = [np.searchsorted(doc, self.ranges) for doc, _ in iterators]
        bounds = np.zeros((len(iterators), len(self.ranges) - 1), np.int64)
        for row, cut, (_, part) in zip(bounds, cuts, iterators):
            filled = np.flatnonzero(cut[1:] > cut[:-1])
            row[filled] = np.maximum.reduceat(part, cut[filled])
        reach = bounds.sum(axis=0)
        for r in np.flatnonzero(reach >= best.least):
            if reach[r] < best.least:  # the k-th score has risen
                continue
            base, order = self.ranges[r], np.argsort(-bounds[:, r], kind="stable")
            rest = reach[r] - np.cumsum(bounds[order, r])  # what the lists after each one can add
            score = np.zeros(RANGE, np.int64)
            found = None
            for at, i in enumerate(order):
                low, high = cuts[i][r], cuts[i][r + 1]
                doc, part = iterators[i][0][low:high] - base, iterators[i][1][low:high]
                if found is None:
                    score[doc] += part
                    if rest[at] < best.least:  # documents in none of the lists so far stay below the k-th score
                        found = np.flatnonzero(score)
                        found = found[score[found] + rest[at] >= best.least]
                else:
                    if not len(found):
                        break
                    if len(doc):
                        place = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                        score[found] += np.where(doc[place] == found, part[place], 0)
                    found = found[score[found] + rest[at] >= best.least]
            if found is None:
                found = np.flatnonzero(score)
            found = found[score[found] >= best.least]
            if len(found) > best.k:
                found = found[score[found] >= np.partition(score[found], -best.k)[-best.k]]
            best.add(score[found], self.docs, found + base)


class Best:
    """The best documents of a query in this task: highest scores, ties by ascending id."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def raise_to(self, score: int):
        self.least = max(self.least, score)

    def add(self, scores, docs, at):
        if len(at):
            found = [docs[int(i)].as_py() for i in at]
            self.rows += [(-int(s), d is None, 0 if d is None else d, d) for s, d in zip(scores, found)]
            self.rows.sort(key=lambda r: r[:3])
            del self.rows[self.k:]
            if len(self.rows) == self.k:
                self.raise_to(-self.rows[-1][0])


def search_index(index: DataFrame, block: list, weight: np.ndarray, n_docs: int, n_words: int, k: int, kind: str) -> DataFrame:
    """Stored: the ``k`` best documents in each task for each query, as ``_row``, ``_id``, ``score``."""
    import pyarrow as pa

    queries = [(row, np.sort(np.array([t for t in terms if weight[t] > 0], np.int32))) for row, terms in block]

    def run(batches):
        best, id_type = [Best(k) for _ in queries], None
        for batch in batches:
            id_type = batch.schema.field("docs").type.value_type
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[i] for c in batch.schema.names}, weight, n_docs, n_words)
                for (_, query), top in zip(queries, best):
                    shard.search(query, top)
        for (row, _), top in zip(queries, best):
            if top.rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * len(top.rows), pa.int64()), pa.array([r[3] for r in top.rows], id_type),
                    pa.array([-r[0] for r in top.rows], pa.int64())], ["_row", "_id", "score"])

    found = index.drop("n_docs", "n_words").mapInArrow(run, f"_row long, _id {kind}, score long")
    # a group of tasks first, so that no query's candidates of all tasks meet in one place
    return materialise(best_rows(found.withColumn("_group", F.expr("spark_partition_id() div 1024")), ["_row", "_group"], k).drop("rank", "_group"))


def best_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of every row of ``items``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    queries = numbered(items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text")))
    found = None
    for block, terms in query_blocks(queries):
        index = build_index(rows, terms)
        weight, n_docs, n_words = term_weights(index, len(terms))
        part = search_index(index, block, weight, n_docs, n_words, k, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"_row long, _id {kind}, score long")
    return best_rows(found, ["_row"], k).join(queries, "_row").select(
        F.col("_doc._item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("_id").alias("doc_id"), "score")
