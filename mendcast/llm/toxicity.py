"""Toxic passages by maximum-scoring segments over word log-odds, calibrated by extreme-value statistics.

Word evidence: each word stands for itself and for its prefixes. For every such feature the labelled rows give the number of
documents and of toxic documents that hold it, added up over all of them by the feature's 63-bit hash: of N features about N^2 / 2^64
pairs would be confused. The labelled rows are bounded: beyond ``LABELLED`` of them (in expectation) a sample by id is learned from.
Features that ``SUPPORT`` documents hold are stored, so the table is bounded with them; each worker loads it once, 16 bytes a
feature, and neither the driver nor a batch of texts reads it. With a Dirichlet prior whose mass
``PRIOR`` is spread like the corpus, a feature seen in n documents of which t are toxic has the log-odds
log((t + PRIOR) / (n * share + PRIOR)), share being the part of toxic documents; a word takes the value of its longest
feature that at least ``SUPPORT`` documents hold. A constant ``DRIFT`` is subtracted, so that ordinary text loses score.

Passages: one left-to-right scan keeps a list of candidate segments and merges them as their sums allow; it ends with
every maximal segment of positive sum, in time linear in the words. The largest sum of n clean words follows
an extreme-value law, so a segment of sum s has the expected number K * n * exp(-lambda * s) of equals in clean text; lambda
solves the moment equation of the word scores of clean documents and K is fitted to their largest segments.
Significant segments are those with fewer than ``SIGNIFICANT`` expected equals.

A document's score is a logistic function of its best and its summed evidence (-log expected number), fitted on a sample of
labelled rows that holds ``SAMPLE`` documents in expectation. There every document is scored as if its own label had
not been counted, so the fit sees the values that an unlabelled text would get.

Defined results: null and empty texts have no passage; without both labels among the rows to learn from every score is 0;
null labels and ids teach nothing; a document with labels that contradict each other is toxic; repeated rows count as rows; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mendcast.layout import materialise
from mendcast.llm.common import WordTable, crc_of_id, map_batches, shared_files

PREFIXES = (4, 5, 6)
PRIOR, SUPPORT, DRIFT, SIGNIFICANT = 1.0, 5, 0.8, 0.05
SAMPLE = 8000
#: Labelled rows that are learned from, in expectation. It bounds the stored table and the training, never what is scored.
LABELLED = 200_000
STEP, LOWEST = 0.05, -8.0
TRIMMED = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
LEVELS = len(PREFIXES) + 1
#: Features of documents that a task adds up at once, and rows in a file of the stored table.
HELD, FILE_ROWS = 2_000_000, 1 << 16
NO_KEY, KEY_BITS = b"\xff" * 8, (1 << 63) - 1


def features(words: list[bytes]) -> np.ndarray:
    """Keys of every word, shortest prefix first; a level that a word is too short for is -1."""
    out = []
    for w in words:
        word = w.decode("utf-8").lower().strip(TRIMMED)
        names = [f"{n} {word[:n]}" if len(word) > n else "" for n in PREFIXES] + [word]
        out.append(b"".join([blake2b(x.encode(), digest_size=8).digest() if x else NO_KEY for x in names]))
    keys = np.frombuffer(b"".join(out), "<i8").reshape(-1, LEVELS)
    return np.where(keys == -1, -1, keys & KEY_BITS)


def level_log_odds(toxic: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    return np.log((toxic + PRIOR) / (seen * share + PRIOR))


@lru_cache(maxsize=1)
def loaded(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stored table of a model by ascending key: keys, documents, toxic documents. The last one stays in the worker."""
    import pyarrow.parquet as pq

    columns: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)])
    for name in files:
        folder, path = shared_files(name)
        with folder.open_input_file(path) as source:
            part = pq.read_table(source, columns=["key", "seen", "toxic"])
        for held, column, kind in zip(columns, ("key", "seen", "toxic"), (np.int64, np.int32, np.int32)):
            held.append(part[column].to_numpy().astype(kind))
    keys, seen, toxic = map(np.concatenate, columns)
    order = np.argsort(keys)[np.count_nonzero(keys < 0):]  # the row of totals is no feature
    return keys[order], seen[order], toxic[order]


@dataclass
class ToxicModel:
    """Files with the counts per feature; ``lam`` and ``log_k`` of the extreme-value law; logistic weights for (1, best, sum)."""

    files: list[str]
    share: float
    lam: float = 1.0
    log_k: float = 0.0
    logistic: tuple = (0.0, 0.0, 0.0)

    def counts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and toxic documents of every key; 0 for those that are not stored."""
        keys, seen, toxic = loaded(tuple(self.files))
        if not len(keys):
            return np.zeros(at.shape, np.int64), np.zeros(at.shape, np.int64)
        where = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        hit = keys[where] == at
        return np.where(hit, seen[where], 0).astype(np.int64), np.where(hit, toxic[where], 0).astype(np.int64)

    def word_scores(self, label: int | None):
        """Function from words to scores. With a label, as if one document of that label had not been counted."""
        less_seen, less_toxic = (0 if label is None else 1), int(label == 1)

        def score(words: list[bytes]) -> list[float]:
            if not words:
                return []
            at = features(words)
            seen, toxic = self.counts(at)
            seen, toxic = seen - less_seen, toxic - less_toxic
            supported = seen >= SUPPORT
            level = LEVELS - 1 - supported[:, ::-1].argmax(axis=1)
            pick = np.arange(len(words))
            value = level_log_odds(np.maximum(toxic[pick, level], 0), np.maximum(seen[pick, level], 0), self.share)
            return list(np.where(supported.any(axis=1), value, 0.0) - DRIFT)

        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments of positive sum as (first, last, sum); only positive words are visited."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []  # first, last, sum before, sum after, place of the nearest candidate with a smaller sum before
    for i in np.flatnonzero(scores > 0):
        first, last, before, after = int(i), int(i), total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append([first, last, before, after, j])
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1], float(s[3] - s[2])) for s in stack]


def expected_log(model: ToxicModel, n: int, s: np.ndarray) -> np.ndarray:
    """Log of the expected number of clean segments of at least this sum."""
    return model.log_k + np.log(max(n, 1)) - model.lam * s


def evidence(model: ToxicModel, n: int, sums: np.ndarray) -> tuple[float, float]:
    if not len(sums):
        return 0.0, 0.0
    e = np.maximum(0.0, -expected_log(model, n, sums))
    return float(e.max()), float(e[e > -np.log(SIGNIFICANT)].sum())


def solve_lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """Positive root of sum p * exp(lambda * value) = 1 by bisection."""
    p = counts / max(counts.sum(), 1)
    if not (values[counts > 0] > 0).any() or (p * values).sum() >= 0:
        return 1.0
    values, p = values[p > 0], p[p > 0]
    low, high = 1e-6, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 32:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return (low + high) / 2


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the penalised log loss."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out_remainder: int, most: int = LABELLED,
) -> DataFrame:
    """Stored: (``_id``, ``_text``, ``_label``) of the rows that are learned from, at most ``most`` labels in expectation.

    The join is always a shuffle of these texts, done once: whether labels are small enough to be sent everywhere would change with the
    size of the table.
    """
    usable = labels.where(F.col(label_col).isNotNull() & (crc_of_id(id_col) % 3 != held_out_remainder))
    share = min(1.0, most / max(usable.count(), 1))

    def drawn(name: str):
        return F.pmod(F.xxhash64(F.col(name).cast("string"), F.lit("labelled")), F.lit(1 << 30)) < int(share * (1 << 30))

    given = usable.where(drawn(id_col)).groupBy(F.col(id_col).alias("_key")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    texts = docs.where((crc_of_id(id_col) % 3 != held_out_remainder) & drawn(id_col)).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    joined = texts.join(given.hint("merge"), F.col("_doc") == F.col("_key"))
    return materialise(joined.select(F.col("_key").cast("string").alias("_id"), "_text", (F.col("_label") > 0).cast("int").alias("_label")))


def added_up(clean: list[np.ndarray], toxic: list[np.ndarray]) -> list[np.ndarray]:
    """(keys, documents, toxic documents) from the distinct keys of each clean and each toxic document."""
    keys, seen = np.unique(np.concatenate([*clean, *toxic]), return_counts=True)
    some, n = np.unique(np.concatenate([np.zeros(0, np.int64), *toxic]), return_counts=True)
    among = np.zeros(len(keys), np.int64)
    among[np.searchsorted(keys, some)] = n
    return [keys, seen, among]


def count_features(rows: DataFrame) -> ToxicModel | None:
    """Documents and toxic documents per feature over all rows; each task sends sums over ``HELD`` features of its documents."""
    import pyarrow as pa

    def count(batches):
        memo = WordTable(lambda words: [k.tobytes() for k in features(words)])
        docs, held, size = [0, 0], ([], []), 0
        packed = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "seen", "toxic"])
        for batch in batches:
            for text, label in zip(batch.column("_text"), batch.column("_label")):
                docs[label.as_py()] += 1
                words = list(set((text.as_py() or "").encode("utf-8").split()))
                if words:
                    ids = memo.ids(words)
                    at = np.unique(np.frombuffer(b"".join(map(memo.values.__getitem__, ids)), np.int64))
                    held[label.as_py()].append(at[at >= 0])
                    size += len(at)
                if size >= HELD:
                    yield packed(*added_up(*held))
                    held, size = ([], []), 0
        if size:
            yield packed(*added_up(*held))
        yield packed([-1], [sum(docs)], [docs[1]])

    sums = materialise(
        rows.select("_text", "_label").mapInArrow(count, "key long, seen long, toxic long").groupBy("key")
        .agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).where((F.col("seen") >= SUPPORT) | (F.col("key") < 0))
    )
    whole = sums.where("key < 0").first()
    if whole is None or not 0 < whole["toxic"] < whole["seen"]:
        return None
    stored = materialise(sums.repartition(sums.count() // FILE_ROWS + 1))
    return ToxicModel(sorted(stored.inputFiles()), whole["toxic"] / whole["seen"])


def calibrate(model: ToxicModel, rows: DataFrame, n_rows: int, sample: int) -> ToxicModel:
    """Fits the extreme-value law and the logistic function on a sample of the labelled rows, each without its own label."""
    share = min(1.0, sample / max(n_rows, 1))
    drawn = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    shared = rows.sparkSession.sparkContext.broadcast(model)
    bins = int(-2 * LOWEST / STEP)

    def scorer():
        memos = [WordTable(shared.value.word_scores(label)) for label in (0, 1)]

        def work(batch) -> dict:
            out = {"label": [], "n": [], "sums": [], "bins": []}
            for text, label in zip(batch.column("_text"), batch.column("_label")):
                memo = memos[label.as_py()]
                ids = memo.ids((text.as_py() or "").encode("utf-8").split())
                scores = np.fromiter(map(memo.values.__getitem__, ids), float, len(ids))
                place = np.clip(((scores - LOWEST) / STEP).round().astype(int), 0, bins)
                out["label"].append(label.as_py())
                out["n"].append(len(ids))
                out["sums"].append(np.array([s for _, _, s in maximal_segments(scores)]).tobytes())
                out["bins"].append(np.bincount(place, minlength=bins + 1).astype("<i4").tobytes())
            return out

        return work

    seen = map_batches(drawn, scorer, {"label": "int", "n": "long", "sums": "binary", "bins": "binary"}).select("label", "n", "sums", "bins").toPandas()
    clean = seen[seen["label"] == 0]
    counts = sum((np.frombuffer(b, "<i4").astype(np.int64) for b in clean["bins"]), np.zeros(bins + 1, np.int64))
    model.lam = solve_lambda(LOWEST + STEP * np.arange(bins + 1), counts)
    best = np.array([np.frombuffer(s).max() if s else 0.0 for s in clean["sums"]])
    if len(best):
        model.log_k = float(np.mean(model.lam * best - np.log(np.maximum(clean["n"].to_numpy(), 1))) - np.euler_gamma)
    x = np.array([evidence(model, n, np.frombuffer(s)) for n, s in zip(seen["n"], seen["sums"])]).reshape(-1, 2)
    model.logistic = tuple(fit_logistic(np.log1p(x), seen["label"].to_numpy(float)))
    return model


def fit(rows: DataFrame, sample: int = SAMPLE) -> ToxicModel | None:
    model = count_features(rows)
    return None if model is None else calibrate(model, rows, rows.count(), sample)


def score_documents(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``_id``, ``score``, ``passages``): passages are the significant segments with first and last word, sum and expected equals."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("sum", pa.float64()), ("expected", pa.float64())]))

    def scorer():
        m = shared.value
        memo = None if m is None else WordTable(m.word_scores(None))

        def one(text: str | None):
            if memo is None:
                return 0.0, []
            ids = memo.ids((text or "").encode("utf-8").split())
            scores = np.fromiter(map(memo.values.__getitem__, ids), float, len(ids))
            segments = maximal_segments(scores)
            sums = np.array([s for _, _, s in segments])
            x = np.log1p(evidence(m, len(ids), sums))
            score = 1 / (1 + np.exp(-np.clip(m.logistic[0] + x @ np.array(m.logistic[1:]), -30, 30)))
            expected = np.exp(np.minimum(expected_log(m, len(ids), sums), 700))
            found = [
                {"first": f, "last": t, "sum": s, "expected": float(e)} for (f, t, s), e in zip(segments, expected) if e < SIGNIFICANT
            ]
            return float(score), found

        def work(batch) -> dict:
            rows = [one(t.as_py()) for t in batch.column("_text")]
            return {"score": [r[0] for r in rows], "passages": pa.array([r[1] for r in rows], passage)}

        return work

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_batches(rows, scorer, {"score": "double", "passages": "array<struct<first:bigint,last:bigint,sum:double,expected:double>>"})


def toxic_passages(scored: DataFrame) -> DataFrame:
    """One row per significant passage of ``score_documents``."""
    return scored.select("_id", F.explode("passages").alias("p")).select("_id", "p.*")


def detect_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_remainder: int = 1,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``, ``n_passages``."""
    model = fit(labelled_rows(docs, labels, id_col, text_col, label_col, held_out_remainder), sample)
    return score_documents(docs, model, id_col, text_col).select(
        F.col("_id").alias(id_col), F.coalesce(crc_of_id("_id") % 3 == held_out_remainder, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )
