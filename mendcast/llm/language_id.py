"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters counts as a space, and n-grams of one to three characters fall into a fixed number
of hash buckets. Document frequencies come from every row that may be learned from; they are at most ``BUCKETS`` counts. The
weights are fitted by follow-the-regularised-leader with elastic-net penalties on a sample of labelled rows that holds
``SAMPLE`` documents in expectation whatever the input size (rows are drawn by a hash of their id). Of a language that would get
fewer than ``LEAST`` of them, ``LEAST`` are drawn in expectation, or all if it has no more, so the sample holds at most
``SAMPLE`` + ``LEAST`` for each language in expectation. Every fifth row of a language is left out of the fit and sets the
temperature that turns scores into probabilities.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled text every text is; rows with
a null language teach nothing; ties go to the first language in order; repeated rows count as rows; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mendcast.llm.common import crc_of_id, map_batches

BUCKETS = 1 << 16
SAMPLE, LEAST = 8000, 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.001
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def letter_table() -> np.ndarray:
    """For every code point below 65,536 its lower-case form, or a space if it is no letter."""
    table = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


class Grams:
    """``counts(text)``: (buckets, counts) of a text's n-grams, or None if it has no letter."""

    def __init__(self):
        self.table = letter_table()

    def counts(self, text: str | None):
        points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        if not len(points):
            return None
        if points.max() >> 16:
            high = points >> 16 > 0
            letters = np.array([chr(p).isalpha() for p in points[high]])
            kept = np.where(letters, points[high], 32)
            points = self.table[np.where(high, 32, points)]
            points[high] = kept
        else:
            points = self.table[points]
        if not (points != 32).any():
            return None
        blank = points == 32
        points = points[~(blank & np.concatenate(([False], blank[:-1])))] * np.uint32(2654435761)
        one = points ^ (points >> np.uint32(15))
        two = (points[:-1] * np.uint32(31) + points[1:]) * np.uint32(2246822519)
        three = (two[:-1] + points[2:] * np.uint32(97)) * np.uint32(3266489917)
        buckets = np.concatenate([one >> np.uint32(16), two >> np.uint32(16), three >> np.uint32(16)])
        counts = np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        return at, counts[at]


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out_remainder: int) -> DataFrame:
    return docs.where((crc_of_id(id_col) % 4 != held_out_remainder) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    )


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket over all rows: every task adds up its own texts and sends at most ``BUCKETS`` counts."""
    import pyarrow as pa

    def count(batches):
        grams, seen, n = Grams(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("_text"):
                found = grams.counts(text.as_py())
                if found is not None:
                    seen[found[0]] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([n, *seen[at]], pa.int64())], ["bucket", "n"])

    sums = rows.select("_text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequencies = np.zeros(BUCKETS, np.int64)
    inner = sums[sums["bucket"] >= 0]
    frequencies[inner["bucket"].to_numpy()] = inner["n"].to_numpy()
    return frequencies, int(sums.loc[sums["bucket"] < 0, "n"].sum())


def ftrl(xs: list, ys: list[int], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader; each example touches only its own buckets."""
    z = np.zeros((n_classes, BUCKETS))
    n = np.zeros((n_classes, BUCKETS))

    def weights(at):
        zs = z[:, at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2))

    for _ in range(epochs):
        for (at, x), y in zip(xs, ys):
            w = weights(at)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * x
            old = n[:, at]
            new = old + g * g
            z[:, at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[:, at] = new
    return weights(np.arange(BUCKETS))


def best_temperature(scores: np.ndarray, ys: np.ndarray) -> float:
    """Golden-section search for the temperature with the least log loss."""
    if not len(ys):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(ys)), ys]).mean())

    low, high, cut = -3.0, 3.0, (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def drawn_sample(rows: DataFrame, n: int, sample: int, least: int = LEAST) -> DataFrame:
    """Rows of the sample out of ``n``: the same share of every language, raised to ``least`` rows in expectation."""
    if n <= sample:
        return rows
    share = {r["_lang"]: min(1.0, max(sample / n, least / r["count"])) for r in rows.groupBy("_lang").count().collect()}
    limits = F.create_map(*[F.lit(x) for lang, part in share.items() for x in (lang, int(part * (1 << 30)))])
    return rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < limits[F.col("_lang")])


def fit(rows: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Fits on ``rows`` (``_id``, ``_text``, ``_lang``); the sample is trained on in one task of bounded size."""
    import pyarrow as pa

    frequencies, n = document_frequencies(rows)
    if not n:
        return None
    idf = np.log((1.0 + n) / (1.0 + frequencies)) + 1.0
    drawn = drawn_sample(rows, n, sample)

    def train(batches):
        grams, xs, ys, keys = Grams(), [], [], []
        for batch in batches:
            for key, text, lang in zip(batch.column("_id"), batch.column("_text"), batch.column("_lang")):
                found = grams.counts(text.as_py())
                if found is not None:
                    keys.append(key.as_py() or "")
                    xs.append((found[0], weighed(*found, idf)))
                    ys.append(lang.as_py())
        order = sorted(range(len(ys)), key=lambda i: (np.uint32(hash_text(keys[i])), keys[i], ys[i]))
        languages = sorted(set(ys))
        number = {c: i for i, c in enumerate(languages)}
        held, used, met = [], [], dict.fromkeys(languages, 0)
        for i in order:
            met[ys[i]] += 1
            (used if met[ys[i]] % 5 else held).append(i)
        w = ftrl([xs[i] for i in used], [number[ys[i]] for i in used], max(len(languages), 1))
        scores = np.array([w[:, xs[i][0]] @ xs[i][1] for i in held]).reshape(len(held), -1)
        t = best_temperature(scores, np.array([number[ys[i]] for i in held], int))
        for k, lang in enumerate(languages):
            at = np.flatnonzero(w[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([at.astype(np.int32).tobytes()]), pa.array([w[k][at].tobytes()]), pa.array([t])],
                ["lang", "at", "weight", "temperature"],
            )

    fitted = drawn.repartition(1).mapInArrow(train, "lang string, at binary, weight binary, temperature double").collect()
    fitted.sort(key=lambda r: r["lang"])
    weights = np.zeros((BUCKETS, len(fitted)))
    for k, r in enumerate(fitted):
        weights[np.frombuffer(r["at"], np.int32), k] = np.frombuffer(r["weight"])
    return LanguageModel([r["lang"] for r in fitted], idf, weights, fitted[0]["temperature"]) if fitted else None


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8"))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str, text_col: str) -> DataFrame:
    """(``_id``, ``lang_pred``, ``score``) from texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predictor():
        grams, m = Grams(), shared.value

        def one(text):
            found = grams.counts(text) if m is not None else None
            if found is None:
                return UNDETERMINED, 0.0
            s = weighed(*found, m.idf) @ m.weights[found[0]] / m.temperature
            best = int(s.argmax())
            return m.languages[best], float(1.0 / np.exp(s - s[best]).sum())

        def work(batch) -> dict:
            rows = [one(t.as_py()) for t in batch.column("_text")]
            return {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]}

        return work

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_batches(rows, predictor, {"lang_pred": "string", "score": "double"})


def identify_language(
    docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_remainder: int = 2
) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``."""
    model = fit(learnable(docs, id_col, text_col, lang_col, held_out_remainder), sample)
    return predict(docs, model, id_col, text_col).select(
        F.col("_id").alias(id_col), F.coalesce(crc_of_id("_id") % 4 == held_out_remainder, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
