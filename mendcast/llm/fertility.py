"""Quality rules: base counts of a text plus tokeniser fertility with rejection bands per language or script.

Every word is cut by a public vocabulary. Three measures describe how well the vocabulary fits a text: characters per
token, share of byte-fallback tokens, and token entropy relative to the entropy of as many different tokens. Over a whole text the
last falls with length, as words come back; so it is the mean over windows of ``WINDOW`` tokens that cover the whole text, of which
all texts expect the same. A text that only repeats itself over longer stretches is left to the base rule. Texts of one
group (their language, else their dominant script) give a centre and a spread (median and interquartile range) of each
measure over the whole table, from mergeable sketches. Short texts scatter more, so differences from the centre are scaled by
the root of the number of tokens (up to ``settled``) before the spread is taken. A text outside the band of centre plus or minus
``width`` spreads is rejected.
Byte fallback is rejected above its band only; both other measures on either side, but few characters per token and low
entropy are what junk shows.

Defined results: null text has no words and fails the base rule; groups with fewer than ``least`` documents that passed the
base rule have no band and reject nothing; an empty table gives an empty result; repeated rows count as rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mendcast.layout import materialise
from mendcast.llm.common import WordTable, attach_small, map_batches, numbered

STATS = {
    "lang": "string", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "script": "string", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double", "token_entropy": "double",
}
SYMBOLS = "#*$%&|<>"
WIDTH, SETTLED = 3.5, 4000
#: Tokens in a window of the entropy, and windows that are sorted at once.
WINDOW, AT_ONCE = 128, 4096
#: Least spread that is taken for real, in the scaled measure.
FLOOR = {"chars_per_token": 0.5, "fallback_share": 0.1, "token_entropy": 0.3}
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
#: First code point of each script's block and its name; a text belongs to the script that most of its letters fall in.
SCRIPTS = (
    (0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
    (0x900, "Indic"), (0xE00, "Thai"), (0x1100, "Hangul"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3400, "Han"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = ["Other"] + [n for _, n in SCRIPTS]


def repeated_trigram_words(ids: np.ndarray) -> int:
    """Words covered by three-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    _, small = np.unique(ids, return_inverse=True)
    n = np.int64(small.max() + 1)
    key = (small[:-2] * n + small[1:-1]) * n + small[2:] if n < 2_000_000 else None
    if key is None:
        _, pair = np.unique(small[:-1] * n + small[1:], return_inverse=True)
        key = pair[:-1] * n + small[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift: shift + len(key)] |= twice
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    seen, repeats = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.split(None, 1):
            seen.add(line)
    return repeats


def window_entropy(tokens: np.ndarray) -> float:
    """Mean entropy of windows of ``WINDOW`` tokens, each relative to that of as many different tokens.

    Windows follow one another; where the last is short, it starts earlier and ends with the text. A shorter text is one window.
    """
    n = len(tokens)
    if n < 2:
        return 0.0
    width = min(n, WINDOW)
    whole = tokens[: n - n % width].reshape(-1, width)
    parts = [whole[i: i + AT_ONCE] for i in range(0, len(whole), AT_ONCE)] + ([tokens[None, -width:]] if n % width else [])
    lost = 0.0
    for part in parts:
        ranked = np.sort(part, axis=1)
        first = np.ones(ranked.shape, bool)
        first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        counts = np.diff(np.append(np.flatnonzero(first), first.size))
        lost += float((counts * np.log(counts)).sum())
    return 1.0 - lost / (sum(map(len, parts)) * width * np.log(width))


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[(points > 0x7F) | ((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A)]
    if not len(points):
        return "none"
    counts: dict[str, int] = {}
    for place, n in enumerate(np.bincount(np.searchsorted(STARTS, points, side="right"), minlength=len(NAMES))):
        counts[NAMES[place]] = counts.get(NAMES[place], 0) + int(n)
    return max(counts, key=lambda k: (counts[k], k))


def measurer(vocabulary: str):
    """Work of one task: a batch with ``_text`` and ``_lang`` to the columns of ``STATS``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])

    def cut(words: list[bytes]) -> list[bytes]:
        pieces = model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        return [np.array(p, "<u2").tobytes() for p in pieces]

    memo = WordTable(cut)

    def one(text: str, lang: str | None) -> tuple:
        data = text.encode("utf-8")
        words = data.split()
        ids = memo.ids(words)
        joined = b"".join(words)
        chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
        tokens = np.frombuffer(b"".join(map(memo.values.__getitem__, ids)), "<u2")
        n = len(tokens)
        fallback = float(is_byte[tokens].mean()) if n > 1 else 0.0
        return (
            lang, len(words), chars, sum(map(data.count, SYMBOLS.encode())), repeated_lines(data), repeated_trigram_words(ids),
            script_of(text), n, chars / n if n else 0.0, fallback, window_entropy(tokens),
        )

    def work(batch) -> dict:
        texts, langs = batch.column("_text"), batch.column("_lang")
        rows = [one(t.as_py() or "", g.as_py()) for t, g in zip(texts, langs)]
        return dict(zip(STATS, zip(*rows))) if rows else {c: [] for c in STATS}

    return work


def text_measures(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    return map_batches(rows, lambda: measurer(vocabulary), STATS)


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


#: Width of a histogram cell: what bands are rounded to.
CELL = 1e-4


def quantiles(rows: DataFrame, measures: dict[str, Column], probs: dict[str, float]) -> DataFrame:
    """``_group, _n`` and a column ``{measure}_{name}`` for each measure and probability.

    Values are counted in cells of ``CELL``: whole numbers that add up to the same however rows are dealt out, so the bands do not
    depend on partitions or retries. Counts are combined before the shuffle; a window sees the cells of one group and measure.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.round(v / CELL).cast("long").alias("cell")) for m, v in measures.items()])
    cells = rows.select("_group", F.explode(pairs).alias("_p")).groupBy("_group", "_p.m", "_p.cell").agg(F.count("*").alias("c"))
    order = W.partitionBy("_group", "m").orderBy("cell")
    upto = F.sum("c").over(order)
    counted = cells.withColumn("upto", upto).withColumn("n", F.sum("c").over(W.partitionBy("_group", "m")))
    found = [
        F.min(F.when((F.col("m") == m) & (F.col("upto") >= F.ceil(p * F.col("n"))), F.col("cell") * CELL)).alias(f"{m}_{name}")
        for m in measures for name, p in probs.items()
    ]
    return counted.groupBy("_group").agg(F.max("n").alias("_n"), *found)


def fertility_bands(stats: DataFrame, least: int, settled: int) -> DataFrame:
    """Stored: centre and spread of every measure per group, over the documents that passed the base rule."""
    passed = stats.where(~F.col("base_failed"))
    centres = materialise(quantiles(passed, {m: F.col(m) for m in MEASURES}, {"centre": 0.5}).where(F.col("_n") >= least))
    quarters = quantiles(attach_small(passed, centres, ["_group"], "_id"), {m: scaled(m, settled) for m in MEASURES}, {"low": 0.25, "high": 0.75})
    spread = [(F.col(f"{m}_high") - F.col(f"{m}_low")).alias(f"{m}_spread") for m in MEASURES]
    return materialise(centres.join(quarters.select("_group", *spread), "_group"))


def scaled(m: str, settled: int) -> Column:
    return (F.col(m) - F.col(f"{m}_centre")) * F.sqrt(F.least(F.col("n_tokens"), F.lit(settled)))


def fertility_quality(
    docs: DataFrame, vocabulary: str, width: float = WIDTH, least: int = 20, settled: int = SETTLED,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per document: id, base counts, measures, ``base_failed``, ``verdict`` (why it goes, null if kept), ``kept``."""
    stats = materialise(text_measures(docs, vocabulary, id_col, text_col, lang_col)).withColumn("base_failed", base_failed()).withColumn(
        "_group", F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script"))
    )
    bands = fertility_bands(stats, least, settled)
    reach = {m: F.lit(width) * F.greatest(f"{m}_spread", F.lit(FLOOR[m])) for m in MEASURES}
    below = {m: scaled(m, settled) < -reach[m] for m in MEASURES}
    above = {m: scaled(m, settled) > reach[m] for m in MEASURES}
    verdict = F.coalesce(
        F.when(F.col("base_failed"), F.lit("base rule")),
        F.when(below["chars_per_token"], F.lit("few characters per token")),
        F.when(above["chars_per_token"], F.lit("many characters per token")),
        F.when(above["fallback_share"], F.lit("byte fallback")),
        F.when(below["token_entropy"], F.lit("low token entropy")),
    )
    return (
        attach_small(stats, bands, ["_group"], "_id", "left").withColumn("verdict", verdict)
        .select(
            F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.col("verdict").isNull().alias("kept"), "verdict", F.col("_group").alias("band_group"), "n_tokens", *MEASURES,
        )
    )


def keep_fertile(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected ones, all columns kept. The stage form of ``fertility_quality``."""
    stored = numbered(docs)
    view = stored.select("_row", F.col(f"_doc.{text_col}").alias("text"), F.col(f"_doc.{lang_col}").alias("lang"))
    kept = fertility_quality(view, vocabulary, id_col="_row").where("kept").select("_row")
    return stored.join(kept, "_row", "left_semi").select("_doc.*")
