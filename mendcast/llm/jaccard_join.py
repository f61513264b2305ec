"""Near-duplicate classes by an exact Jaccard join over word shingles: universe partition and pigeonhole.

Two sets of sizes a <= b that reach the threshold differ in at most H = (100 - t)(a + b) / (100 + t) elements. The universe of shingles
is hashed into segments, in number by size band; a set is the list of its non-empty segments. If a set names any
H + 1 of its segments, one of them is the same in every partner. So every set *indexes* its segments (one 64-bit number each
for what the segment holds), and the smaller set of a pair *probes* H + 1 of them, chosen by cost: first segments that no other
set shares, which cost nothing, then shared ones, rarest first. A set with H + 1 unshared segments is done: it has no
partner. This removes nearly every set before any pair is formed, also those that share a frequent passage.

Sets near the top of a band also probe the next band. Bands index only as many segments as leave a set ``SPARE`` above H + 1; should
a set still have too few non-empty ones, its band is indexed by single shingles as well, the finest partition there is (which
small sets use anyway). With single shingles every set has enough, so no deletion neighbourhood is ever the cheaper choice: one
would cost as many entries as the segment has elements, and a further segment costs one.

Candidates are verified on the whole sets. Sets that share a segment are first compared with the most central set among them and joined into
components; pairs inside one component need no comparison, and only pairs between components remain. For these the partition
is refined to single shingles, rarest first (``remaining_pairs``), so a group of k near copies costs about k comparisons. The result
is exact: every pair of sets that could link was compared or is already connected.

Defined results: a text without words has the empty set and is alone; fewer words than a shingle form one shingle; equal sets
are one set; null ids sort last and repeated rows share a class; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mendcast.layout import materialise
from mendcast.llm.common import mix64, portions, utf8

WORDS, PERCENT = 5, 75
FIRST_BAND, RATIO, SPARE, SPARE_SHARE = 64, 4, 16, 0.15
STEPS = 24
SCHEME_BITS = 5
STAR_ROUNDS = 2
PORTION = 1 << 21
WORD = r"[^\x20\x09-\x0D]"


def most_different(a: int, b: int, percent: int) -> int:
    return (100 - percent) * (a + b) // (100 + percent)


def largest_partner(a: int, percent: int) -> int:
    return 100 * a // percent


def band_of(n: int) -> int:
    """0 for sets that use single shingles, else 1, 2, ..."""
    band, edge = 0, FIRST_BAND
    while n >= edge:
        band, edge = band + 1, edge * RATIO
    return band


class Band:
    """Segments of one size band, and how many of them a set of given size indexes."""

    def __init__(self, band: int, percent: int):
        self.percent, self.scheme = percent, band
        self.low, self.high = FIRST_BAND * RATIO ** (band - 1), FIRST_BAND * RATIO**band
        wanted = self._wanted(self.high - 1)
        few, many = 1, 64 * self.high
        while few < many:
            mid = (few + many) // 2
            few, many = (few, mid) if mid * (1 - math.exp(-(self.high - 1) / mid)) >= wanted else (mid + 1, many)
        self.segments = few
        start = self.low * percent // 100
        self.edges = [start + int((self.high - start) * k / STEPS) for k in range(STEPS + 1)]
        self.limits, most = [], 0
        for left, right in zip(self.edges, self.edges[1:]):
            filled = 1 - math.exp(-max(left, 1) / self.segments)
            most = max(most, min(self.segments, math.ceil(self._wanted(max(right - 1, 1)) / filled)))
            self.limits.append(most)

    def need(self, n: int) -> int:
        top = largest_partner(n, self.percent)
        return most_different(n, min(top, self.high - 1) if n >= self.low else top, self.percent) + 1

    def _wanted(self, n: int) -> float:
        return (1 + SPARE_SHARE) * self.need(n) + SPARE

    def limit(self, n: int) -> int:
        """Segments 0 .. limit - 1 are indexed; never fewer for a larger set, so a smaller one's choice is always present."""
        return self.limits[min(STEPS - 1, max(0, np.searchsorted(self.edges, n, side="right") - 1))]

    def filled(self, tokens: np.ndarray) -> int:
        """How many of the indexed segments are not empty."""
        segment = (tokens % np.uint64(self.segments)).astype(np.int64)
        return int(np.count_nonzero(np.bincount(segment, minlength=self.segments)[: self.limit(len(tokens))]))

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        segment = tokens % np.uint64(self.segments)
        kept = segment < np.uint64(self.limit(len(tokens)))
        segment, tokens = segment[kept], tokens[kept]
        if not len(segment):
            return tokens
        order = np.sort(segment << np.uint64(32) | np.arange(len(segment), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        segment, held = segment[order], mix64(tokens[order] + np.uint64(1))
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        return self.tagged(mix64(np.add.reduceat(held, first) + mix64(segment[first] + np.uint64(1))))

    def tagged(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers << np.uint64(SCHEME_BITS)) | np.uint64(self.scheme)


class Schemes:
    def __init__(self, percent: int, single: tuple = ()):
        self.percent, self.single = percent, single
        self.bands: dict[int, Band] = {}

    def band(self, k: int) -> Band:
        if k not in self.bands:
            self.bands[k] = Band(k, self.percent)
        return self.bands[k]

    def uses_single(self, n: int) -> bool:
        """Whether a set is indexed by single shingles: it, or a smaller partner, belongs to a band that needs them."""
        smallest = -(-n * self.percent // 100)
        return any(k == 0 or k in self.single for k in range(band_of(smallest), band_of(n) + 1))

    def uses(self, n: int) -> list[tuple[int, int]]:
        """(scheme, number to probe) of a set of size n; 0 to probe where it is only looked up."""
        band, out = band_of(n), []
        if self.uses_single(n):
            probe = most_different(n, largest_partner(n, self.percent), self.percent) + 1
            out.append((0, probe if band == 0 or band in self.single else 0))
        if band:
            out.append((band, self.band(band).need(n)))
            if largest_partner(n, self.percent) >= self.band(band).high:
                out.append((band + 1, self.band(band + 1).need(n)))
        return out

    def total(self, scheme: int, tokens: np.ndarray) -> int:
        return self.band(scheme).filled(tokens) if scheme else len(tokens)

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """What a set is indexed by, under all schemes."""
        return np.concatenate([
            self.band(k).signatures(tokens) if k else mix64(tokens + np.uint64(7)) << np.uint64(SCHEME_BITS) for k, _ in self.uses(len(tokens))
        ])


#: Whether a byte of UTF-8 belongs to a word, and a number for it; A-Z count as a-z.
IN_WORD = np.array([b not in b" \t\n\v\f\r" for b in range(256)])
BYTE_HASH = mix64(np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], np.uint64) + np.uint64(1))


class Shingles:
    """``of(texts)``: the sorted distinct 64-bit shingles of every text of an Arrow column, a portion of the texts at a time."""

    def __init__(self, words: int):
        self.words = words

    def of(self, texts):
        for at, until in portions(texts, PORTION):
            yield from self._portion(utf8(texts.slice(at, until - at)))

    def hashes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word of texts that lie one after the other, and how many words come before each text and at the end."""
        worded = IN_WORD[data]
        first = worded.copy()
        first[1:] &= ~worded[:-1]
        begins = ends[:-1][ends[:-1] < ends[1:]]
        first[begins] = worded[begins]
        at = np.flatnonzero(first)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        held, byte = np.flatnonzero(worded), BYTE_HASH[data[worded]]
        begin = np.searchsorted(held, at)
        sizes = np.diff(begin, append=len(held))
        factors = mix64(np.arange(1, sizes.max() + 1, dtype=np.uint64)) | np.uint64(1)
        byte *= factors[np.arange(len(held)) - np.repeat(begin, sizes)]
        return mix64(np.add.reduceat(byte, begin)), np.searchsorted(at, ends)

    def _shingles(self, hashes: np.ndarray, width: int) -> np.ndarray:
        total = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k: k + len(total)]
        return mix64(total)

    def _portion(self, texts):
        import pyarrow as pa

        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            yield from (np.zeros(0, np.uint64) for _ in range(len(texts)))
            return
        hashes, bounds = self.hashes(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]: ends[-1]], ends - ends[0])
        whole, bounds = self._shingles(hashes, self.words), bounds.tolist()
        for at, until in zip(bounds, bounds[1:]):
            if until - at < self.words:
                yield self._shingles(hashes[at: until], until - at) if until > at else np.zeros(0, np.uint64)
            else:
                tokens = np.sort(whole[at: until - self.words + 1])
                yield tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))]


def set_key(tokens: np.ndarray) -> int:
    """64-bit identity of a set, 0 for the empty one. Of N sets about N * N / 2^65 pairs would be confused."""
    if not len(tokens):
        return 0
    total = np.add.reduce(mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True)
    return int(mix64(total ^ mix64(np.array([len(tokens)], np.uint64))).view(np.int64)[0])


def segments_and_facts(docs: DataFrame, schemes: Schemes, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two views of one stored table, made in a single pass over the texts.

    Segments: (``sig``, ``k``, ``cost``) of the indexed segments that at least two sets hold, ``cost`` = number of entries; a task gives
    equal sets once. Facts: a row per document with its id, text hash ``th``, set key ``k``, size ``n``, and for each scheme the entries
    and the number to probe; they travel with the entries under numbers of their own.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["id", "th", "k", "n", "scheme", "total", "probe"]
    numbers = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 3
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))

    def run(batches):
        shingles, seen, kind = Shingles(words), set(), None
        own = np.uint64(TaskContext.get().partitionId()) << np.uint64(40)
        for batch in batches:
            kind = pa.struct(list(zip(names, [batch.schema.field("_id").type, *numbers])))

            def entries(sigs, keys):
                sig, k = np.concatenate(sigs).view(np.int64), np.concatenate(keys)
                return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(k), pa.nulls(len(k), kind)], ["sig", "k", "fact"])

            sigs, keys, held, facts = [], [], 0, []
            for tokens in shingles.of(batch.column("_text")):
                key = set_key(tokens)
                uses = schemes.uses(len(tokens)) if len(tokens) else []
                facts.append((key, len(tokens), [k for k, _ in uses], [schemes.total(k, tokens) for k, _ in uses], [p for _, p in uses]))
                if not len(tokens) or key in seen:
                    continue
                seen.add(key)
                sig = schemes.signatures(tokens)
                sigs.append(sig)
                keys.append(np.full(len(sig), key))
                held += len(sig)
                if held > 200_000:
                    yield entries(sigs, keys)
                    sigs, keys, held = [], [], 0
            if held:
                yield entries(sigs, keys)
            if facts:
                columns = [batch.column("_id"), batch.column("_th"), *[pa.array(c, t) for c, t in zip(zip(*facts), numbers[1:])]]
                place = own + np.arange(len(facts), dtype=np.uint64)
                own += np.uint64(len(facts))
                sig = ((place << np.uint64(SCHEME_BITS)) | np.uint64((1 << SCHEME_BITS) - 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig), columns[2], pa.StructArray.from_arrays(columns, fields=list(kind))], ["sig", "k", "fact"])

    fact = f"struct<id:{dict(rows.dtypes)['_id']},th:bigint,k:bigint,n:bigint,scheme:array<int>,total:array<int>,probe:array<int>>"
    of_sig = W.partitionBy("sig").orderBy("k")
    whole = of_sig.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.lag("k").over(of_sig)
    stored = materialise(
        rows.mapInArrow(run, f"sig long, k long, fact {fact}")
        .withColumn("_low", F.first("k").over(whole)).withColumn("_high", F.last("k").over(whole))
        .withColumn("cost", F.count("*").over(whole)).withColumn("_again", F.coalesce(before == F.col("k"), F.lit(False)))
        .where(F.col("fact").isNotNull() | ((F.col("_low") != F.col("_high")) & ~F.col("_again")))
        .select("sig", "k", "cost", "fact")
    )
    return stored.where("fact IS NULL").select("sig", "k", "cost"), stored.where("fact IS NOT NULL").select("fact.*")


def chosen_members(shared: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored: (``sig``, ``k``, ``n``, ``total``, ``have``, ``central``, ``chosen``) of the segments that some set probes.

    A set probes its unshared segments first, so of the shared ones only as many are chosen as are still needed. ``have`` of its
    ``total`` segments are shared with some set.
    """
    rows = shared.withColumn("scheme", F.col("sig").bitwiseAND((1 << SCHEME_BITS) - 1).cast("int"))
    uses = (
        facts.select("k", "n", F.explode(F.arrays_zip("scheme", "total", "probe")).alias("u")).select("k", "n", "u.*")
        .dropDuplicates(["k", "scheme"])
    )
    per_set = rows.groupBy("k", "scheme").agg(F.count("*").alias("_shared")).join(uses, ["k", "scheme"])
    wanted = per_set.select(
        "k", "scheme", "n", "total", F.col("_shared").alias("have"), (F.col("_shared") / F.col("total")).alias("central"),
        F.when(F.col("probe") > 0, F.col("probe") - (F.col("total") - F.col("_shared"))).otherwise(0).alias("_wanted"), "probe",
    ).where((F.col("probe") == 0) | (F.col("_wanted") > 0)).drop("probe")  # the others have no partner, so they are none either
    cheapest = F.row_number().over(W.partitionBy("k", "scheme").orderBy("cost", "sig"))
    ranked = rows.join(wanted, ["k", "scheme"]).withColumn("chosen", cheapest <= F.col("_wanted"))
    probed = ranked.where("chosen").select("sig").distinct()
    return materialise(ranked.join(probed, "sig", "left_semi").select("sig", "k", "n", "total", "have", "central", "chosen"))


def needed_sets(docs: DataFrame, facts: DataFrame, members: DataFrame, words: int, text_col: str) -> DataFrame:
    """Stored: (``k``, ``tokens``) of every set in ``members``."""
    import pyarrow as pa

    texts = (
        docs.select(F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
        .groupBy(F.xxhash64("_text").alias("th")).agg(F.first("_text").alias("_text"))
    )
    wanted = facts.join(members.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min("th").alias("th"))

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            found = [tokens.tobytes() for tokens in shingles.of(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.binary())], ["k", "tokens"])

    return materialise(texts.join(wanted, "th").select("k", "_text").mapInArrow(run, "k long, tokens binary"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole sets reach the threshold."""
    import pyarrow as pa

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("k").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("k").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(``k``, ``label``): smallest key of the component of every linked key; smallest neighbour, then pointer jumping."""
    both = materialise(links.select(F.col("a").alias("k"), F.col("b").alias("o")).union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy("k").agg(F.least(F.min("o"), F.col("k")).alias("label")))
    while True:
        nearest = both.join(labels.select(F.col("k").alias("o"), F.col("label").alias("l")), "o").groupBy("k").agg(F.min("l").alias("l"))
        stepped = labels.join(nearest, "k").select("k", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("k").alias("label"), F.col("label").alias("j"))
        fresh = materialise(stepped.join(jump, "label").select("k", "old", F.least("label", "j").alias("label")))
        labels = fresh.select("k", "label")
        if fresh.where("label <> old").isEmpty():
            return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("k"))
    return members.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))


def _may_link(an: str, atotal: str, bn: str, bhave: str, percent: int):
    """Whether a set of size ``an`` with ``atotal`` segments may link to a larger one that shares ``bhave`` segments with anyone.

    Every segment of the smaller that the larger lacks is a difference, so all but H must be among those the larger shares.
    """
    different = F.floor((100 - percent) * (F.col(an) + F.col(bn)) / (100 + percent))
    return (F.col(an) <= F.col(bn)) & (100 * F.col(an) >= percent * F.col(bn)) & (F.col(atotal) - F.col(bhave) <= different)


def _pairs(rows: DataFrame, a: str, b: str, tried: DataFrame | None) -> DataFrame:
    pairs = rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def star_pairs(members: DataFrame, labels: DataFrame | None, tried: DataFrame | None, percent: int) -> DataFrame:
    """Each set with the most central set of the segments it shares with other components; one pair per set."""
    rows = _labelled(members, labels)
    pivots = (
        rows.groupBy("sig").agg(F.max(F.struct("central", "k", "n", "label", "total", "have")).alias("p"))
        .select("sig", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("k", "n", "label", "total", "have")])
    )
    linkable = _may_link("n", "total", "pn", "phave", percent) | _may_link("pn", "ptotal", "n", "have", percent)
    met = rows.join(pivots, "sig").where((F.col("label") != F.col("plabel")) & linkable)
    often = met.groupBy("k", "pk").agg(F.count("*").alias("c"))
    first = often.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("c"), "pk"))).where("r = 1")
    return _pairs(first, "k", "pk", tried)


CLASS_RATIO = 1.03


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_RATIO)).cast("int")


def remaining_pairs(members: DataFrame, sets: DataFrame, labels: DataFrame | None, tried: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of different components that share a segment and that single shingles do not rule out.

    Two sets that link share ``least`` shingles, so one of the first ``n - least + 1`` of either set, in any order, is among them.
    Of two components the smaller one asks, with its sets' rarest shingles first. A set just below the threshold to the centre of its
    group has that many shingles which hardly any other set holds, so it meets next to nobody, however large the group is. ``least`` grows
    with the partner's size: a question goes only to those classes of sizes for which it is early enough.
    """
    import pyarrow as pa

    def unfold(batches):
        for batch in batches:
            ids, labelled, tokens = batch.column("k").to_numpy(), batch.column("label").to_numpy(), [np.frombuffer(t.as_buffer(), np.int64) for t in batch.column("tokens")]
            for i in range(0, len(tokens), 1024):
                part = tokens[i: i + 1024]
                sizes = np.array([len(t) for t in part], np.int64)
                if sizes.sum():
                    columns = [np.repeat(ids[i: i + 1024], sizes), np.repeat(labelled[i: i + 1024], sizes), np.repeat(sizes, sizes), np.concatenate(part)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "label", "n", "token"])

    met = _labelled(members, labels)
    open_segments = met.groupBy("sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("sig")
    sets = sets.join(met.join(open_segments, "sig", "left_semi").select("k").distinct(), "k", "left_semi")
    rows = _labelled(sets, labels).select("k", "label", "tokens").mapInArrow(unfold, "k long, label long, n long, token long")
    sizes = _labelled(sets.select("k"), labels).groupBy("label").agg(F.count("*").alias("weight"))
    heavy = sizes.where("weight > 1")
    counted = rows.groupBy("token").agg(
        F.count("*").alias("df"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("token", "df")
    # only shingles that two components hold can be shared by a pair; the rest come first in every set's order and need no row
    met = rows.join(counted, "token")
    # a partner shares at least the threshold of either set
    enough = met.groupBy("k", "n").agg(F.count("*").alias("_shared")).where(100 * F.col("_shared") >= percent * F.col("n")).drop("n")
    held = materialise(
        met.join(enough, "k").join(heavy, "label", "left").withColumn("weight", F.coalesce("weight", F.lit(1))))
    place = F.row_number().over(W.partitionBy("k").orderBy("df", "token"))
    ranked = held.withColumn("place", F.col("n") - F.col("_shared") + place)

    def least(a, b):
        return F.ceil(percent * (a + b) / (100 + percent))

    smallest = F.ceil(F.col("n") * percent / 100)
    asked = ranked.where(F.col("place") <= F.col("n") - least(F.col("n"), smallest) + 1).select(
        "token", *[F.col(c).alias(f"a{c}") for c in ("k", "label", "n", "weight", "place")])
    there = held.select("token", "k", "label", "n", "weight", size_class(F.col("n")).alias("size"))
    classes = there.groupBy("token", "size").agg(F.min("n").alias("_n"), F.max(F.struct("weight", "label")).alias("_top"), F.max("n").alias("_most"))
    near = (F.col("aplace") <= F.col("an") - least(F.col("an"), F.col("_n")) + 1) & (100 * F.col("_most") >= percent * F.col("an")) & (
        100 * F.col("an") >= percent * F.col("_n")) & (F.struct(F.col("aweight").alias("weight"), F.col("alabel").alias("label")) < F.col("_top"))
    questions = asked.join(classes, "token").where(near).select("token", "size", "ak", "alabel", "an", "aweight", "aplace")
    a, b = F.col("an"), F.col("n")
    later = F.struct(F.col("aweight").alias("weight"), F.col("alabel").alias("label")) < F.struct("weight", "label")
    fits = (F.col("aplace") <= a - least(a, b) + 1) & (100 * F.least(a, b) >= percent * F.greatest(a, b))
    return _pairs(questions.join(there, ["token", "size"]).where(later & fits), "ak", "k", tried)


def near_duplicate_classes(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links)."""
    schemes = Schemes(percent)
    shared, facts = segments_and_facts(docs, schemes, words, id_col, text_col)
    lacking = F.exists(F.arrays_zip("scheme", "total", "probe"), lambda u: (u["scheme"] > 0) & (u["total"] < u["probe"]))
    sizes = facts.where(lacking).select(F.expr(f"int(floor(log({RATIO}, n / {FIRST_BAND}D))) + 1").alias("band")).distinct().collect()
    if sizes:  # a set with too few filled segments: its band is indexed by single shingles as well
        schemes = Schemes(percent, tuple(sorted({b for r in sizes for b in (r["band"] - 1, r["band"], r["band"] + 1)})))
        shared, facts = segments_and_facts(docs, schemes, words, id_col, text_col)
    members = chosen_members(shared, facts)
    labels = None
    if not members.isEmpty():
        sets = needed_sets(docs, facts, members, words, text_col)
        links = tried = None
        for turn in range(STAR_ROUNDS + 1):
            pairs = materialise(
                star_pairs(members, labels, tried, percent) if turn < STAR_ROUNDS else remaining_pairs(members, sets, labels, tried, percent))
            if pairs.isEmpty():
                continue
            found = materialise(verified(pairs, sets, percent))
            tried = pairs if tried is None else tried.union(pairs)
            if found.isEmpty():
                continue
            links = found if links is None else links.union(found)
            labels = components(links)
    classes = facts.groupBy("k").agg(F.min("id").alias("_least"))
    if labels is not None:
        classes = classes.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
        least = classes.groupBy("label").agg(F.min("_least").alias("component_id"))
        classes = classes.join(least, "label").select("k", "component_id")
    else:
        classes = classes.withColumnRenamed("_least", "component_id")
    return facts.join(classes, "k").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_class_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of every class, all columns kept. The stage form of the join.

    A row is known by its id and 128 bits of its text, so no numbered copy of the rows is stored; ``docs`` is read several times. Texts
    without words all stay. Of rows that repeat both id and text one stays, whichever its other columns are.
    """
    text = F.col(text_col)
    place = F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    view = docs.select(place.alias("place"), text.alias("text"))
    first = near_duplicate_classes(view, id_col="place", text_col="text").where((F.col("n_shingles") > 0) & (F.col("place") == F.col("component_id")))
    winners = materialise(first.groupBy("place").agg(F.count("*").alias("_n")))

    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(place.alias("_place"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("_worded"), F.struct(*[
        docs[c].alias(n) for c, n in zip(docs.columns, names)]).alias("_doc"))

    def rows_of(places: DataFrame) -> DataFrame:
        places = places.select(*[F.col(f"place.{c}").alias(f"_{c}") for c in ("no_id", "id", "h1", "h2")])
        same = [F.col(f"_place.{c}").eqNullSafe(F.col(f"_{c}")) for c in ("no_id", "id", "h1", "h2")]
        return keyed.where("_worded").join(places, same, "left_semi")

    kept = rows_of(winners.where("_n = 1")).select("_doc")
    repeated = winners.where("_n > 1")
    if not repeated.isEmpty():
        kept = kept.union(rows_of(repeated).groupBy("_place").agg(F.first("_doc").alias("_doc")).select("_doc"))
    return kept.union(keyed.where("NOT _worded").select("_doc")).select(*[F.col(f"_doc.{n}").alias(c) for n, c in zip(names, docs.columns)])
