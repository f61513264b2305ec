"""Small helpers that several of these operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mendcast.layout import attach_salted, materialise

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACE, " ")


#: Bytes of UTF-8 text to lower-cased terms: ASCII letters, digits and everything beyond ASCII stay, the rest separates.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def ascii_terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(TERM_BYTES).split()


def utf8(column):
    """The bytes of an Arrow column of strings."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def crc_of_id(name: str = "doc_id") -> Column:
    """Hash of a row's id that decides whether the row may be learned from."""
    return F.crc32(F.col(name).cast("string"))


SMALL = 10_000


def attach_small(rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: str, how: str = "inner") -> DataFrame:
    """Joins a stored table with one short row per group, without sending a group to one task.

    Up to ``SMALL`` rows are broadcast, counted first; beyond that hot groups are salted (``facts`` then holds their sizes as ``_n``).
    """
    if facts.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(facts), keys, how)
    if how == "left":
        lone = rows.join(facts.select(*keys), keys, "left_anti")
        return attach_salted(rows, facts, keys, spread_by).unionByName(lone, allowMissingColumns=True)
    return attach_salted(rows, facts, keys, spread_by)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def portions(column, most: int):
    """(from, to) of the rows of an Arrow column of strings that together have at most ``most`` bytes, or are one row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, until
        at = until


def numbered(docs: DataFrame) -> DataFrame:
    """Stored: ``_row``, a number for every row, and ``_doc``, all columns of the row, whatever their names."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc")))


class WordTable:
    """Bounded memo from words to small integers with one derived value per word.

    ``ids(words)`` numbers the words; ``make(new_words)`` is called once for words not seen since the last reset and
    returns one value for each. The memo is emptied when it exceeds ``limit`` words, so a worker's memory is bounded.
    """

    def __init__(self, make, limit: int = 400_000):
        self.make, self.limit = make, limit
        self.index: dict = {}
        self.values: list = []

    def ids(self, words: list) -> np.ndarray:
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        if len(index) > self.limit:
            index.clear()
            self.values.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in index]
        self.values.extend(self.make(fresh))
        index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def shared_files(path: str):
    """(file system, path) of a folder that all executors see, for files that Spark has no writer for."""
    from pyarrow import fs

    scheme, sep, rest = path.partition("://")
    if sep and scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


#: Arrow types by the names that Spark uses in schema strings.
ARROW = {"long": "int64", "int": "int32", "double": "float64", "string": "string", "boolean": "bool", "binary": "binary"}


def map_batches(rows: DataFrame, make, derived: dict[str, str]) -> DataFrame:
    """``_id`` of every row unchanged, with derived columns.

    ``make()`` runs once per task and returns a function from an Arrow batch to one list or array for each derived column.
    """
    import pyarrow as pa

    kind = dict(rows.dtypes)["_id"]

    def run(batches):
        work = make()
        for batch in batches:
            found = work(batch)
            arrays = [pa.array(found[c], pa.type_for_alias(ARROW[t])) if t in ARROW else found[c] for c, t in derived.items()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_id")), *arrays], ["_id", *derived])

    return rows.mapInArrow(run, ", ".join([f"_id {kind}"] + [f"{c} {t}" for c, t in derived.items()]))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
