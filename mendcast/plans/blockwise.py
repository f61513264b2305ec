"""User functions over blocks of a series, with the state of the blocks before.

A function sees one block at a time. What it needs from the rest of the series travels as a state, a short list of numbers: every block is
summarised once, the states of a series (one short row per block) are merged in order, and each block gets the state of all
blocks before it and that of the whole series. ``merge`` must be associative; it is called in series order. No task holds a series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from mendcast.layout import BLOCK, add_block

State = Sequence[float]


@dataclass(frozen=True)
class Place:
    """Where a block lies: its first position, the length of the series, and the merged states (``before`` is None in the first block)."""

    start: int
    n: int
    before: list[float] | None
    total: list[float]


@dataclass(frozen=True)
class BlockMethod:
    """``summary(values)``, ``merge(left, right)`` and ``apply``.

    ``apply(values, rate, seed, place)`` for masks, ``apply(values, place)`` for repairs, ``apply(total, h)`` for forecasters.
    """

    summary: Callable[[np.ndarray], State]
    merge: Callable[[State, State], State]
    apply: Callable


@dataclass(frozen=True)
class MergedMetric:
    """``update(t, p)`` gives the state of some pairs, ``merge`` joins two, ``finish(state, train)`` is the metric.

    ``train`` (``summary`` and ``merge`` of a ``BlockMethod``) summarises the training series in order; without it ``train`` is None.
    """

    update: Callable[[np.ndarray, np.ndarray], State]
    merge: Callable[[State, State], State]
    finish: Callable[[State, State | None], float | None]
    train: BlockMethod | None = None


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def nullable(df: DataFrame) -> StructType:
    """The schema of ``df`` for a function that may return missing values."""
    return StructType([StructField(f.name, f.dataType, True) for f in df.schema])


def _same(keys: Sequence[str], left: str, right: str):
    """Equal key parts; missing ones match missing ones."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out


def _flat(lists):
    """The elements of an Arrow list column, and for every list where it starts and ends among them."""
    import pyarrow as pa

    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return lists.flatten(), ends


def _in_order(lists, by: str):
    """The same with the structs of every list in order of their field ``by``: ``(fields, starts and ends)``."""
    import pyarrow as pa

    rows, ends = _flat(lists)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = pa.array(np.lexsort((rows.field(by).to_numpy(zero_copy_only=False), owner)))
    return {f.name: rows.field(i).take(order) for i, f in enumerate(rows.type)}, ends


def _doubles(column) -> np.ndarray:
    """An array of its own; missing values are NaN."""
    return np.array(column.to_numpy(zero_copy_only=False), dtype=float)


def _state(values) -> list[float]:
    return [float(v) for v in values]


def packed_rows(rows: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "_rows") -> DataFrame:
    """One row per group with its rows as a list of structs: what a task reads at once are many short groups or a few long ones."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct(*[F.col(c) for c in columns])).alias(name))


def block_states(points: DataFrame, keys: Sequence[str], method: BlockMethod, block: int = BLOCK) -> DataFrame:
    """``keys, block, n, state``: one row per block."""
    import pyarrow as pa

    by = [*keys, "block"]

    def summarise(batches):
        for batch in batches:
            rows, ends = _in_order(batch.column("_rows"), "pos")
            values = _doubles(rows["value"])
            states = [_state(method.summary(values[a:b])) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in by], pa.array(np.diff(ends)), pa.array(states, pa.list_(pa.float64()))], [*by, "n", "state"])

    rows = add_block(points.select(*keys, "pos", F.col("value").cast("double").alias("value")), block)
    return packed_rows(rows, by, ["pos", "value"]).mapInArrow(summarise, f"{_schema(points, keys)}, block bigint, n bigint, state array<double>")


def _series(batch, method: BlockMethod):
    """For every series of packed block states: its blocks, length, the states before each block, and the whole state."""
    blocks, ends = _in_order(batch.column("_blocks"), "block")
    states, n = blocks["state"].to_pylist(), blocks["n"].to_numpy()
    for a, b in zip(ends, ends[1:]):
        before, held = [], None
        for s in states[a:b]:
            before.append(held)
            held = s if held is None else _state(method.merge(list(held), s))
        yield blocks["block"][a:b], int(n[a:b].sum()), before, held


def series_states(points: DataFrame, keys: Sequence[str], method: BlockMethod, block: int = BLOCK) -> DataFrame:
    """``keys, n, state`` of whole series."""
    import pyarrow as pa

    keys = list(keys)

    def fold(batches):
        for batch in batches:
            found = [(n, total) for _, n, _, total in _series(batch, method)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
                [*keys, "n", "state"])

    packed = packed_rows(block_states(points, keys, method, block), keys, ["block", "n", "state"], "_blocks")
    return packed.mapInArrow(fold, f"{_schema(points, keys)}, n bigint, state array<double>")


def running_states(points: DataFrame, keys: Sequence[str], method: BlockMethod, block: int = BLOCK) -> DataFrame:
    """``keys, block, n, before, total``: for each block the states of the blocks before it and of the series."""
    import pyarrow as pa

    keys = list(keys)

    def scan(batches):
        for batch in batches:
            at, blocks, n, before, total = [], [], [], [], []
            for i, (own, length, earlier, whole) in enumerate(_series(batch, method)):
                at += [i] * len(own)
                blocks += own.to_pylist()
                n += [length] * len(own)
                before += earlier
                total += [whole] * len(own)
            at, states = pa.array(at, pa.int64()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in keys], pa.array(blocks, pa.int64()), pa.array(n, pa.int64()), pa.array(before, states),
                 pa.array(total, states)], [*keys, "block", "n", "before", "total"])

    schema = f"{_schema(points, keys)}, block bigint, n bigint, before array<double>, total array<double>"
    packed = packed_rows(block_states(points, keys, method, block), keys, ["block", "n", "state"], "_blocks")
    return packed.mapInArrow(scan, schema)


def change_groups(packed: DataFrame, out: StructType, change: Callable, order: str = "pos") -> DataFrame:
    """The rows of ``packed_rows`` with a new ``value``: ``change(rows of a group, row number in the batch, batch)`` returns it in their order.

    A task turns a whole batch into columns once; a group is a slice of them.
    """
    import pyarrow as pa

    names = out.names

    def run(batches):
        for batch in batches:
            rows, ends = _in_order(batch.column("_rows"), order)
            frame = pd.DataFrame({c: v.to_pandas() for c, v in rows.items() if c != "value"})
            frame["value"] = _doubles(rows["value"])
            new = [np.asarray(change(frame.iloc[a:b].reset_index(drop=True), i, batch), dtype=float) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
            value = np.concatenate(new) if new else np.zeros(0)
            rows["value"] = pa.array(value, mask=np.isnan(value)).cast(rows["value"].type, safe=False)
            yield pa.RecordBatch.from_arrays([rows[c] for c in names], names)

    return packed.mapInArrow(run, out)


def over_blocks(rows: DataFrame, keys: Sequence[str], method: BlockMethod, change: Callable, block: int = BLOCK) -> DataFrame:
    """``rows`` with the column ``value`` that ``change(block rows, place)`` returns, block by block."""
    by = [*keys, "block"]

    def work(part: pd.DataFrame, i: int, batch) -> np.ndarray:
        n, before, total = (batch.column(c)[i].as_py() for c in ("n", "before", "total"))
        return change(part, Place(int(part["pos"].iloc[0]), n, before, total))

    states = running_states(rows, keys, method, block).alias("s")
    packed = packed_rows(add_block(rows, block), by, rows.columns).alias("b")
    joined = packed.join(states, _same(by, "b", "s")).select("b._rows", "s.n", "s.before", "s.total")
    return change_groups(joined, nullable(rows), work)


HELD = 4096
TASKS = 1024


def merged_metrics(pairs: DataFrame, by: Sequence[str], metrics: dict[str, MergedMetric], train: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """``by`` and a column per metric: states per task, merged in groups of tasks and then for each configuration."""
    import pyarrow as pa

    by, names = list(by), list(metrics)
    states = ", ".join(f"`{m}` array<double>" for m in names)
    kind = pa.list_(pa.float64())

    def joined(a, b):
        return {m: _state(metrics[m].merge(a[m], b[m])) for m in names}

    def batch_of(keys, held: list[dict]):
        return pa.RecordBatch.from_arrays([*keys, *[pa.array([h[m] for h in held], kind) for m in names]], [*by, *names])

    def partial(batches):
        held: dict = {}

        def rows():
            keys = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            return batch_of(keys, list(held.values()))

        for batch in batches:
            types = [batch.column(k).type for k in by]
            codes = [batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for k in by]
            order = np.lexsort(codes)
            new = np.zeros(len(order), bool)
            new[:1] = True
            for c in codes:
                new[1:] |= c[order][1:] != c[order][:-1]
            starts = np.flatnonzero(new)
            t, p = (_doubles(batch.column(c))[order] for c in ("t", "p"))
            keys = zip(*[batch.column(k).take(pa.array(order[starts])).to_pylist() for k in by])
            for key, a, b in zip(keys, starts, [*starts[1:], len(order)]):
                state = {m: _state(metrics[m].update(t[a:b], p[a:b])) for m in names}
                held[key] = joined(held[key], state) if key in held else state
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def merge(batches):
        for batch in batches:
            parts, ends = _flat(batch.column("_parts"))
            found, out = {m: parts.field(m).to_pylist() for m in names}, []
            for a, b in zip(ends, ends[1:]):
                total = {m: found[m][a] for m in names}
                for i in range(a + 1, b):
                    total = joined(total, {m: found[m][i] for m in names})
                out.append(total)
            yield batch_of([batch.column(k) for k in by], out)

    keyed = _schema(pairs, by)
    parts = pairs.select(*by, "t", "p").mapInArrow(partial, f"{keyed}, {states}")
    parts = parts.withColumn("_tasks", F.expr(f"spark_partition_id() div {TASKS}"))
    parts = packed_rows(parts, [*by, "_tasks"], names, "_parts").mapInArrow(merge, f"{keyed}, {states}")
    totals = packed_rows(parts, by, names, "_parts").mapInArrow(merge, f"{keyed}, {states}")
    histories = []
    for m in names:
        if train is not None and metrics[m].train is not None:
            found = series_states(train, ["series_id"], metrics[m].train, block)
            totals = totals.join(found.select("series_id", F.col("state").alias(f"_train_{m}")), "series_id", "left")
            histories.append(m)

    def finish(frames):
        for pdf in frames:
            out = pdf[by].copy()
            for m in names:
                past = pdf[f"_train_{m}"] if m in histories else [None] * len(pdf)
                values = [metrics[m].finish(list(s), None if h is None else list(h)) for s, h in zip(pdf[m], past)]
                out[m] = pd.Series(values, index=pdf.index, dtype=float)
            yield out

    return totals.mapInPandas(finish, keyed + "".join(f", `{m}` double" for m in names))
