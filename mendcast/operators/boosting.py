"""Boosted trees on lag features, a model of its own for every series, grown for all series together.

Squared loss, trees grown level by level from histograms of residuals. A histogram cell is keyed by (series, node, feature, bin) and holds a
sum of residuals and a count, so cells of different blocks add up and the best split of every node of every series follows from one
aggregation per tree level. Points travel as packed blocks, one row per series and block with ``lag`` values before it; what is shuffled are
cells and splits, never points. A series that lies in one block is the case in which all its cells come from one row: its levels and
trees follow one another inside the task, many series at a time. Both ways call the same functions for cells, splits and routing.

A split compares a lag with a cut point; cut points lie halfway between the values of the series at evenly spaced ranks, exact at any length. Equal gains
go to the nearest lag and the lowest cut, with a tolerance far above the rounding of sums, so blocks and order do not matter.
A series with validation points keeps the trees up to its lowest validation loss (``patience`` trees without a better one end it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mendcast.layout import BLOCK, assign_positions, config_keys, delete_stored, materialise, new_table_path, scratch_run, with_halo

#: Rows, and series times the bins that they use, that one task boosts together.
TOGETHER_ROWS, TOGETHER_BINS = 1 << 19, 1 << 12
#: Nodes of trees that one task follows together.
TOGETHER_NODES = 1 << 21
#: A split must lower the squared error by this share of that of the mean; equal gains differ by less than this share.
LEAST_GAIN, ROUNDING, TIE = 1e-20, 1e-13, 1e-9


@dataclass(frozen=True)
class Params:
    lag: int = 10
    trees: int = 100
    depth: int = 6
    lr: float = 0.1
    bins: int = 64
    reg: float = 1.0
    patience: int = 10

    def __post_init__(self):
        if self.lag < 1 or self.trees < 1 or self.depth < 1 or not 2 <= self.bins <= 256 or self.reg < 0:
            raise ValueError("lag, trees and depth from 1, 2 to 256 bins and a penalty from 0 are required")


# ---- what one task does with packed rows -----------------------------------------------------------

def cut_points(ordered: np.ndarray, bins: int) -> np.ndarray:
    """Middles between the distinct values at ``bins`` evenly spaced ranks of an ordered sample."""
    if not len(ordered):
        return ordered
    at = np.unique(ordered[np.arange(bins) * (len(ordered) - 1) // (bins - 1)])
    return (at[:-1] + at[1:]) / 2


def lag_rows(values: np.ndarray, halo: int, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets of a block that have a complete history, their lags (nearest first) and their places."""
    if len(values) <= lag:
        return np.zeros(0), np.zeros((0, lag)), np.zeros(0, np.int64)
    window = np.lib.stride_tricks.sliding_window_view(values, lag + 1)
    place = np.arange(lag, len(values))
    whole = (place >= halo) & ~np.isnan(window).any(axis=1)
    return window[whole, lag], window[whole, :lag][:, ::-1], place[whole]


def cells(slot: np.ndarray, binned: np.ndarray, residual: np.ndarray, n_slots: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of residuals and counts per (slot, feature, bin)."""
    shape = n_slots, binned.shape[1], bins
    g, h = np.zeros(shape), np.zeros(shape)
    for f in range(binned.shape[1]):
        key = slot * bins + binned[:, f]
        g[:, f] = np.bincount(key, residual, n_slots * bins).reshape(n_slots, bins)
        h[:, f] = np.bincount(key, minlength=n_slots * bins).reshape(n_slots, bins)
    return g, h


def best_splits(g: np.ndarray, h: np.ndarray, reg: float, error: np.ndarray):
    """Per slot: whether to split, feature, cut, and the values of the node and its two children."""
    total, n = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    left, left_n = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    right, right_n = total[:, None, None] - left, n[:, None, None] - left_n
    share = np.divide(total**2, n + reg, out=np.zeros(len(n)), where=n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left_n > 0) & (right_n > 0), left**2 / (left_n + reg) + right**2 / (right_n + reg), -np.inf).reshape(len(n), -1)
    top = gain.max(axis=1)
    pick = np.argmax(gain >= (top - TIE * np.abs(top))[:, None], axis=1)
    feature, cut = np.divmod(pick, h.shape[2] - 1)
    at = np.arange(len(n)), feature, cut
    values = [np.divide(a, b + reg, out=np.zeros(len(n)), where=b > 0) for a, b in ((total, n), (left[at], left_n[at]), (right[at], right_n[at]))]
    return top - share > LEAST_GAIN * error + ROUNDING * share, feature, cut, values


class Tree:
    """Complete binary trees of several series: node 0 is the root, the children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, series: int, depth: int):
        nodes = 2 ** (depth + 1) - 1
        self.feature, self.cut = np.full((series, nodes), -1, np.int16), np.zeros((series, nodes), np.int16)
        self.value = np.zeros((series, nodes))

    def split(self, series, node, feature, cut, left, right):
        self.feature[series, node], self.cut[series, node] = feature, cut
        self.value[series, 2 * node + 1], self.value[series, 2 * node + 2] = left, right

    def descend(self, series: np.ndarray, node: np.ndarray, binned: np.ndarray) -> np.ndarray:
        """One level down; a leaf stays."""
        f = self.feature[series, node]
        right = binned[np.arange(len(node)), np.maximum(f, 0)] > self.cut[series, node]
        return np.where(f < 0, node, 2 * node + 1 + right)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """Trees to keep by the validation losses so far (the first is that of no tree), and whether to stop."""
    best = int(np.argmin(losses))
    for i in range(len(losses)):
        if i - int(np.argmin(losses[: i + 1])) >= patience:
            return int(np.argmin(losses[: i + 1])), True
    return best, False


def boost(series: np.ndarray, binned: np.ndarray, y: np.ndarray, val: np.ndarray, n: int, p: Params):
    """Trees of ``n`` series whose rows are given whole: base values, trees, and losses per series.

    Histograms end at the last bin that holds a row: no cut behind it has rows on both sides.
    """
    train, bins = ~val, max(int(binned.max(initial=0)) + 1, 2)
    count = np.bincount(series[train], minlength=n)
    base = np.divide(np.bincount(series[train], y[train], n), count, out=np.zeros(n), where=count > 0)
    score = base[series]
    error = np.bincount(series[train], (y - score)[train] ** 2, n)
    val_n = np.bincount(series[val], minlength=n)
    trees, val_loss, train_loss = [], [[] for _ in range(n)], [[] for _ in range(n)]

    def losses(live):
        out = [np.divide(np.bincount(series[m], (y - score)[m] ** 2, n), k, out=np.zeros(n), where=k > 0) for m, k in ((val, val_n), (train, count))]
        for s in live:
            val_loss[s].append(out[0][s])
            train_loss[s].append(out[1][s])

    live = np.arange(n)
    losses(live)
    for _ in range(p.trees):
        tree, residual, node = Tree(n, p.depth), y - score, np.zeros(len(y), np.int64)
        grows = np.zeros(n, bool)
        of_live = np.isin(series, live)
        open_rows = np.flatnonzero(train & of_live)
        for level in range(p.depth):
            slots, at = np.unique(series[open_rows] * (1 << p.depth + 1) + node[open_rows], return_inverse=True)
            if not len(slots):
                break
            s, k = np.divmod(slots, 1 << p.depth + 1)
            split, feature, cut, values = best_splits(*cells(at, binned[open_rows], residual[open_rows], len(slots), bins), p.reg, error[s])
            if level == 0:
                tree.value[s, 0] = values[0]
                grows[s] = split
            tree.split(s[split], k[split], feature[split], cut[split], values[1][split], values[2][split])
            node = tree.descend(series, node, binned)
            open_rows = open_rows[split[at]]
        live = live[grows[live]]
        if not len(live):
            break
        trees.append(tree)
        moved = grows[series]
        score = score + np.where(moved, p.lr * tree.value[series, node], 0.0)
        losses(live)
        live = np.array([s for s in live if not val_n[s] or not best_round(val_loss[s], p.patience)[1]], np.int64)
    return base, trees, val_n, val_loss, train_loss


MODEL = ("base double, cuts array<double>, tree array<int>, node array<int>, feature array<int>, cut array<int>, value array<double>, "
         "epochs_trained int, best_val_loss double, final_train_loss double")


def model_row(base, cuts, trees: list, s: int, val_n, val_loss, train_loss, p: Params) -> dict:
    """The trees of one series that are kept, as flat arrays of their nodes."""
    grown = len(train_loss) - 1
    kept = best_round(val_loss, p.patience)[0] if val_n else grown
    shape = kept, 2 ** (p.depth + 1) - 1
    grown_trees = {c: np.array([getattr(t, c)[s] for t in trees[:kept]]).reshape(shape) for c in ("feature", "cut", "value")}
    inner, there = grown_trees["feature"][:, : 2**p.depth - 1] >= 0, np.zeros(shape, bool)
    there[:, 0], there[:, 1::2], there[:, 2::2] = True, inner, inner  # the root, and both children of inner nodes
    tree, node = np.nonzero(there)
    out = {"tree": tree, "node": node, **{c: v[tree, node] for c, v in grown_trees.items()}}
    return {"base": float(base), "cuts": cuts, **out, "epochs_trained": kept,
            "best_val_loss": float(val_loss[kept]) if val_n else None, "final_train_loss": float(train_loss[kept])}


def _numbers(scalar) -> np.ndarray:
    """An Arrow list of doubles; a missing one is NaN."""
    return scalar.values.to_numpy(zero_copy_only=False).astype(float)


def _packed(batch, lag: int) -> Iterator[tuple]:
    """(row, observed training values, targets, lags, is validation) of every packed block of a batch."""
    for i in range(batch.num_rows):
        values, halo, start, first_val = (batch.column(c)[i] for c in ("values", "halo_n", "start", "val_from"))
        values = _numbers(values)
        y, x, place = lag_rows(values, halo.as_py(), lag)
        known = first_val.as_py() - start.as_py() if first_val.is_valid else len(values)
        seen = values[:known]
        yield i, seen[~np.isnan(seen)], y, x, place >= known


# ---- Spark side ------------------------------------------------------------------------------------

def _key_type(df: DataFrame) -> str:
    return dict(df.dtypes)["_k"]


def pack_blocks(points: DataFrame, lag: int, block: int = BLOCK) -> DataFrame:
    """One row per series and block: ``values`` in order with up to ``lag`` values before the block, and the first validation position."""
    keys = config_keys(points)
    part = F.col("part") if "part" in points.columns else F.lit("train")
    rows = with_halo(points.select(F.struct(*keys).alias("_k"), "pos", F.col("value").cast("double").alias("value"), part.alias("part")), lag, 0, block)
    return rows.groupBy("_k", "block").agg(
        F.min("pos").alias("start"), F.sum(F.col("halo").cast("int")).alias("halo_n"), F.min(F.when(F.col("part") == "val", F.col("pos"))).alias("val_from"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values"),
    )


def per_series_boosting(
    points: DataFrame, lag: int = 10, trees: int = 100, depth: int = 6, lr: float = 0.1, bins: int = 64, reg: float = 1.0, patience: int = 10,
    block: int = BLOCK,
) -> DataFrame:
    """A stored model with one row per series: its keys, base value, cut points, trees and losses.

    ``points`` may hold ``part`` (``train``, ``val``) as ``train_val_split`` gives it. A series without a complete history has no trees and a base of 0.
    """
    p, spark = Params(lag, trees, depth, lr, bins, reg, patience), points.sparkSession
    path = new_table_path(spark)
    with scratch_run(spark):
        packed = materialise(pack_blocks(points, lag, block))
        long = packed.where("block > 0").select("_k").distinct()
        model = _fit_whole(packed.join(long, "_k", "left_anti"), p)
        if not long.isEmpty():
            model = model.unionByName(_fit_long(packed.join(long, "_k", "left_semi"), points, long, p))
        params = [F.lit(lag).alias("lag"), F.lit(depth).alias("depth"), F.lit(float(lr)).alias("lr")]
        model = model.select("_k.*", *params, *[c for c in model.columns if c != "_k"])
        model.write.parquet(path)
    return spark.read.schema(model.schema).parquet(path)


def _fit_whole(packed: DataFrame, p: Params) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            kinds = model_types()
            held, size, most = [], 0, 0
            for i, seen, y, x, val in _packed(batch, p.lag):
                cuts = cut_points(np.sort(seen), p.bins)
                if held and (size + len(y) > TOGETHER_ROWS or (len(held) + 1) * max(most, len(cuts) + 1) > TOGETHER_BINS):
                    yield fit(batch, held, kinds)
                    held, size, most = [], 0, 0
                held.append((i, cuts, y, x, val))
                size, most = size + len(y), max(most, len(cuts) + 1)
            if held:
                yield fit(batch, held, kinds)

    def fit(batch, held, kinds):
        series = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        binned = np.concatenate([np.searchsorted(cuts, x) for _, cuts, _, x, _ in held]).astype(np.uint8)
        y, val = np.concatenate([h[2] for h in held]), np.concatenate([h[4] for h in held])
        base, trees, val_n, val_loss, train_loss = boost(series, binned, y, val, len(held), p)
        rows = [model_row(base[s], held[s][1], trees, s, val_n[s], val_loss[s], train_loss[s], p) for s in range(len(held))]
        keys = batch.column(batch.schema.get_field_index("_k")).take(pa.array([h[0] for h in held]))
        return pa.RecordBatch.from_arrays([keys, *[pa.array([r[c] for r in rows], t) for c, t in kinds.items()]], ["_k", *kinds])

    return packed.mapInArrow(run, f"_k {_key_type(packed)}, {MODEL}")


def model_types() -> dict:
    import pyarrow as pa

    ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
    return {"base": pa.float64(), "cuts": doubles, "tree": ints, "node": ints, "feature": ints, "cut": ints, "value": doubles,
            "epochs_trained": pa.int32(), "best_val_loss": pa.float64(), "final_train_loss": pa.float64()}


def _fit_long(packed: DataFrame, points: DataFrame, long: DataFrame, p: Params) -> DataFrame:
    """Series of several blocks: cells of all blocks are added up once per tree level, splits go back to the blocks."""
    spark, key = packed.sparkSession, _key_type(packed)
    part = F.col("part") if "part" in points.columns else F.lit("train")
    seen = points.select(F.struct(*config_keys(points)).alias("_k"), "pos", F.col("value").cast("double").alias("value"), part.alias("part")).where(
        "part = 'train' AND value IS NOT NULL").join(long, "_k", "left_semi")
    ranked = assign_positions(seen.select("_k", "value", "pos"), ["_k"], ["value", "pos"], "rank")
    sizes = seen.groupBy("_k").agg(F.count("*").alias("_n"))
    # rank r is one of i (n - 1) div (bins - 1) if the first i with i (n - 1) >= r (bins - 1) gives it
    steps = p.bins - 1
    i = F.expr(f"(rank * {steps} + _n - 2) div (_n - 1)")
    values = (
        _attach(ranked.withColumn("block", F.expr(f"rank div {BLOCK}")), sizes.where("_n > 1")).withColumn("_i", i)
        .where((F.col("_i") <= steps) & (F.col("_i") * (F.col("_n") - 1) < (F.col("rank") + 1) * steps))
        .groupBy("_k").agg(F.sort_array(F.collect_set("value")).alias("at")))
    middles = F.transform(F.slice("at", 2, F.size("at")), lambda v, j: (F.get("at", j) + v) / 2)
    cuts = materialise(values.select("_k", middles.alias("cuts")))
    state = _start_long(_attach(packed, cuts, "left"), key, p)
    facts = materialise(state.groupBy("_k").agg(
        F.sum("n").alias("n"), F.sum("val_n").alias("val_n"), (F.sum("sum_y") / F.sum("n")).alias("base")))
    at = new_table_path(spark)
    state = _moved(_attach(state, facts.select("_k", "base")), key, p, at, base=True)
    error = materialise(state.groupBy("_k").agg(F.sum("train_sse").alias("error")))
    folder, loss = new_table_path(spark), new_table_path(spark)
    _losses(state, 0).write.parquet(loss)
    grown = 0
    while grown < p.trees:
        following = new_table_path(spark)
        with scratch_run(spark):
            splits = _grow(state, error, key, p)
            if splits is None:
                break
            splits.withColumn("tree", F.lit(grown)).write.mode("append").parquet(folder)
            state = _moved(_attach(state, splits, "left"), key, p, following)
        delete_stored(spark, at)
        at, grown = following, grown + 1
        _losses(state, grown).write.mode("append").parquet(loss)
    losses = spark.read.parquet(loss).join(facts.select("_k", "n", "val_n"), "_k").groupBy("_k").agg(
        F.sort_array(F.collect_list(F.struct(
            "tree", (F.col("val_sse") / F.greatest("val_n", F.lit(1))).alias("val"), (F.col("train_sse") / F.greatest("n", F.lit(1))).alias("train"),
        ))).alias("losses"))
    rows = facts.join(cuts, "_k", "left").join(losses, "_k")
    if grown:
        rows = rows.join(spark.read.parquet(folder).groupBy("_k").agg(F.collect_list(F.struct("tree", "splits")).alias("trees")), "_k", "left")
    else:
        rows = rows.withColumn("trees", F.lit(None))
    return _long_models(rows, key, p)


def _attach(state: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Facts of each series next to its blocks: repeated per block first, so that a long series is not gathered."""
    return state.join(state.select("_k", "block").distinct().join(facts, "_k"), ["_k", "block"], how)


def _start_long(packed: DataFrame, key: str, p: Params) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for i, _, y, x, val in _packed(batch, p.lag):
                cuts = batch.column("cuts")[i]
                binned = np.searchsorted(_numbers(cuts) if cuts.is_valid else np.zeros(0), x).astype(np.uint8)
                out.append((binned.tobytes(), y.tobytes(), val.tobytes(), int((~val).sum()), int(val.sum()), float(y[~val].sum())))
            kinds = [pa.binary()] * 3 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), batch.column("block"), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)]],
                ["_k", "block", "binned", "y", "val", "n", "val_n", "sum_y"])

    return materialise(packed.mapInArrow(run, f"_k {key}, block long, binned binary, y binary, val binary, n long, val_n long, sum_y double"))


def _rows(batch, i, p: Params):
    binned = np.frombuffer(batch.column("binned")[i].as_buffer(), np.uint8).reshape(-1, p.lag)
    return binned, *(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("y", float), ("val", bool)))


def _tree_of(splits, p: Params) -> Tree:
    tree = Tree(1, p.depth)
    for s in sorted(splits or [], key=lambda s: s["node"]):
        if s["node"] == 0:
            tree.value[0, 0] = s["here"]
        tree.split(0, s["node"], s["feature"], s["cut"], s["left"], s["right"])
    return tree


def _moved(state: DataFrame, key: str, p: Params, path: str, base: bool = False) -> DataFrame:
    """Stored at ``path``: scores of all rows moved by the new tree (or set to the base), and the squared errors of each block."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            scores, train_sse, val_sse = [], [], []
            for i in range(batch.num_rows):
                binned, y, val = _rows(batch, i, p)
                if base:
                    score = np.full(len(y), batch.column("base")[i].as_py() or 0.0)
                else:
                    score = np.frombuffer(batch.column("score")[i].as_buffer(), float)
                    splits = batch.column("splits")[i].as_py()
                    if splits:
                        tree, node, one = _tree_of(splits, p), np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
                        for _ in range(p.depth):
                            node = tree.descend(one, node, binned)
                        score = score + p.lr * tree.value[0, node]
                scores.append(score.tobytes())
                train_sse.append(float(((y - score)[~val] ** 2).sum()))
                val_sse.append(float(((y - score)[val] ** 2).sum()))
            kept = [batch.column(c) for c in ("_k", "block", "binned", "y", "val")]
            arrays = [pa.array(scores, pa.binary()), pa.array(train_sse, pa.float64()), pa.array(val_sse, pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["_k", "block", "binned", "y", "val", "score", "train_sse", "val_sse"])

    out = state.mapInArrow(run, f"_k {key}, block long, binned binary, y binary, val binary, score binary, train_sse double, val_sse double")
    out.write.parquet(path)
    return state.sparkSession.read.schema(out.schema).parquet(path)


def _losses(state: DataFrame, tree: int) -> DataFrame:
    return state.groupBy("_k").agg(F.sum("val_sse").alias("val_sse"), F.sum("train_sse").alias("train_sse")).withColumn("tree", F.lit(tree))


def _grow(state: DataFrame, error: DataFrame, key: str, p: Params) -> DataFrame | None:
    """Stored: the splits of one tree of every series, or None if no series gains from another tree."""
    import pyarrow as pa

    def partial(level):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    binned, y, val = _rows(batch, i, p)
                    splits = batch.column("splits")[i].as_py() if level else None
                    if not level or splits:
                        residual = y - np.frombuffer(batch.column("score")[i].as_buffer(), float)
                        node, tree = np.zeros(len(y), np.int64), _tree_of(splits, p)
                        for _ in range(level):
                            node = tree.descend(np.zeros(len(y), np.int64), node, binned)
                        here = np.flatnonzero(~val & (node >= (1 << level) - 1))
                        nodes, at = np.unique(node[here], return_inverse=True)
                        g, h = cells(at, binned[here], residual[here], len(nodes), p.bins)
                        slot, feature, cell = np.nonzero(h)
                        keys = batch.column("_k").take(pa.array(np.full(len(slot), i)))
                        numbers = [pa.array(a.astype(np.int32)) for a in (nodes[slot], feature, cell)]
                        sums = [pa.array(a[slot, feature, cell]) for a in (g, h)]
                        yield pa.RecordBatch.from_arrays([keys, *numbers, *sums], ["_k", "node", "feature", "bin", "g", "h"])

        return run

    def choose(batches):
        for batch in batches:
            n = batch.num_rows
            g, h = np.zeros((n, p.lag, p.bins)), np.zeros((n, p.lag, p.bins))
            for i, found in enumerate(batch.column("cells")):
                feature, cell, a, b = (c.to_numpy() for c in found.values.flatten())
                g[i, feature, cell], h[i, feature, cell] = a, b
            split, feature, cut, values = best_splits(g, h, p.reg, batch.column("error").to_numpy())
            at = pa.array(np.flatnonzero(split))
            arrays = [batch.column(c).take(at) for c in ("_k", "node")]
            arrays += [pa.array(a[split].astype(np.int32)) for a in (feature, cut)] + [pa.array(v[split]) for v in values]
            yield pa.RecordBatch.from_arrays(arrays, ["_k", "node", "feature", "cut", "here", "left", "right"])

    names = ["node", "feature", "cut", "here", "left", "right"]
    levels, found = [], None
    for level in range(p.depth):
        rows = state if found is None else _attach(state, found)
        summed = rows.mapInArrow(partial(level), f"_k {key}, node int, feature int, bin int, g double, h double").groupBy(
            "_k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        nodes = summed.groupBy("_k", "node").agg(F.collect_list(F.struct("feature", "bin", "g", "h")).alias("cells")).join(error, "_k")
        new = materialise(nodes.mapInArrow(choose, f"_k {key}, node int, feature int, cut int, here double, left double, right double"))
        if new.isEmpty():
            break
        levels.append(new)
        every = levels[0]
        for other in levels[1:]:
            every = every.unionByName(other)
        found = every.groupBy("_k").agg(F.collect_list(F.struct(*names)).alias("splits"))
    return materialise(found) if levels else None


def _long_models(rows: DataFrame, key: str, p: Params) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            kinds, out = model_types(), []
            for r in batch.to_pylist():
                grown = {t["tree"]: t["splits"] for t in r["trees"] or []}
                last = max(grown, default=-1) + 1
                losses = sorted(r["losses"], key=lambda x: x["tree"])[: last + 1]
                trees = [_tree_of(grown.get(t), p) for t in range(last)]
                out.append(model_row(r["base"] or 0.0, np.array(r["cuts"] or []), trees, 0, r["val_n"], [x["val"] for x in losses], [x["train"] for x in losses], p))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), *[pa.array([r[c] for r in out], t) for c, t in kinds.items()]], ["_k", *kinds])

    return rows.mapInArrow(run, f"_k {key}, {MODEL}")


# ---- forecasts from stored trees -------------------------------------------------------------------

class Forest:
    """The trees of one model as arrays; several histories are answered at once."""

    def __init__(self, row: dict):
        n, nodes = max(row["tree"], default=-1) + 1, 2 ** (row["depth"] + 1) - 1
        self.base, self.lr, self.depth = row["base"], row["lr"], row["depth"]
        self.feature, self.cut, self.value = np.full((n, nodes), -1), np.zeros((n, nodes)), np.zeros((n, nodes))
        at = row["tree"], row["node"]
        cuts = np.append(np.array(row["cuts"], float), np.inf)
        self.feature[at], self.value[at] = row["feature"], row["value"]
        self.cut[at] = cuts[np.array(row["cut"], int)] if len(row["cut"]) else []

    def predict_all(self, lags: np.ndarray) -> np.ndarray:
        """One step for every row of ``lags``, nearest first."""
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(lags))[:, None]
        node = np.zeros((len(lags), len(self.feature)), int)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            node = np.where(f < 0, node, 2 * node + 1 + (lags[row, np.maximum(f, 0)] > self.cut[tree, node]))
        return self.base + self.lr * self.value[tree, node].sum(axis=1)

    def path(self, history: np.ndarray, h: int) -> list[float]:
        """``h`` steps, each prediction entering the history of the next."""
        lags, out = history[::-1].copy(), []
        for _ in range(h):
            out.append(float(self.predict_all(lags[None, :])[0]))
            lags = np.concatenate(([out[-1]], lags[:-1]))
        return out


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an Arrow list column, and for every list where it starts and ends among them."""
    return _numbers_of(column.flatten()), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def _numbers_of(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _paths(batch, some: np.ndarray) -> np.ndarray:
    """Forecasts of the rows ``some`` of a batch, up to the longest horizon among them: the trees of all their models are followed together."""
    tree, ends = _lists(batch.column("tree"))
    size = np.diff(ends)[some]
    at = np.repeat(ends[some] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    own, tree = np.repeat(np.arange(len(some)), size), tree[at].astype(np.int64)
    node, feature, cut, value = (_lists(batch.column(c))[0][at] for c in ("node", "feature", "cut", "value"))
    base, lr, depth, h = (_numbers_of(batch.column(c))[some] for c in ("base", "lr", "depth", "h"))
    shape = len(some), int(tree.max(initial=-1)) + 1, 2 ** (int(depth.max()) + 1) - 1
    features, cuts, values = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape)
    points, starts = _lists(batch.column("cuts"))
    points = np.append(points.astype(float), np.inf)
    features[own, tree, node], values[own, tree, node] = feature, value
    cuts[own, tree, node] = points[np.where(feature < 0, len(points) - 1, starts[some][own] + cut)]
    hist, starts = _lists(batch.column("hist"))
    lags = hist.astype(float)[starts[some + 1][:, None] - 1 - np.arange(batch.column("lag")[int(some[0])].as_py())]  # nearest first
    row, column, out = np.arange(shape[0])[:, None], np.arange(shape[1])[None, :], np.zeros((len(some), int(h.max())))
    for step in range(out.shape[1]):
        at = np.zeros(shape[:2], np.int64)
        for _ in range(int(depth.max())):
            f = features[row, column, at]
            at = np.where(f < 0, at, 2 * at + 1 + (lags[row, np.maximum(f, 0)] > cuts[row, column, at]))
        out[:, step] = base + lr * values[row, column, at].sum(axis=1)
        lags = np.concatenate((out[:, step: step + 1], lags[:, :-1]), axis=1)
    return out


def forest_paths(states: DataFrame) -> DataFrame:
    """``path`` for rows with ``hist`` (oldest first), ``h`` and the columns of a model: many models at a time, no job per step."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            h, lag, depth = (_numbers_of(batch.column(c)) for c in ("h", "lag", "depth"))
            full = np.flatnonzero(batch.column("hist").value_lengths().to_numpy(zero_copy_only=False) == lag)
            tree, ends = _lists(batch.column("tree"))
            trees = np.array([tree[b - 1] + 1 if b > a else 1 for a, b in zip(ends, ends[1:])], np.int64)  # trees are stored in order
            nodes, paths, start = trees * 2 ** (depth.astype(np.int64) + 1), [None] * n, 0
            while start < len(full):
                end, most = start + 1, nodes[full[start]]
                while end < len(full) and lag[full[end]] == lag[full[start]]:
                    wider = max(most, nodes[full[end]])
                    if wider * (end + 1 - start) > TOGETHER_NODES:
                        break
                    end, most = end + 1, wider
                some = full[start:end]
                for i, path in zip(some, _paths(batch, some)):
                    paths[i] = path[: h[i]]
                start = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(paths, pa.list_(pa.float64()))], ["_id", "path"])

    return states.mapInArrow(run, f"_id {dict(states.dtypes)['_id']}, path array<double>")
