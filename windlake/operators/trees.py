"""Boosted regression trees, grown leaf by leaf from histograms; one model, or many that differ in the stations left out.

Features become bin numbers once. A pass over the rows makes the histograms (sum of gradients, rows) of all leaves that are
to be split next, in all runs; partitions add them up, and of two siblings only the smaller is counted, as the other is
the parent less it. Which leaves a tree splits is decided by gain, best first, as if one leaf were split at a time: a pass
expands every leaf that could still be among the best, so a tree takes about as many passes as it is deep.

Rows stay in their partitions, with the predictions of every run so far: this is the one place that keeps an RDD, as a
row's state changes with each tree. It is written to the checkpoint folder every few trees, so a lost executor costs those.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.operators.features import FEATURES, drop_missing
from windlake.sources.scratch import Scratch, shared_dir

CHECKPOINT_EVERY = 20
RUNS_AT_ONCE = 24  # runs that share their passes; each keeps a prediction for each row
ROWS_A_PART = 10_000  # rows times runs that a partition has at least, as a pass over fewer costs more to start than to do
SUM_AT_DRIVER = 64  # partitions whose histograms the driver adds up itself; more are added up in a tree


@dataclass(frozen=True)
class TreeSettings:
    """Sizes and penalties of a model; the defaults are those of the experiments."""

    trees: int = 600
    rate: float = 0.05
    leaves: int = 63
    least_rows: int = 20
    penalty: float = 1.0
    feature_share: float = 0.8
    bins: int = 255
    seed: int = 42
    over_gain: float = 1e-12  # a split gains more than this; with minus infinity, a leaf of enough rows is split whatever it gains


#: Of the controlled leakage test and the folds.
LEAKAGE = TreeSettings(trees=200, rate=0.08, leaves=31, penalty=0.0, feature_share=1.0)


@dataclass
class Tree:
    """Nodes in the order they were made; the root is 0 and a leaf has feature -1. ``cut`` is the last bin that goes left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray


@dataclass
class Trees:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    settings: TreeSettings
    trees: list[Tree] = field(default_factory=list)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table: tree, node, feature (NULL in leaves), threshold (up to it goes left), left, right, value (of a
        leaf, times the rate), gain, rows. Tree -1 is the value that all rows begin with."""
        parts = [pd.DataFrame({"tree": [-1], "node": [0], "feature": [None], "threshold": [np.nan], "left": [-1], "right": [-1], "value": [self.base], "gain": [0.0], "n_rows": [0]})]
        for i, t in enumerate(self.trees):
            leaf = t.feature < 0
            threshold = [np.nan if f < 0 else self.edges[f][c] for f, c in zip(t.feature, t.cut)]
            name = [None if f < 0 else self.features[f] for f in t.feature]
            parts.append(pd.DataFrame({"tree": i, "node": range(len(leaf)), "feature": name, "threshold": threshold, "left": t.left, "right": t.right, "value": np.where(leaf, t.value, np.nan), "gain": t.gain, "n_rows": t.rows}))
        d = spark.createDataFrame(pd.concat(parts, ignore_index=True), "tree int, node int, feature string, threshold double, left int, right int, value double, gain double, n_rows long")
        return d.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("threshold", "value")})

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[_leaf(codes, t.feature, t.cut, t.left, t.right)]
        return out

    def column(self, df: DataFrame):
        """The prediction, not yet clipped, from Arrow batches of the features."""
        model = df.sparkSession.sparkContext.broadcast(self)  # some MB: nodes are bounded by trees and leaves

        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = np.stack([c.to_numpy(float) for c in columns], axis=1)
                yield pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, model.value.predict(x)))

        return F.nanvl(predict(*(F.col(c).cast("double") for c in self.features)), F.lit(None).cast("double"))


def _leaf(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    node, at = np.zeros(len(codes), np.int64), np.arange(len(codes)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(at):
        n = node[at]
        n = np.where(codes[at, feature[n]] <= cut[n], left[n], right[n])
        node[at] = n
        at = at[feature[n] >= 0]
    return node


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """The upper edges of each feature's bins: its own values while there are at most ``bins``, else quantiles. One scan makes the
    quantile sketches; a second counts the values of features with few, which are few rows once combined."""
    shares = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    quantiles = [f"percentile_approx(`{c}`, array({shares}), {8 * bins}) as q{i}" for i, c in enumerate(features)]  # as text: it has some thousand numbers
    one = df.selectExpr(*quantiles, *(f"approx_count_distinct(`{c}`, 0.01) as d{i}" for i, c in enumerate(features))).first()
    few = [i for i in range(len(features)) if one[f"d{i}"] <= 1.1 * bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(features[i]).cast("double").alias("v")) for i in few))).alias("x")).select("x.*").distinct()
        for r in long.where("v is not null").collect():
            values[r["i"]].append(r["v"])
    return [np.array(sorted(values[i])[:-1] if i in values and len(values[i]) <= bins else sorted(set(one[f"q{i}"] or [])), float) for i in range(len(features))]


def _blocks(scratch: Scratch, df: DataFrame, features: Sequence[str], y: str, station: str | None, edges: list[np.ndarray]) -> DataFrame:
    """Rows as packed arrays: bin numbers, target, and the station's place in the list of stations that runs name."""

    def pack(batches):
        for b in batches:
            x = [np.searchsorted(e, b.column(i).to_numpy(zero_copy_only=False), "left").astype(np.uint8) for i, e in enumerate(edges)]
            arrays = [np.stack(x, axis=1).tobytes() if x else b"", b.column("_y").to_numpy(zero_copy_only=False).astype(float).tobytes(), b.column("_s").to_numpy(zero_copy_only=False).astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in arrays], ["x", "y", "s"])

    d = df.select(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)), F.col(y).cast("double").alias("_y"), F.coalesce(F.col(station) if station else F.lit(-1), F.lit(-1)).alias("_s"))
    return scratch.put(d.mapInArrow(pack, "x binary, y binary, s binary"), "bins")


@dataclass
class _State:
    """A partition's rows: bins, target, which runs train on each, and each run's prediction so far."""

    x: np.ndarray
    y: np.ndarray
    s: np.ndarray
    inside: np.ndarray
    pred: np.ndarray


class _Growing:
    """One tree of one run while it grows. Every node has its sums; those that may be split have a histogram and a best split."""

    def __init__(self, settings: TreeSettings, offsets: np.ndarray, chosen: np.ndarray):
        self.s, self.offsets, self.chosen = settings, offsets, chosen
        self.feature, self.cut, self.left, self.right = [-1], [-1], [-1], [-1]
        self.g, self.n, self.gain, self.split = [0.0], [0], [-np.inf], [(-1, -1, 0.0, 0)]
        self.hist: dict[int, np.ndarray] = {}
        last = np.zeros(offsets[-1], bool)
        last[offsets[1:] - 1] = True
        on = np.zeros(len(offsets) - 1, bool)
        on[chosen] = True
        self.closed = last | ~np.repeat(on, np.diff(offsets))

    def look(self, nodes: list[int]) -> None:
        """Finds the best split of nodes that have a histogram; of equal gains the first feature's lowest cut."""
        if not nodes:
            return
        h = np.stack([self.hist[n] for n in nodes])
        run = np.cumsum(h, axis=1)
        before = np.concatenate([np.zeros((len(nodes), 1, 2)), run], axis=1)[:, self.offsets[:-1]]
        own = run - np.repeat(before, np.diff(self.offsets), axis=1)
        g, n = own[..., 0], own[..., 1]
        all_g, all_n = np.array([self.g[i] for i in nodes])[:, None], np.array([self.n[i] for i in nodes])[:, None]
        lam = self.s.penalty
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / (n + lam) + (all_g - g) ** 2 / (all_n - n + lam) - all_g**2 / (all_n + lam)
        gain[(n < self.s.least_rows) | (all_n - n < self.s.least_rows) | self.closed] = -np.inf
        best = gain.argmax(axis=1)
        for k, i in enumerate(nodes):
            b = int(best[k])
            f = int(np.searchsorted(self.offsets, b, "right") - 1)
            if gain[k, b] > self.s.over_gain:
                self.gain[i], self.split[i] = float(gain[k, b]), (f, b - int(self.offsets[f]), float(g[k, b]), int(round(n[k, b])))

    def best_first(self) -> tuple[list[int], list[int]]:
        """Nodes in the order in which leaf-wise growth splits them, and those of them that have no children yet."""
        heap, order, open_ = [(-self.gain[0], 0)], [], []
        while heap and len(order) < self.s.leaves - 1:
            gain, i = heapq.heappop(heap)
            if gain == np.inf:
                break
            order.append(i)
            if self.left[i] < 0:
                open_.append(i)
            else:
                for c in (self.left[i], self.right[i]):
                    heapq.heappush(heap, (-self.gain[c], c))
        return order, open_

    def expand(self, nodes: list[int]) -> list[tuple[int, int, int]]:
        """Gives nodes children; (parent, smaller, larger) of those whose histograms are needed."""
        need = []
        for i in nodes:
            f, b, g, n = self.split[i]
            kids = len(self.g), len(self.g) + 1
            for gk, nk in ((g, n), (self.g[i] - g, self.n[i] - n)):
                for x, v in ((self.feature, -1), (self.cut, -1), (self.left, -1), (self.right, -1), (self.g, gk), (self.n, nk), (self.gain, -np.inf), (self.split, (-1, -1, 0.0, 0))):
                    x.append(v)
            self.feature[i], self.cut[i], (self.left[i], self.right[i]) = f, b, kids
            small, large = sorted(kids, key=lambda k: self.n[k])
            if self.n[large] >= 2 * self.s.least_rows:
                need.append((i, small, large))
            else:
                self.hist.pop(i)
        return need

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int16 if x is self.cut else np.int32) for x in (self.feature, self.cut, self.left, self.right))

    def finished(self, order: list[int]) -> Tree:
        keep = {0} | {c for i in order for c in (self.left[i], self.right[i])}
        new = {old: k for k, old in enumerate(sorted(keep))}
        split = set(order)
        at = sorted(keep)
        to = lambda x: np.array([new[x[i]] if i in split else -1 for i in at])
        own = lambda x, other: np.array([x[i] if i in split else other for i in at])
        value = np.array([-self.g[i] / (self.n[i] + self.s.penalty) * self.s.rate for i in at])
        return Tree(own(self.feature, -1), own(self.cut, -1), to(self.left), to(self.right), value, own(self.gain, 0.0).astype(float), np.array([self.n[i] for i in at]))


def _sum(parts: RDD) -> np.ndarray:
    """Adds up the partitions' arrays."""
    add = lambda x, y: x + y
    return parts.reduce(add) if parts.getNumPartitions() <= SUM_AT_DRIVER else parts.treeReduce(add, depth=3)


def _counted(state: RDD, offsets: np.ndarray, jobs: list[tuple]) -> np.ndarray:
    """Histograms (wanted nodes x bins x (gradient, rows)) over all partitions. ``jobs``: run, tree so far, wanted nodes, features."""
    width, wanted = int(offsets[-1]), sum(len(j[2]) for j in jobs)

    def count(parts: Iterator[_State]):
        out = np.zeros((2, wanted * width))
        for p in parts:
            base = 0
            for run, tree, nodes, chosen in jobs:
                slot = np.full(len(tree[0]), -1)
                slot[nodes] = np.arange(len(nodes))
                rows = np.flatnonzero(p.inside[run])
                to = slot[_leaf(p.x if len(rows) == len(p.x) else p.x[rows], *tree)]
                rows, to = rows[to >= 0], to[to >= 0]
                at = ((to + base) * width)[:, None] + (p.x[rows][:, chosen] + offsets[chosen][None, :])
                at = at.ravel()
                g = np.repeat(p.pred[run, rows] - p.y[rows], len(chosen))
                lo, hi = base * width, (base + len(nodes)) * width
                out[0, lo:hi] += np.bincount(at - lo, g, hi - lo)
                out[1, lo:hi] += np.bincount(at - lo, minlength=hi - lo)
                base += len(nodes)
        yield out

    return np.moveaxis(_sum(state.mapPartitions(count)).reshape(2, wanted, width), 0, -1)


def _boost(spark: SparkSession, blocks: DataFrame, edges: list[np.ndarray], runs: list[list[int]], settings: TreeSettings) -> tuple[RDD, list[float], list[list[Tree]]]:
    """The state after all trees, and each run's first value and trees. ``runs``: the stations (by place) that each leaves out."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    width = len(edges)
    offsets = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)

    def load(rows):
        parts = [(r["x"], r["y"], r["s"]) for r in rows]
        if parts:
            x, y, s = (b"".join(p) for p in zip(*parts))
            s = np.frombuffer(s, np.int32)
            inside = np.stack([~np.isin(s, out) for out in runs])
            yield _State(np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y, float), s, inside, np.zeros(inside.shape))

    rows_in = blocks.agg(F.sum(F.length("y") / 8)).first()[0] or 0
    parts = max(1, -(-int(rows_in) * len(runs) // ROWS_A_PART))
    rows = blocks.rdd
    state = (rows.coalesce(parts) if rows.getNumPartitions() > parts else rows).mapPartitions(load).persist(StorageLevel.MEMORY_AND_DISK)

    def first(parts):
        yield sum((np.stack([p.inside @ p.y, p.inside.sum(axis=1)]) for p in parts), np.zeros((2, len(runs))))

    total, rows = _sum(state.mapPartitions(first))
    base = np.divide(total, rows, out=np.zeros(len(runs)), where=rows > 0)

    def begun(parts):
        for p in parts:
            p.pred = np.repeat(base[:, None], len(p.y), axis=1)
            yield p

    states = [state, state.mapPartitions(begun).persist(StorageLevel.MEMORY_AND_DISK)]
    made: list[list[Tree]] = [[] for _ in runs]
    live = [r for r in range(len(runs)) if rows[r] >= 2 * settings.least_rows]
    for t in range(settings.trees if live else 0):
        state = states[-1]
        if t and t % CHECKPOINT_EVERY == 0:
            state.checkpoint()
        rng = np.random.default_rng((settings.seed, t))
        share = max(1, int(round(settings.feature_share * width)))
        chosen = np.sort(rng.permutation(width)[:share])
        growing = {r: _Growing(settings, offsets, chosen) for r in live}
        hist = _counted(state, offsets, [(r, growing[r].arrays(), [0], chosen) for r in live])
        for h, r in zip(hist, live):
            tree, f = growing[r], chosen[0]
            tree.hist[0] = h
            tree.g[0], n = h[offsets[f] : offsets[f + 1]].sum(axis=0)
            tree.n[0] = int(round(n))
            tree.look([0])
        orders: dict[int, list[int]] = {}
        while len(orders) < len(live):
            need = {}
            for r in live:
                if r in orders:
                    continue
                order, open_ = growing[r].best_first()
                if open_:
                    need[r] = growing[r].expand(open_)
                else:
                    orders[r] = order
            jobs = [(r, growing[r].arrays(), [small for _, small, _ in n], chosen) for r, n in need.items() if n]
            if jobs:
                hist = iter(_counted(state, offsets, jobs))
                for r, *_ in jobs:
                    tree, ready = growing[r], []
                    for parent, small, large in need[r]:
                        tree.hist[small] = next(hist)
                        tree.hist[large] = tree.hist.pop(parent) - tree.hist[small]
                        for k in (small, large):
                            if tree.n[k] >= 2 * settings.least_rows:
                                ready.append(k)
                            else:
                                del tree.hist[k]
                    tree.look(ready)
        step = {r: growing[r].finished(orders[r]) for r in live}
        for r, tree in step.items():
            made[r].append(tree)

        def moved(parts, step=step):
            for p in parts:
                pred = p.pred.copy()
                for r, tree in step.items():
                    pred[r] += tree.value[_leaf(p.x, tree.feature, tree.cut, tree.left, tree.right)]
                yield _State(p.x, p.y, p.s, p.inside, pred)

        states.append(state.mapPartitions(moved).persist(StorageLevel.MEMORY_AND_DISK))
        if len(states) > 2:  # the last but one is in memory once the last has been read
            states.pop(0).unpersist()
    return states[-1], base.tolist(), made


def fit_trees(spark: SparkSession, df: DataFrame, features: Sequence[str] = FEATURES, y: str = "power", settings: TreeSettings = TreeSettings()) -> Trees:
    """A model of rows that have all features and the target. An empty table gives a model of 0; rows that repeat count as
    often as they are there; other columns are ignored."""
    scratch = Scratch(spark, "trees")
    d = scratch.put(drop_missing(df, [*features, y]).select(*features, y), "rows")
    edges = bin_edges(d, features, settings.bins)
    state, base, made = _boost(spark, _blocks(scratch, d, features, y, None, edges), edges, [[]], settings)
    state.unpersist()
    scratch.drop("rows")
    return Trees(list(features), edges, base[0], settings, made[0])


def run_errors(spark: SparkSession, df: DataFrame, plan: Sequence[tuple[str, Sequence, Sequence]], features: Sequence[str], y: str, station: str, settings: TreeSettings = LEAKAGE) -> list[tuple[str, float, int]]:
    """(run, sum of squared errors, rows) on the test stations of each run of (name, test stations, excluded stations), with
    predictions clipped to [0, 1]. Runs share bins and passes; each run's trees are those of a separate fit."""
    scratch = Scratch(spark, "tree-runs")
    d = scratch.put(drop_missing(df, [*features, y]).select(*features, y, station), "rows")
    edges = bin_edges(d, features, settings.bins)
    named = sorted({s for _, test, gone in plan for s in (*test, *gone)})
    place = {s: i for i, s in enumerate(named)}
    kind = df.schema[station].dataType.simpleString()
    table = spark.createDataFrame([(s, i) for s, i in place.items()], f"_name {kind}, _place int")  # a row for each station that a run names
    d = d.join(table, F.col(station) == F.col("_name"), "left")
    blocks = _blocks(scratch, d, features, y, "_place", edges)
    out = []
    for at in range(0, len(plan), RUNS_AT_ONCE):
        some = plan[at : at + RUNS_AT_ONCE]
        state, _, _ = _boost(spark, blocks, edges, [[place[s] for s in gone] for _, _, gone in some], settings)
        tests = [[place[s] for s in test] for _, test, _ in some]

        def errors(parts, tests=tests):
            total = np.zeros((2, len(tests)))
            for p in parts:
                for r, test in enumerate(tests):
                    on = np.isin(p.s, test)
                    total[:, r] += ((p.y[on] - np.clip(p.pred[r, on], 0, 1)) ** 2).sum(), on.sum()
            yield total

        sse, n = _sum(state.mapPartitions(errors))
        out += [(name, float(e), int(k)) for (name, _, _), e, k in zip(some, sse, n)]
        state.unpersist()
    return out
