"""Boosted trees by first and second derivatives of the loss, on binned features.

Features are cut once into bins and written. A level of a tree is one job: each task adds the derivatives of its rows up by (node,
feature, bin), and one task for each node and feature adds the tasks' sums, finds the best cut and keeps them. Only the child with less weight is
summed up; its sibling is the parent less it. Best cuts of nodes and features, and nothing of a row, reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import evaluate
from scorewright.operators.binning import all_quantile_cuts
from scorewright.session import cut
from scorewright.shipping import ship

#: Least gain of a cut, and trees after which the rows are written anew with their margins.
LEAST_GAIN = 1e-6
FLUSH = 8
#: Bits of the fraction that decides whether a row is in a tree's sample.
_SHARE = float(1 << 53)


@dataclass
class Parameters:
    """Parameters by their usual names. n_jobs, verbosity and tree_method don't change the model: Spark spreads the work, and cuts are
    exact where a feature has no more than max_bin distinct values, else at its quantiles."""

    n_estimators: int = 100
    max_depth: int = 5
    learning_rate: float = 0.1
    objective: str = "binary:logistic"
    booster: str = "gbtree"
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_delta_step: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    scale_pos_weight: float = 1.0
    base_score: float = 0.5
    random_state: int = 0
    missing: float | None = None
    num_parallel_tree: int = 1
    monotone_constraints: str | tuple = "()"
    interaction_constraints: str | list = ""
    importance_type: str = "gain"
    max_bin: int = 256
    n_jobs: int | None = None
    verbosity: int = 0
    tree_method: str = "hist"
    eval_metric: str | None = None
    early_stopping_rounds: int | None = None

    def __post_init__(self) -> None:
        if self.booster != "gbtree":
            raise ValueError(f"booster {self.booster} isn't supported")
        if self.objective not in ("binary:logistic", "reg:squarederror"):
            raise ValueError(f"objective {self.objective} isn't supported")
        if self.importance_type not in ("gain", "weight", "cover", "total_gain", "total_cover"):
            raise ValueError(self.importance_type)
        if isinstance(self.monotone_constraints, str):
            self.monotone_constraints = tuple(int(x) for x in self.monotone_constraints.strip("()").split(",") if x.strip())
        if isinstance(self.interaction_constraints, str):
            self.interaction_constraints = json.loads(self.interaction_constraints) if self.interaction_constraints else []
        if self.eval_metric is None:
            self.eval_metric = "logloss" if self.logistic else "rmse"

    @property
    def logistic(self) -> bool:
        return self.objective == "binary:logistic"

    @classmethod
    def known(cls) -> set[str]:
        return {f.name for f in fields(cls)}

    def derivatives(self, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.logistic:
            return margin - label, np.ones(len(label))
        p = 1 / (1 + np.exp(-margin))
        weight = np.where(label == 1, self.scale_pos_weight, 1.0)
        return (p - label) * weight, np.maximum(p * (1 - p), 1e-16) * weight

    def weight(self, g, h, low=-np.inf, high=np.inf):
        """The best leaf value for sums of derivatives, shrunk, capped and within the bounds of monotone constraints."""
        w = -np.sign(g) * np.maximum(np.abs(g) - self.reg_alpha, 0) / np.maximum(h + self.reg_lambda, 1e-300)
        if self.max_delta_step:
            w = np.clip(w, -self.max_delta_step, self.max_delta_step)
        return np.clip(w, low, high)

    def gain(self, g, h, w):
        return -(2 * g * w + (h + self.reg_lambda) * w * w + 2 * self.reg_alpha * np.abs(w))


@dataclass
class Tree:
    """Nodes by number: the children of k are 2 k + 1 and 2 k + 2. cuts[k] = (feature, last bin on the left, whether missing goes left)."""

    cuts: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    covers: dict[int, float] = field(default_factory=dict)

    def route(self, bins: list[np.ndarray], n: int) -> np.ndarray:
        """The node each row has come to; bins has a feature's bins (-1: missing), None where no cut needs it."""
        node = np.zeros(n, np.int64)
        for k in sorted(self.cuts):
            here = np.flatnonzero(node == k)
            feature, last, left = self.cuts[k]
            x = bins[feature][here]
            node[here] = 2 * k + 2 - np.where(x < 0, left, x <= last)
        return node

    def values(self, bins: list[np.ndarray], n: int) -> np.ndarray:
        node, out = self.route(bins, n), np.zeros(n)
        for k, w in self.leaves.items():
            out[node == k] = w
        return out

    def features(self) -> set[int]:
        return {c[0] for c in self.cuts.values()}


def best_cut(g: np.ndarray, h: np.ndarray, p: Parameters, bounds: tuple[float, float], direction: int) -> tuple[float, int, bool, float, float, float, float] | None:
    """The best cut of one node along one feature: gain, last bin on the left, missing left, and sums of derivatives of both sides. The last
    entry of g and h is of rows without a value. Ties: the lower bin, missing to the right."""
    G, H = g.sum(), h.sum()
    before = p.gain(G, H, p.weight(G, H, *bounds))
    best = None
    gl, hl = np.cumsum(g[:-1]), np.cumsum(h[:-1])
    for left in (False, True):
        a, b = (gl + g[-1], hl + h[-1]) if left else (gl, hl)
        if left and h[-1] == 0:
            continue
        c, d = G - a, H - b
        wl, wr = p.weight(a, b, *bounds), p.weight(c, d, *bounds)
        gain = p.gain(a, b, wl) + p.gain(c, d, wr) - before
        fits = (b >= max(p.min_child_weight, 1e-12)) & (d >= max(p.min_child_weight, 1e-12))
        if direction:
            fits &= direction * (wr - wl) >= 0
        gain = np.where(fits, gain, -np.inf)
        # sums come in any order, so gains that differ in their last digits are ties
        rounded = np.array([float(f"{x:.9g}") for x in gain]) if len(gain) else gain
        k = int(rounded.argmax()) if len(gain) else -1
        if k >= 0 and rounded[k] > LEAST_GAIN and (best is None or rounded[k] > best[0]):
            best = (float(rounded[k]), k, left, float(a[k]), float(b[k]), float(c[k]), float(d[k]))
    return best


def _sample(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Rows in a tree's sample, by a hash of the row's key."""
    x = key.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1342543DE82EF95 + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(float) / _SHARE < share


def _chosen(names: list[int], share: float, *seed: int) -> list[int]:
    """Some of the features, one at least."""
    n = max(1, int(share * len(names)))
    return names if n == len(names) else sorted(np.random.default_rng(seed).choice(names, n, replace=False).tolist())


class Booster:
    """A fitted model: bin edges of each feature, trees, and the history of the validation metric."""

    def __init__(self, features: list[str], edges: list[list[float]], p: Parameters) -> None:
        self.features, self.edges, self.p = features, edges, p
        self.trees: list[Tree] = []
        self.history: list[float] = []
        self.base = math.log(p.base_score / (1 - p.base_score)) if p.logistic else p.base_score

    def bins(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Bins of raw values: the number of edges below the value, -1 for missing."""
        out = []
        for x, e in zip(columns, self.edges, strict=True):
            missing = np.isnan(x) if self.p.missing is None else np.isnan(x) | (x == self.p.missing)
            out.append(np.where(missing, -1, np.searchsorted(np.array(e), x, "left")).astype(np.int16))
        return out

    def margins(self, columns: list[np.ndarray]) -> np.ndarray:
        bins, n = self.bins(columns), len(columns[0])
        return self.base + sum((t.values(bins, n) for t in self.trees), np.zeros(n))

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        """df with a column: the probability of label 1, or the value. Null and NaN are missing values."""
        ship(df.sparkSession)
        model = self

        @F.pandas_udf("double")
        def score(values: pd.DataFrame) -> pd.Series:
            found = model.margins([values[c].to_numpy(float) for c in values.columns])
            return pd.Series(1 / (1 + np.exp(-found)) if model.p.logistic else found)

        columns = F.struct(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.features)])
        return df.withColumn(out, score(columns))

    def importances(self) -> dict[str, float]:
        """Shares of the features that cuts use, by the configured importance."""
        total, count = dict.fromkeys(range(len(self.features)), 0.0), dict.fromkeys(range(len(self.features)), 0)
        kind = self.p.importance_type
        for t in self.trees:
            for k, (f, _, _) in t.cuts.items():
                count[f] += 1
                total[f] += 1.0 if kind == "weight" else t.gains[k] if "gain" in kind else t.covers[k]
        found = {f: total[f] / count[f] if count[f] and kind in ("gain", "cover") else total[f] for f in total}
        whole = sum(found.values()) or 1.0
        return {self.features[f]: v / whole for f, v in found.items()}

    def to_json(self) -> str:
        known = {k: (sorted(v) if isinstance(v, set) else v) for k, v in vars(self.p).items()}
        return json.dumps({"features": self.features, "edges": self.edges, "parameters": known, "history": self.history, "trees": [[list(map(list, d.items())) for d in (t.cuts, t.leaves, t.gains, t.covers)] for t in self.trees]})

    def save(self, path: str) -> None:
        """One row of text in a folder that Spark can write."""
        SparkSession.getActiveSession().createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str) -> Booster:
        return Booster.from_json(SparkSession.getActiveSession().read.text(path).first()[0])

    @staticmethod
    def from_json(text: str) -> Booster:
        d = json.loads(text)
        model = Booster(d["features"], d["edges"], Parameters(**d["parameters"]))
        model.history = d["history"]
        model.trees = [Tree({k: tuple(v) for k, v in cuts}, dict(map(tuple, leaves)), dict(map(tuple, gains)), dict(map(tuple, covers))) for cuts, leaves, gains, covers in d["trees"]]
        return model


def fit(df: DataFrame, features: list[str], label: str, parameters: Parameters | None = None, validation: str | None = None, key: str | None = None) -> Booster:
    """validation: a boolean column that marks the rows whose metric stops the rounds early; they teach nothing. key: a column whose hash decides
    which samples a row is in, all values of the row without it; so a sample doesn't depend on how rows are partitioned.

    Rows without a label take no part; null and NaN values are missing and go the way that gains more; a column without values is never cut.
    No rows: no cuts."""
    p = parameters or Parameters()
    ship(df.sparkSession)
    rows = df.filter(F.col(label).isNotNull())
    xs = [f"x{k}" for k in range(len(features))]
    held_out = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    named = [F.col(c).cast("double").alias(x) for c, x in zip(features, xs, strict=True)]
    basis = [F.col(key)] if key else [F.col(label), *[F.col(c) for c in features]]
    values = rows.select(*named, F.col(label).cast("double").alias("y"), held_out.alias("held"), F.xxhash64(*basis).alias("key"))
    if p.missing is not None:
        values = values.withColumns({x: F.when(F.col(x) != p.missing, F.col(x)) for x in xs})
    teaching = values.filter(~F.col("held"))
    model = Booster(features, _edges(teaching, xs, p.max_bin), p)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.bins([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(xs))])
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), *b.columns[len(xs) :], pa.array(np.full(b.num_rows, model.base))], names=[*xs, "y", "held", "key", "margin"])

    state = cut(values.mapInArrow(to_bins, ", ".join([*(f"{x} short" for x in xs), "y double, held boolean, key long, margin double"])))
    pending: list[Tree] = []
    best, best_at = None, 0
    for turn in range(p.n_estimators):
        grown = [_grow(state, pending, model, turn * p.num_parallel_tree + k) for k in range(p.num_parallel_tree)]
        model.trees += grown
        pending = [*pending, *grown]
        if len(pending) >= FLUSH:
            state, pending = cut(_with_margins(state, pending, len(xs))), []
        if validation:
            model.history.append(_metric(_with_margins(state, pending, len(xs)).filter("held"), p))
            better = best is None or (model.history[-1] > best if p.eval_metric == "auc" else model.history[-1] < best)
            if better:
                best, best_at = model.history[-1], turn
            elif p.early_stopping_rounds and turn - best_at >= p.early_stopping_rounds:
                model.trees = model.trees[: (best_at + 1) * p.num_parallel_tree]
                break
    return model


def _edges(values: DataFrame, xs: list[str], bins: int) -> list[list[float]]:
    """Inner edges of each feature: its distinct values but the last where there are few, else its quantiles."""
    counts = values.agg(*[F.approx_count_distinct(x).alias(x) for x in xs]).first() if xs else {}
    small = [x for x in xs if counts[x] <= bins]
    found = {x: [] for x in xs}
    if small:
        rows = values.select(*small).unpivot([], small, "x", "v").filter("v IS NOT NULL AND NOT isnan(v)").groupBy("x", "v").count()
        for x, v in sorted(rows.select("x", "v").collect()):  # about `bins` values a feature, by the estimate of their number
            found[x].append(v)
    many = [x for x in xs if x not in small or len(found[x]) > bins]
    cuts = all_quantile_cuts(values, many, bins) if many else {}
    return [cuts[x] if x in cuts else found[x][:-1] for x in xs]


def _bins_of(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [batch.column(f"x{k}").to_numpy() if f"x{k}" in batch.schema.names else None for k in range(n)]


def _with_margins(state: DataFrame, pending: list[Tree], n: int) -> DataFrame:
    """state with the pending trees' values added to the margins."""
    if not pending:
        return state

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margin = b.column("margin").to_numpy() + sum(t.values(_bins_of(b, n), b.num_rows) for t in pending)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(margin)], names=b.schema.names)

    return state.mapInArrow(add, state.schema)


def _metric(rows: DataFrame, p: Parameters) -> float:
    m, y = F.col("margin"), F.col("y")
    if p.eval_metric == "auc":
        return evaluate.auc(rows.select(m.alias("score"), y.cast("int").alias("label")), "score", "label").first()[0]
    chance = 1 / (1 + F.exp(-m))
    hidden = F.least(F.greatest(chance, F.lit(1e-15)), F.lit(1 - 1e-15))
    seen = chance if p.logistic else m
    of = {
        "logloss": F.avg(-(y * F.ln(hidden) + (1 - y) * F.ln(1 - hidden))), "error": F.avg(((chance > 0.5).cast("int") != y).cast("int")),
        "rmse": F.sqrt(F.avg((seen - y) * (seen - y))), "mae": F.avg(F.abs(seen - y)),
    }
    if p.eval_metric not in of:
        raise ValueError(f"metric {p.eval_metric} isn't supported")
    return rows.agg(of[p.eval_metric]).first()[0]


def _grow(state: DataFrame, pending: list[Tree], model: Booster, number: int) -> Tree:
    p, n = model.p, len(model.features)
    mine = _chosen(list(range(n)), p.colsample_bytree, p.random_state, number)
    tree, sums, bounds, paths = Tree(), {}, {0: (-np.inf, np.inf)}, {0: frozenset()}
    whole, kept = [0], None
    for depth in range(p.max_depth + 1):
        level = _chosen(mine, p.colsample_bylevel, p.random_state, number, depth) if depth < p.max_depth else mine[:1]
        tried = {k: _allowed(_chosen(level, p.colsample_bynode, p.random_state, number, depth, k), paths[k], p) for k in bounds if k not in tree.leaves and k >= 2**depth - 1}
        if depth == p.max_depth or not tried:
            break
        found, kept = _level(state, pending, tree, model, number, whole, kept, sorted(mine), tried, bounds)
        whole = []
        for k in sorted(tried):
            options = [(gain, -f, where) for f, gain, *where in found.get(k, []) if f in tried[k]]
            if k == 0:
                sums[0] = next((r[-2:] for r in sorted(found.get(0, []))), (0.0, 0.0))
            usable = [o for o in options if o[0] > LEAST_GAIN]
            if not usable:
                continue
            gain, f, (last, left, gl, hl, gr, hr, *_) = max(usable, key=lambda o: (o[0], o[1]))
            tree.cuts[k], tree.gains[k], tree.covers[k] = (-f, last, left), gain, hl + hr
            sums[2 * k + 1], sums[2 * k + 2] = (gl, hl), (gr, hr)
            low, high = bounds[k]
            way = p.monotone_constraints[-f] if -f < len(p.monotone_constraints) else 0
            middle = (float(p.weight(gl, hl, low, high)) + float(p.weight(gr, hr, low, high))) / 2
            bounds[2 * k + 1] = (low, middle) if way > 0 else (middle, high) if way < 0 else (low, high)
            bounds[2 * k + 2] = (middle, high) if way > 0 else (low, middle) if way < 0 else (low, high)
            paths[2 * k + 1] = paths[2 * k + 2] = paths[k] | {-f}
            whole.append(2 * k + 1 if hl <= hr else 2 * k + 2)
        if not whole:
            break
    for k in sorted(tree.cuts, reverse=True):  # cuts that gain less than gamma go, from the leaves up
        if 2 * k + 1 not in tree.cuts and 2 * k + 2 not in tree.cuts and tree.gains[k] < p.gamma:
            del tree.cuts[k], tree.gains[k], tree.covers[k]
    nodes = {0} | {c for k in tree.cuts for c in (2 * k + 1, 2 * k + 2)}
    rate = p.learning_rate / p.num_parallel_tree
    tree.leaves = {k: rate * float(p.weight(*sums.get(k, (0.0, 0.0)), *bounds[k])) for k in nodes - set(tree.cuts)}
    return tree


def _allowed(features: list[int], path: frozenset[int], p: Parameters) -> list[int]:
    """Features that may stand below a path: with interaction constraints, those of a group that holds the whole path."""
    if not p.interaction_constraints or not path:
        return features
    together = set().union(path, *(set(group) for group in p.interaction_constraints if path <= set(group)))
    return [f for f in features if f in together]


def _level(state: DataFrame, pending: list[Tree], tree: Tree, model: Booster, number: int, whole: list[int], kept: DataFrame | None, mine: list[int], tried: dict[int, list[int]], bounds: dict) -> tuple[dict[int, list[tuple]], DataFrame]:
    """Best cuts of the level's nodes by feature, and the written sums of all of them. whole: the nodes that are summed up row by row; the
    sibling of each is its parent's sums, in kept, less its own."""
    p, n = model.p, len(model.features)
    sizes = {f: len(model.edges[f]) + 2 for f in mine}
    needed = sorted(set(mine).union(*(t.features() for t in pending)))
    place = {k: i for i, k in enumerate(whole)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: np.zeros((2, len(whole), sizes[f])) for f in mine}
        some = False
        for b in batches:
            bins, m = _bins_of(b, n), b.num_rows
            key = b.column("key").to_numpy()
            teaches = ~b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            if p.subsample < 1:
                teaches &= _sample(key, p.subsample, p.random_state, number)
            node = tree.route(bins, m)
            at = np.full(m, -1)
            for k, i in place.items():
                at[node == k] = i
            use = np.flatnonzero(teaches & (at >= 0))
            if not len(use):
                continue
            some = True
            margin = b.column("margin").to_numpy() + sum((t.values(bins, m) for t in pending), np.zeros(m))
            g, h = p.derivatives(margin[use], b.column("y").to_numpy()[use])
            for f in mine:
                x = bins[f][use].astype(np.int64)
                cell = at[use] * sizes[f] + np.where(x < 0, sizes[f] - 1, x)
                for row, values in zip(held[f], (g, h), strict=True):
                    row += np.bincount(cell, values, row.size).reshape(row.shape)
        if some:
            lines = [(k, f, held[f][0, i].tolist(), held[f][1, i].tolist()) for k, i in place.items() for f in mine]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), kinds, strict=True)], names=["node", "f", "g", "h"])

    kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    schema = "node long, f int, g array<double>, h array<double>"
    cut_schema = f"{schema}, gain double, last int, to_left boolean, gl double, hl double, gr double, hr double, gs double, hs double"
    parts = state.select(*[f"x{f}" for f in needed], "y", "held", "key", "margin").mapInArrow(sums, schema)
    above = ((F.col("node") - 1) / 2).cast("long")
    parts = parts.select("*", above.alias("above"))

    def decide(own: pa.Table, parents: pa.Table) -> pa.Table:
        lines: list[tuple] = []
        if own.num_rows:
            total: dict[int, np.ndarray] = {}
            f = own.column("f")[0].as_py()
            for r in own.to_pylist():
                total[r["node"]] = total.get(r["node"], 0) + np.array([r["g"], r["h"]])
            if parents.num_rows:
                r = parents.to_pylist()[0]
                k = next(iter(total))
                total[k + 1 if k % 2 else k - 1] = np.array([r["g"], r["h"]]) - total[k]
            for k, (g, h) in sorted(total.items()):
                g, h = np.where(np.abs(g) < 1e-12, 0, g), np.where(h < 1e-12, 0, h)
                way = p.monotone_constraints[f] if f < len(p.monotone_constraints) else 0
                found = best_cut(g, h, p, bounds[k], way) if f in tried.get(k, ()) else None
                lines.append((k, f, g.tolist(), h.tolist(), *(found or (None,) * 7), float(g.sum()), float(h.sum())))
        types = [*kinds, pa.float64(), pa.int32(), pa.bool_(), *[pa.float64()] * 6]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True) if lines else [[]] * len(types), types, strict=True)], names=[x.split()[0] for x in cut_schema.split(", ")])

    empty = state.sparkSession.createDataFrame([], schema) if kept is None else kept.select("node", "f", "g", "h")
    decided = cut(parts.groupBy("above", "f").cogroup(empty.withColumnsRenamed({"node": "pnode", "f": "pf"}).groupBy("pnode", "pf")).applyInArrow(decide, cut_schema))
    found: dict[int, list[tuple]] = {}
    for r in decided.drop("g", "h").collect():
        found.setdefault(r["node"], []).append((r["f"], r["gain"] if r["gain"] is not None else -math.inf, r["last"], r["to_left"], r["gl"], r["hl"], r["gr"], r["hr"], r["gs"], r["hs"]))
    return found, decided
