"""Sequence decoding and network forward passes: numpy in Arrow batches, many rows a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.operators.training import BATCH_ROWS, crf_best, crf_pass, padded

#: Rows of a block of queries or keys, on average.
BLOCK_ROWS = 4096


def attend(queries: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Dot-product attention without scaling: each query's weights are the softmax over keys."""
    score = queries @ keys.T
    weight = np.exp(score - score.max(axis=-1, keepdims=True))
    return (weight / weight.sum(axis=-1, keepdims=True)) @ values


def attend_part(queries: np.ndarray, keys: np.ndarray, values: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """attend() over some of the keys, to be merged: for each query the top score, the sum of weights below it and the weighted sum of values."""
    top, weight, total = np.empty(len(queries)), np.empty(len(queries)), np.empty((len(queries), values.shape[1]))
    for a in range(0, len(queries), step):
        part = slice(a, a + step)
        score = queries[part] @ keys.T
        top[part] = score.max(axis=1)
        w = np.exp(score - top[part, None])
        weight[part], total[part] = w.sum(axis=1), w @ values
    return top, weight, total


def merge_parts(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = np.maximum(a[0], b[0])
    x, y = np.exp(a[0] - top), np.exp(b[0] - top)
    return top, a[1] * x + b[1] * y, a[2] * x[:, None] + b[2] * y[:, None]


def self_attention(rows: DataFrame, group_col: str, id_col: str, vector_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id and a (array<double>): the attention of each row over all rows of its group, which are keys and values.

    Rows of a group are dealt to blocks of about block_rows; each pair of a query block and a key block is a unit of work of its own, and the
    parts are merged over the key blocks as they come. Null and empty vectors are no keys and have a null result; rows without a group have none.
    Repeated ids: a row each. Work is the square of a group's size."""
    known = rows.filter(F.col(group_col).isNotNull()).select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    there = F.coalesce(F.size("v"), F.lit(0)) > 0
    vectors = known.filter(there).withColumn("row", F.monotonically_increasing_id())
    sizes = vectors.groupBy("g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = vectors.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    packed = placed.groupBy("g", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("row", "id", "v"))).alias("p"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    queries = packed.select("g", F.col("block").alias("q"), others.alias("k"), F.col("p.id").alias("ids"), F.col("p.v").alias("queries"))
    keys = packed.select("g", others.alias("q"), F.col("block").alias("k"), F.col("p.v").alias("keys"))
    pairs = queries.join(keys, ["g", "q", "k"]).select("g", "q", "ids", "queries", "keys")

    def attend_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                k = _block(row.column("keys"))
                found = attend_part(_block(row.column("queries")), k, k)
                parts = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in found]
                yield pa.RecordBatch.from_arrays([*row.columns[:3], *parts], names=["g", "q", "ids", "top", "weight", "total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = state = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                top, weight, total = (row.column(c).flatten().to_numpy() for c in ("top", "weight", "total"))
                part = top, weight, total.reshape(len(top), -1)
                ids, state = row.column("ids").flatten(), part if state is None else merge_parts(state, part)
        out = state[2] / state[1][:, None]
        yield pa.RecordBatch.from_arrays([ids, pa.array(list(out), pa.list_(pa.float64()))], names=["id", "a"])

    types = dict(known.dtypes)
    parts = pairs.mapInArrow(attend_pairs, f"g {types['g']}, q int, ids array<{types['id']}>, top array<double>, weight array<double>, total array<double>")
    found = parts.groupBy("g", "q").applyInArrow(merge, f"id {types['id']}, a array<double>")
    return found.unionByName(known.filter(~there).select("id", F.lit(None).cast("array<double>").alias("a")))


def _block(column: pa.Array) -> np.ndarray:
    """The matrix in the one row of a column of arrays of arrays."""
    rows = column.flatten()
    sizes = set(rows.value_lengths().to_pylist())
    if len(sizes) != 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def attention_udf() -> Callable[[Column, Column, Column], Column]:
    """A column function of a query (array), keys and values (arrays of arrays) to an array<double>; null where one is null or empty."""

    @F.pandas_udf("array<double>")
    def run(query: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for q, k, v in zip(query, keys, values, strict=True):
            empty = q is None or k is None or v is None or not len(k)
            out.append(None if empty else attend(np.asarray(q, float)[None], _matrix(k), _matrix(v))[0].tolist())
        return pd.Series(out)

    return run


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in rows])


def viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[float, list[int]]:
    """Best score and tag path; transitions are [to][from]. Ties go to the lower tag."""
    score = emissions[0] + (0 if start is None else start)
    back = []
    for step in emissions[1:]:
        through = score[None, :] + transitions
        back.append(through.argmax(axis=1))
        score = through.max(axis=1) + step
    if stop is not None:
        score = score + stop
    path = [int(score.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return float(score.max()), path[::-1]


def log_partition(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> float:
    """Log of the sum over all paths (forward algorithm)."""
    score = emissions[0] + (0 if start is None else start)
    for step in emissions[1:]:
        through = score[None, :] + transitions
        top = through.max(axis=1)
        score = top + np.log(np.exp(through - top[:, None]).sum(axis=1)) + step
    if stop is not None:
        score = score + stop
    return float(score.max() + np.log(np.exp(score - score.max()).sum()))


def path_score(emissions: np.ndarray, transitions: np.ndarray, tags: list[int], start: np.ndarray | None = None, stop: np.ndarray | None = None) -> float:
    total = sum(emissions[t, tag] for t, tag in enumerate(tags)) + sum(transitions[b, a] for a, b in zip(tags, tags[1:], strict=False))
    return float(total + (0 if start is None else start[tags[0]]) + (0 if stop is None else stop[tags[-1]]))


def negative_log_likelihood(emissions: np.ndarray, transitions: np.ndarray, tags: list[int], start=None, stop=None) -> float:
    return log_partition(emissions, transitions, start, stop) - path_score(emissions, transitions, tags, start, stop)


def forbid(transitions: np.ndarray, start_tag: int, stop_tag: int, penalty: float = -10_000.0) -> np.ndarray:
    """No path enters the start tag or leaves the stop tag."""
    out = transitions.copy()
    out[start_tag, :], out[:, stop_tag] = penalty, penalty
    return out


def _in_batches(values: pd.Series, run: Callable[[list], list]) -> list:
    """run() over lists of the values that are there, some at a time; None for the others."""
    out = [None] * len(values)
    there = [k for k, v in enumerate(values) if v is not None and len(v)]
    for at in range(0, len(there), BATCH_ROWS):
        mine = there[at : at + BATCH_ROWS]
        for k, found in zip(mine, run([values.iloc[j] for j in mine]), strict=True):
            out[k] = found
    return out


def viterbi_udf(transitions: np.ndarray) -> Callable[[Column], Column]:
    """A column function: emissions (array<array<double>>) to struct<score, path>; null for a null or empty sequence. Sequences are decoded in padded batches."""
    ends = np.zeros(len(transitions))

    def best(sequences: list) -> list:
        score, path = crf_best(*padded(sequences), transitions, ends, ends)
        return list(zip(score.tolist(), path, strict=True))

    @F.pandas_udf("score double, path array<int>")
    def decode(emissions: pd.Series) -> pd.DataFrame:
        found = [f or (None, None) for f in _in_batches(emissions, best)]
        return pd.DataFrame({"score": [s for s, _ in found], "path": [p for _, p in found]})

    return decode


def log_partition_udf(transitions: np.ndarray) -> Callable[[Column], Column]:
    ends = np.zeros(len(transitions))

    @F.pandas_udf("double")
    def total(emissions: pd.Series) -> pd.Series:
        return pd.Series(_in_batches(emissions, lambda s: crf_pass(*padded(s), transitions, ends, ends)[0].tolist()), dtype=object)

    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Recurrent:
    """LSTM or GRU, several layers, optionally in both directions (concatenated); all steps come out.

    weights: one dictionary for each layer and direction with W (gates x input), U (gates x hidden), b (gates) and, for the GRU, c (gates, inside
    the reset product). Gate order: input, forget, cell, output (LSTM); reset, update, new (GRU)."""

    def __init__(self, kind: str, hidden: int, weights: list[list[dict[str, np.ndarray]]]) -> None:
        if kind not in ("lstm", "gru"):
            raise ValueError(kind)
        self.kind, self.hidden, self.weights = kind, hidden, weights

    def forward(self, x: np.ndarray) -> np.ndarray:
        """[steps, features] or [batch, steps, features] to the same with directions * hidden features."""
        single = x.ndim == 2
        out = x[None] if single else x
        for layer in self.weights:
            sides = [self._run(out, layer[0])]
            if len(layer) > 1:
                sides.append(self._run(out[:, ::-1], layer[1])[:, ::-1])
            out = np.concatenate(sides, axis=-1)
        return out[0] if single else out

    def _run(self, x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
        h = np.zeros((len(x), self.hidden))
        c, n, out = h, self.hidden, []
        for t in range(x.shape[1]):
            a = x[:, t] @ w["W"].T + w["b"]
            r = h @ w["U"].T
            if self.kind == "lstm":
                i, f, g, o = (a + r)[:, :n], (a + r)[:, n : 2 * n], (a + r)[:, 2 * n : 3 * n], (a + r)[:, 3 * n :]
                c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
                h = _sigmoid(o) * np.tanh(c)
            else:
                inner = r + w.get("c", 0)
                reset, update = _sigmoid((a + inner)[:, :n]), _sigmoid((a + inner)[:, n : 2 * n])
                new = np.tanh(a[:, 2 * n :] + reset * inner[:, 2 * n :])
                h = (1 - update) * new + update * h
            out.append(h)
        return np.stack(out, axis=1)


def dense(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear layers with ReLU between them."""
    for k, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0)
    return x


def dense_udf(layers: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[Column], Column]:
    """A column function of dense(): an array of numbers to an array<double>; null for null."""

    def all_of(vectors: list) -> list:
        return dense(np.stack([np.asarray(v, float) for v in vectors]), layers).tolist()

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series(_in_batches(vectors, all_of), dtype=object)

    return run


def encode_udf(forward: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """Any forward pass over [steps, features] or [batch, steps, features] (a recurrent network, a pretrained encoder) as a column function to
    array<array<double>>. Sequences of one length go through it together."""

    def all_of(sequences: list) -> list:
        out: list = [None] * len(sequences)
        for n in {len(s) for s in sequences}:
            mine = [k for k, s in enumerate(sequences) if len(s) == n]
            for k, found in zip(mine, forward(np.stack([_matrix(sequences[k]) for k in mine])), strict=True):
                out[k] = found.tolist()
        return out

    @F.pandas_udf("array<array<double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sequences in parts:
            yield pd.Series(_in_batches(sequences, all_of), dtype=object)

    return run


def train_perceptron(train: DataFrame, validation: DataFrame, features: str, label: str, layers: list[int], epochs: int = 100, step: int = 10, patience: int = 3, seed: int = 7):
    """A multilayer perceptron trained in steps from its last weights; ends early by the validation accuracy. Returns model and history."""
    from scorewright.operators.text import early_stop

    weights, history, model = None, [], None
    for _ in range(0, epochs, step):
        made = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, maxIter=step, seed=seed)
        if weights is not None:
            made.setInitialWeights(weights)
        model = made.fit(train)
        weights = model.weights
        row = model.transform(validation).agg(F.avg((F.col("prediction") == F.col(label)).cast("int"))).first()
        history.append(row[0])
        if early_stop(history, patience):
            break
    return model, history
