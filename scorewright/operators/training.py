"""Training of linear-chain CRFs and recurrent nets by gradient sums over partitions.

A step is one job: each task pads its sequences to batches, runs them through the net and back, and adds the gradients of its rows up; partial
sums are added up again in groups, so that a bounded number of vectors of the model's size reaches the driver. The driver holds the
parameters and the optimiser's state, nothing of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.operators.text import early_stop
from scorewright.shipping import ship

#: Sequences of one padded batch, groups of partial sums, and the score of a move that is forbidden.
BATCH_ROWS = 128
GROUPS = 32
FORBIDDEN = -10_000.0


def summed(df: DataFrame, compute: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of compute(batch) over all rows of df: vectors of one length, added up by partition, then by group of partitions."""
    ship(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                found = compute(batch.slice(at, BATCH_ROWS))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["g", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, 0
        for batch in batches:
            for g, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                group, total = g, total + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["g", "v"])

    rows = df.mapInArrow(partial, "g int, v array<double>").groupBy("g").applyInArrow(add, "g int, v array<double>").collect()
    return np.sum([np.array(r["v"]) for r in sorted(rows, key=lambda r: r["g"])], axis=0) if rows else np.zeros(0)


def padded(sequences: list) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of different lengths as [batch, steps, features], and a mask of the steps that are there."""
    longest, width = max(map(len, sequences)), len(sequences[0][0])
    x, mask = np.zeros((len(sequences), longest, width)), np.zeros((len(sequences), longest))
    for k, s in enumerate(sequences):
        x[k, : len(s)], mask[k, : len(s)] = np.stack([np.asarray(v, float) for v in s]), 1
    return x, mask


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_pass(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward over a padded batch: log of the sum over all paths, each step's tag marginals [batch, steps, tags], the expected
    moves [to, from] of all sequences, and the marginals of the last tags. Scores are added along start, emissions, moves and stop."""
    n, steps, tags = e.shape
    before = np.empty((n, steps, tags))
    before[:, 0] = e[:, 0] + start
    for t in range(1, steps):
        on = _log_sum(before[:, t - 1, None, :] + moves, 2) + e[:, t]
        before[:, t] = np.where(mask[:, t, None] > 0, on, before[:, t - 1])
    log_z = _log_sum(before[:, -1] + stop, 1)
    after = np.empty((n, steps, tags))
    after[:, -1] = stop
    expected = np.zeros((tags, tags))
    for t in range(steps - 1, 0, -1):
        ahead = e[:, t] + after[:, t]
        through = before[:, t - 1, None, :] + moves + ahead[:, :, None] - log_z[:, None, None]
        expected += (np.exp(through) * mask[:, t, None, None]).sum(axis=0)
        back = _log_sum(moves.T + ahead[:, None, :], 2)
        after[:, t - 1] = np.where(mask[:, t, None] > 0, back, after[:, t])
    marginal = np.exp(before + after - log_z[:, None, None]) * mask[..., None]
    last = mask.sum(axis=1).astype(int) - 1
    return log_z, marginal, expected, marginal[np.arange(n), last]


def crf_loss(e: np.ndarray, mask: np.ndarray, tags: np.ndarray, moves: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each sequence's negative log-likelihood, and the derivatives of their sum by emissions, moves, start and stop."""
    log_z, marginal, expected, ending = crf_pass(e, mask, moves, start, stop)
    n, steps, k = e.shape
    row, last = np.arange(n), mask.sum(axis=1).astype(int) - 1
    inner = mask[:, 1:] > 0
    score = (np.take_along_axis(e, tags[..., None], 2)[..., 0] * mask).sum(axis=1) + start[tags[:, 0]] + stop[tags[row, last]]
    score += (moves[tags[:, 1:], tags[:, :-1]] * inner).sum(axis=1)
    by_e = marginal.copy()
    by_e[row[:, None], np.arange(steps), tags] -= mask
    by_moves = expected.copy()
    np.subtract.at(by_moves, (tags[:, 1:][inner], tags[:, :-1][inner]), 1)
    by_start, by_stop = marginal[:, 0].sum(axis=0), ending.sum(axis=0)
    np.subtract.at(by_start, tags[:, 0], 1)
    np.subtract.at(by_stop, tags[row, last], 1)
    return log_z - score, by_e, by_moves, by_start, by_stop


def crf_decode(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[list[int]]:
    return crf_best(e, mask, moves, start, stop)[1]


def crf_best(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Scores and paths of the best tags of a padded batch, all sequences a step at a time. Ties go to the lower tag."""
    n, steps, _ = e.shape
    score, back = e[:, 0] + start, []
    for t in range(1, steps):
        through = score[:, None, :] + moves
        there = mask[:, t, None] > 0
        back.append(np.where(there, through.argmax(axis=2), np.arange(e.shape[2])))
        score = np.where(there, through.max(axis=2) + e[:, t], score)
    at = (score + stop).argmax(axis=1)
    path = [at]
    for pointers in reversed(back):
        path.append(pointers[np.arange(n), path[-1]])
    found = np.stack(path[::-1], axis=1)
    return (score + stop).max(axis=1), [row[: int(m)].tolist() for row, m in zip(found, mask.sum(axis=1), strict=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def recurrent_forward(kind: str, x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], reverse: bool = False) -> tuple[np.ndarray, list]:
    """All states [batch, steps, hidden] of one direction, and what the way back needs. A step that isn't there leaves the state as it is."""
    n, steps = mask.shape
    size = w["U"].shape[1]
    h = np.zeros((n, size))
    c, out, kept = h, np.zeros((n, steps, size)), []
    for t in reversed(range(steps)) if reverse else range(steps):
        m = mask[:, t, None]
        a, r = x[:, t] @ w["W"].T + w["b"], h @ w["U"].T
        if kind == "lstm":
            z = a + r
            i, f, g, o = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), np.tanh(z[:, 2 * size : 3 * size]), _sigmoid(z[:, 3 * size :])
            new_c = f * c + i * g
            new_h = o * np.tanh(new_c)
            kept.append((t, h, c, i, f, g, o, new_c))
            c = m * new_c + (1 - m) * c
        else:
            inner = r + w["c"]
            reset, update = _sigmoid(a[:, :size] + inner[:, :size]), _sigmoid(a[:, size : 2 * size] + inner[:, size : 2 * size])
            new = np.tanh(a[:, 2 * size :] + reset * inner[:, 2 * size :])
            new_h = (1 - update) * new + update * h
            kept.append((t, h, reset, update, new, inner[:, 2 * size :]))
        h = m * new_h + (1 - m) * h
        out[:, t] = h
    return out, kept


def recurrent_backward(kind: str, x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], kept: list, by_out: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Back through time: derivatives by the inputs and by the weights, from those by all states."""
    size = w["U"].shape[1]
    by = {k: np.zeros_like(v) for k, v in w.items()}
    by_x, by_h, by_c = np.zeros_like(x), np.zeros((len(x), size)), np.zeros((len(x), size))
    for step in reversed(kept):
        t, h = step[0], step[1]
        m = mask[:, t, None]
        total = by_h + by_out[:, t]
        mine, by_h = total * m, total * (1 - m)
        if kind == "lstm":
            _, _, c, i, f, g, o, new_c = step
            th = np.tanh(new_c)
            inner_c = by_c * m + mine * o * (1 - th * th)
            z = np.concatenate([inner_c * g * i * (1 - i), inner_c * c * f * (1 - f), inner_c * i * (1 - g * g), mine * th * o * (1 - o)], axis=1)
            by_c = inner_c * f + by_c * (1 - m)
            by["W"] += z.T @ x[:, t]
            by["U"] += z.T @ h
            by["b"] += z.sum(axis=0)
            by_x[:, t] += z @ w["W"]
            by_h = by_h + z @ w["U"]
        else:
            _, _, reset, update, new, last = step
            z_new = mine * (1 - update) * (1 - new * new)
            z_update = mine * (h - new) * update * (1 - update)
            z_reset = z_new * last * reset * (1 - reset)
            a = np.concatenate([z_reset, z_update, z_new], axis=1)
            r = np.concatenate([z_reset, z_update, z_new * reset], axis=1)
            by["W"] += a.T @ x[:, t]
            by["b"] += a.sum(axis=0)
            by["U"] += r.T @ h
            by["c"] += r.sum(axis=0)
            by_x[:, t] += a @ w["W"]
            by_h = by_h + r @ w["U"] + mine * update
    return by_x, by


@dataclass
class SequenceNet:
    """Vectors by step -> layers of LSTM or GRU in one or two directions (none: the vectors themselves) -> a linear layer -> either one class for
    each sequence, from the last states ('class'), or one tag for each step, by a linear-chain CRF ('crf').

    forbidden: moves (from tag, to tag) that no path takes; a tag named with None before it can't begin, with None behind it can't end a path."""

    features: int
    labels: int
    head: str = "class"
    kind: str = "lstm"
    hidden: int = 16
    layers: int = 1
    two_way: bool = True
    forbidden: tuple[tuple[int | None, int | None], ...] = ()
    seed: int = 7
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.head not in ("class", "crf") or self.kind not in ("lstm", "gru"):
            raise ValueError(f"{self.head}, {self.kind}")
        if self.parts:
            return
        rng, gates, width = np.random.default_rng(self.seed), 4 if self.kind == "lstm" else 3, self.features
        for layer in range(self.layers):
            for side in range(1 + self.two_way):
                scale = 1 / np.sqrt(self.hidden)
                for name, shape in (("W", (gates * self.hidden, width)), ("U", (gates * self.hidden, self.hidden)), ("b", (gates * self.hidden,)), ("c", (gates * self.hidden,))):
                    if name != "c" or self.kind == "gru":
                        self.parts[f"{layer}.{side}.{name}"] = rng.uniform(-scale, scale, shape)
            width = self.hidden * (1 + self.two_way)
        self.parts["out.W"], self.parts["out.b"] = rng.uniform(-1, 1, (self.labels, width)) / np.sqrt(width), np.zeros(self.labels)
        if self.head == "crf":
            self.parts |= {"moves": np.zeros((self.labels, self.labels)), "start": np.zeros(self.labels), "stop": np.zeros(self.labels)}

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def with_vector(self, vector: np.ndarray) -> SequenceNet:
        parts, at = {}, 0
        for k, v in self.parts.items():
            parts[k] = vector[at : at + v.size].reshape(v.shape)
            at += v.size
        return SequenceNet(self.features, self.labels, self.head, self.kind, self.hidden, self.layers, self.two_way, self.forbidden, self.seed, parts)

    def scores_of_moves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Moves [to, from], start and stop, with forbidden ones."""
        moves, start, stop = self.parts["moves"].copy(), self.parts["start"].copy(), self.parts["stop"].copy()
        for a, b in self.forbidden:
            if a is None:
                start[b] = FORBIDDEN
            elif b is None:
                stop[a] = FORBIDDEN
            else:
                moves[b, a] = FORBIDDEN
        return moves, start, stop

    def _layer(self, layer: int, side: int) -> dict[str, np.ndarray]:
        head = f"{layer}.{side}."
        return {k[len(head) :]: v for k, v in self.parts.items() if k.startswith(head)}

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Scores of labels ([batch, labels], or [batch, steps, labels] for the CRF), and what the way back needs."""
        kept, out = [], x
        for layer in range(self.layers):
            sides = [recurrent_forward(self.kind, out, mask, self._layer(layer, side), side == 1) for side in range(1 + self.two_way)]
            kept.append((out, [k for _, k in sides]))
            out = np.concatenate([o for o, _ in sides], axis=2)
        top = out
        if self.head == "class":
            out = np.concatenate([out[:, -1, : self.hidden], out[:, 0, self.hidden :]], axis=1) if self.layers else out[:, -1]
        return out @ self.parts["out.W"].T + self.parts["out.b"], [kept, top, out]

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses of the sequences, and the derivative of their sum by all parameters, in the order of vector()."""
        scores, (kept, top, last) = self.forward(x, mask)
        by = {}
        if self.head == "class":
            p = scores - _log_sum(scores, 1)[:, None]
            losses = -p[np.arange(len(y)), y]
            by_scores = np.exp(p)
            by_scores[np.arange(len(y)), y] -= 1
            by_last = by_scores @ self.parts["out.W"]
            by_top = np.zeros_like(top)
            by_top[:, -1, : self.hidden] = by_last[:, : self.hidden]
            by_top[:, 0, self.hidden :] += by_last[:, self.hidden :]
            by["out.W"], by["out.b"] = by_scores.T @ last, by_scores.sum(axis=0)
        else:
            losses, by_scores, by["moves"], by["start"], by["stop"] = crf_loss(scores, mask, y, *self.scores_of_moves())
            for a, b in self.forbidden:  # these scores are given
                part, place = ("start", b) if a is None else ("stop", a) if b is None else ("moves", (b, a))
                by[part][place] = 0
            by_top = by_scores @ self.parts["out.W"]
            by["out.W"], by["out.b"] = np.einsum("ntk,ntd->kd", by_scores, top), by_scores.sum(axis=(0, 1))
        for layer in reversed(range(self.layers)):
            below, sides = kept[layer]
            by_below = np.zeros_like(below)
            for side, k in enumerate(sides):
                part = by_top[:, :, side * self.hidden : (side + 1) * self.hidden]
                by_x, found = recurrent_backward(self.kind, below, mask, self._layer(layer, side), k, part)
                by_below += by_x
                by |= {f"{layer}.{side}.{name}": v for name, v in found.items()}
            by_top = by_below
        return losses, np.concatenate([by[k].ravel() for k in self.parts])

    def decode(self, x: np.ndarray, mask: np.ndarray) -> list:
        scores, _ = self.forward(x, mask)
        return scores.argmax(axis=1).tolist() if self.head == "class" else crf_decode(scores, mask, *self.scores_of_moves())

    def right(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        """Right labels (or tags) and all of them."""
        found = self.decode(x, mask)
        if self.head == "class":
            return int((np.array(found) == y).sum()), len(y)
        return sum(a == b for row, tags in zip(found, y.tolist(), strict=True) for a, b in zip(row, tags)), int(mask.sum())

    def predict(self, df: DataFrame, steps: str, out: str = "predicted") -> DataFrame:
        """df with the class (int) or the tags (array<int>) of each sequence; null for a null or empty one."""
        ship(df.sparkSession)
        net = self

        @F.pandas_udf("int" if self.head == "class" else "array<int>")
        def run(sequences: pd.Series) -> pd.Series:
            found = [None] * len(sequences)
            there = [k for k, s in enumerate(sequences) if s is not None and len(s)]
            for at in range(0, len(there), BATCH_ROWS):
                mine = there[at : at + BATCH_ROWS]
                for k, value in zip(mine, net.decode(*padded([sequences[j] for j in mine])), strict=True):
                    found[k] = value
            return pd.Series(found, dtype=object)

        return df.withColumn(out, run(F.col(steps).cast("array<array<double>>")))


def _batch(part: pa.RecordBatch, head: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, mask = padded(part.column(0).to_pylist())
    labels = part.column(1).to_pylist()
    if head == "class":
        return x, mask, np.array(labels)
    y = np.zeros(mask.shape, int)
    for k, tags in enumerate(labels):
        y[k, : len(tags)] = tags
    return x, mask, y


def _rows(df: DataFrame, steps: str, label: str, head: str, keys: list[str] = ()) -> DataFrame:
    """Rows that can teach: null and empty sequences and null labels can't, nor can those with another number of tags than steps."""
    x, y = F.col(steps).cast("array<array<double>>"), F.col(label).cast("int" if head == "class" else "array<int>")
    rows = df.select(x.alias("x"), y.alias("y"), *keys).filter("size(x) > 0 AND y IS NOT NULL")
    return rows if head == "class" else rows.filter("size(x) = size(y)")


def losses(net: SequenceNet, df: DataFrame, steps: str, label: str, keys: list[str], out: str = "loss") -> DataFrame:
    """keys and the loss of each sequence that could teach."""
    ship(df.sparkSession)
    rows = _rows(df, steps, label, net.head, keys)
    schema = ", ".join([*(f"`{k}` {t}" for k, t in rows.select(keys).dtypes), f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = net.loss(*_batch(part, net.head))[0]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(found)], names=[*keys, out])

    return rows.mapInArrow(run, schema)


def mean_loss(net: SequenceNet, df: DataFrame, steps: str, label: str) -> tuple[float, float]:
    """Mean loss of a sequence, and the share of right labels (of tags, for the CRF)."""

    def compute(part: pa.RecordBatch) -> np.ndarray:
        x, mask, y = _batch(part, net.head)
        return np.array([net.loss(x, mask, y)[0].sum(), len(x), *net.right(x, mask, y)])

    found = summed(_rows(df, steps, label, net.head), compute)
    if not len(found):
        raise ValueError("no row with a sequence and a label")
    return float(found[0] / found[1]), float(found[2] / found[3])


def fit(net: SequenceNet, train: DataFrame, validation: DataFrame, steps: str, label: str, epochs: int = 20, batches: int = 1, rate: float = 0.05, patience: int = 3, decay: float = 0.0) -> tuple[SequenceNet, list[tuple[float, float, float]]]:
    """The net of the best epoch, and the learning curve: mean training loss, validation loss and share of right labels of each epoch.

    Adam steps over the whole table, or over `batches` parts of it, dealt by a hash of the rows that changes from epoch to epoch, so the curve doesn't
    depend on how rows are partitioned. Ends early when the validation loss hasn't fallen for `patience` epochs. decay: of squared weights."""
    rows = _rows(train, steps, label, net.head)
    vector, first, second, turn = net.vector(), 0.0, 0.0, 0
    history: list[tuple[float, float, float]] = []
    best = (np.inf, vector)
    for epoch in range(epochs):
        loss = count = 0.0
        for k in range(batches):
            now = net.with_vector(vector)
            mine: Column = F.pmod(F.xxhash64(F.lit(epoch), F.lit(net.seed), "x", "y"), F.lit(batches)) == k

            def compute(part: pa.RecordBatch, now: SequenceNet = now) -> np.ndarray:
                losses, by = now.loss(*_batch(part, now.head))
                return np.concatenate([[losses.sum(), len(losses)], by])

            found = summed(rows.filter(mine) if batches > 1 else rows, compute)
            if not len(found):
                continue
            loss, count = loss + found[0], count + found[1]
            gradient = found[2:] / found[1] + decay * vector
            turn += 1
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            vector = vector - rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        if not count:
            raise ValueError("no row with a sequence and a label")
        held = mean_loss(net.with_vector(vector), validation, steps, label)
        history.append((float(loss / count), *held))
        if held[0] < best[0]:
            best = (held[0], vector)
        if early_stop([-h[1] for h in history], patience):
            break
    return net.with_vector(best[1]), history
