"""CRFs and recurrent nets: derivatives by numeric differences, sums over all paths, and learning curves."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import neural, training


def batch(rng, lengths, width):
    return training.padded([rng.normal(size=(n, width)).tolist() for n in lengths])


def paths(n, k):
    return product(range(k), repeat=n)


def test_crf_sums_over_all_paths():
    """Partition, marginals and expected moves of padded sequences against all their paths."""
    rng = np.random.default_rng(1)
    e, mask = batch(rng, [4, 1, 3], 3)
    moves, start, stop = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    log_z, marginal, expected, ending = training.crf_pass(e, mask, moves, start, stop)
    total = np.zeros((3, 3))
    for row, n in enumerate([4, 1, 3]):
        scores = {p: start[p[0]] + stop[p[-1]] + sum(e[row, t, p[t]] for t in range(n)) + sum(moves[b, a] for a, b in zip(p, p[1:])) for p in paths(n, 3)}
        z = sum(map(np.exp, scores.values()))
        assert log_z[row] == pytest.approx(np.log(z))
        for t, tag in product(range(n), range(3)):
            assert marginal[row, t, tag] == pytest.approx(sum(np.exp(s) for p, s in scores.items() if p[t] == tag) / z)
        assert not marginal[row, n:].any() and ending[row] == pytest.approx(marginal[row, n - 1])
        for p, s in scores.items():
            for a, b in zip(p, p[1:]):
                total[b, a] += np.exp(s) / z
        assert training.crf_decode(e, mask, moves, start, stop)[row] == list(max(scores, key=scores.get))
        tags = np.zeros((3, 4), int)
        assert training.crf_loss(e, mask, tags, moves, start, stop)[0][row] == pytest.approx(neural.negative_log_likelihood(e[row, :n], moves, [0] * n, start, stop))
    assert expected == pytest.approx(total)


@pytest.mark.parametrize("head", ["class", "crf"])
@pytest.mark.parametrize(("kind", "layers", "two_way"), [("lstm", 1, True), ("gru", 2, True), ("lstm", 2, False), ("gru", 0, False)])
def test_derivatives(head, kind, layers, two_way):
    """Every parameter's derivative by numeric differences, over sequences of different lengths."""
    if layers == 0 and head == "class":
        pytest.skip("a class is read from a state")
    rng = np.random.default_rng(2)
    net = training.SequenceNet(3, 4, head, kind, hidden=3, layers=layers, two_way=two_way, forbidden=((0, 1), (None, 2), (3, None)) if head == "crf" else ())
    net = net.with_vector(net.vector() + rng.normal(size=len(net.vector())) / 5)
    x, mask = batch(rng, [5, 2, 1], 3)
    y = rng.integers(0, 4, 3) if head == "class" else np.array([[0, 2, 2, 1, 1], [1, 0, 0, 0, 0], [0, 0, 0, 0, 0]])
    _, by = net.loss(x, mask, y)
    at = net.vector()
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-5
        numeric = (net.with_vector(at + step).loss(x, mask, y)[0].sum() - net.with_vector(at - step).loss(x, mask, y)[0].sum()) / 2e-5
        assert by[k] == pytest.approx(numeric, abs=2e-6)


def test_padding_changes_nothing():
    rng = np.random.default_rng(3)
    for head in ("class", "crf"):
        net = training.SequenceNet(2, 3, head, "gru", hidden=4)
        lone, longer = rng.normal(size=(2, 2)).tolist(), rng.normal(size=(7, 2)).tolist()
        alone, together = net.forward(*training.padded([lone]))[0], net.forward(*training.padded([lone, longer]))[0]
        assert together[0] == pytest.approx(alone[0]) if head == "class" else together[0, :2] == pytest.approx(alone[0])


def test_forward_equals_the_stored_nets():
    """The same weights give what the forward-only nets give."""
    rng = np.random.default_rng(4)
    for kind in ("lstm", "gru"):
        net = training.SequenceNet(3, 2, "crf", kind, hidden=4, layers=2)
        old = neural.Recurrent(kind, 4, [[net._layer(layer, side) for side in (0, 1)] for layer in (0, 1)])
        x = rng.normal(size=(2, 6, 3))
        assert net.forward(x, np.ones((2, 6)))[1][1] == pytest.approx(old.forward(x))


def tagged(n, seed):
    """Noisy emissions of tags that mostly follow 0 1 2 0 1 2: the moves tell more than the emissions."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        tags = [(int(rng.integers(3)) + t) % 3 for t in range(int(rng.integers(1, 12)))]
        first = int(rng.integers(3))
        tags = [(first + t) % 3 for t in range(len(tags))]
        rows.append((k, [(np.eye(3)[t] + rng.normal(0, 0.9, 3)).tolist() for t in tags], tags))
    return rows + [(n, None, [1]), (n + 1, [], []), (n + 2, [[1.0, 0.0, 0.0]], None), (n + 3, [[1.0, 0.0, 0.0]], [0, 1])]


def test_crf_learns_moves(spark):
    """Decoding after training beats emissions alone; the curve is the same for any partitioning; forbidden moves are never taken."""
    schema = "id int, x array<array<double>>, tags array<int>"
    train, held = spark.createDataFrame(tagged(150, 5), schema), spark.createDataFrame(tagged(80, 6), schema)
    net = training.SequenceNet(3, 3, "crf", layers=0, two_way=False, forbidden=((0, 0), (1, 1)))
    curves = []
    for parts in (2, 5):
        best, history = training.fit(net, train.repartition(parts), held, "x", "tags", epochs=12, batches=2, rate=0.2)
        curves.append(history)
    assert np.array(curves[0]) == pytest.approx(np.array(curves[1]))
    rows = best.predict(held, "x").collect()
    good = [r for r in rows if r["x"] and r["tags"] and len(r["x"]) == len(r["tags"])]
    alone = np.mean([int(np.argmax(v)) == t for r in good for v, t in zip(r["x"], r["tags"])])
    together = np.mean([p == t for r in good for p, t in zip(r["predicted"], r["tags"])])
    assert together > alone + 0.1 and history[-1][1] < history[0][1]
    assert all((a, b) not in {(0, 0), (1, 1)} for r in good for a, b in zip(r["predicted"], r["predicted"][1:]))
    assert {r["id"]: r["predicted"] for r in rows}[80] is None


def test_recurrent_class_is_learnt(spark):
    """Which half of a sequence is larger: a class that needs its order. Early stopping returns the best epoch."""
    rng, rows = np.random.default_rng(7), []
    for k in range(300):
        x = rng.normal(size=(int(rng.integers(4, 9)), 1))
        up = int(k % 2)
        x[len(x) // 2 :] += 2 if up else -2
        rows.append((k, x.tolist(), up))
    df = spark.createDataFrame(rows, "id int, x array<array<double>>, y int").repartition(3)
    train, held = df.filter("id >= 100"), df.filter("id < 100")
    net = training.SequenceNet(1, 2, "class", "gru", hidden=4)
    best, history = training.fit(net, train, held, "x", "y", epochs=10, batches=2, rate=0.1, patience=2)
    assert training.mean_loss(best, held, "x", "y")[1] > 0.9
    assert training.mean_loss(best, held, "x", "y")[0] == pytest.approx(min(h[1] for h in history))
    assert best.predict(held, "x").filter(F.col("predicted") == F.col("y")).count() > 90


def test_no_rows(spark):
    df = spark.createDataFrame([], "x array<array<double>>, y int")
    with pytest.raises(ValueError):
        training.fit(training.SequenceNet(1, 2), df, df, "x", "y")
