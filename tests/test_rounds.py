"""Work in rounds: slowly varying weights in stretches, branch and bound, cutting planes."""

import itertools

import numpy as np
import pytest

from tideweave.operators import adversary, slow_lad
from tideweave.operators.adversary import Tube
from tideweave.operators.slow_lad import Slow, features


def chain_rows(names, n, p, q, seed):
    """Series whose weights drift, with noise of heavy tails."""
    r, out = np.random.default_rng(seed), []
    for s in names:
        x, z = np.column_stack([np.ones(n), r.normal(size=(n, p - 1))]), np.column_stack([r.normal(size=(n, q - 1)), np.ones(n)])
        y = (x * np.cumsum(r.normal(size=(n, p)) * 0.05, axis=0)).sum(axis=1) + r.standard_t(2, size=n) * 0.1
        out += [(s, k + 11, x[k].tolist(), z[k].tolist(), float(y[k])) for k in range(n)]
    return out


def path_objective(rows, b0, v, spec):
    x, z, y = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    q = z.shape[1]
    off = y - x @ b0 - (features(x, z) * v).sum(axis=1)
    return np.abs(off).mean() + spec.rho * (b0[1:] ** 2).sum() + spec.rho_v * (v[:, q:] ** 2).sum() / len(y)


@pytest.fixture(scope="module")
def chain(spark):
    rows = chain_rows("ab", 90, 2, 3, 5) + [("one", 7, [1.0, 2.0], [1.0, 0.5, 1.0], 3.0)]
    return rows, spark.createDataFrame(rows, "series string, t long, x array<double>, z array<double>, y double")


def test_slow_weights_are_proven_in_stretches(chain):
    rows, frame = chain
    spec = Slow(delta=0.01)
    found = {r["series"]: r for r in slow_lad.slow_lad(frame, spec, 9, 32).collect()}
    assert {s: r["n_rows"] for s, r in found.items()} == {"a": 90, "b": 90, "one": 1}
    for s, r in found.items():
        # weak duality: no weights have an objective under objective - gap
        assert 0 <= r["gap"] < 0.008 + 0.2 * r["objective"], (s, r["objective"], r["gap"])
    paths = slow_lad.slow_paths(frame, spec, 9, 32).orderBy("series", "t").toPandas()
    for s, part in paths.groupby("series"):
        v, b0 = np.stack(part["v"].to_numpy()), np.array(part["b0"].iloc[0])
        mine = [r for r in rows if r[0] == s]
        assert part["t"].tolist() == [r[1] for r in mine]
        assert np.linalg.norm(np.diff(v, axis=0), axis=1).max(initial=0) <= spec.longest * (1 + 1e-9)  # also over the borders of stretches
        assert abs(path_objective(mine, b0, v, spec) - found[s]["objective"]) < 1e-9
        theta = np.array(found[s]["theta"]).reshape(2, 4)
        assert np.allclose(theta[:, 0], b0) and np.allclose(theta[:, 1:].ravel(), v[-1])


def test_no_other_slow_path_is_under_the_bound(chain):
    rows, frame = chain
    spec, r = Slow(delta=0.01), np.random.default_rng(3)
    found = {x["series"]: x for x in slow_lad.slow_lad(frame, spec, 4, 32).collect()}
    paths = slow_lad.slow_paths(frame, spec, 4, 90).toPandas().sort_values(["series", "t"])
    for s in "ab":
        part, mine = paths[paths["series"] == s], [x for x in rows if x[0] == s]
        v, b0 = np.stack(part["v"].to_numpy()), np.array(part["b0"].iloc[0])
        bound = found[s]["objective"] - found[s]["gap"]
        for _ in range(200):
            other = v.mean(axis=0) + r.uniform(0, 1) * (v - v.mean(axis=0)) + r.normal(size=v.shape[1]) * 0.05  # steps don't get longer
            assert path_objective(mine, b0 + r.normal(size=2) * 0.02, other, spec) >= bound - 1e-12


def brute(rows, base, share, tube):
    """The worst corner by enumeration."""
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    ys = np.array(list(itertools.product(*[(v - share * abs(v), v + share * abs(v)) for v in y])))
    upper, lower = adversary.losses(x, ys, np.array(base), tube)[:2]
    return lower.max(), upper.max()


@pytest.fixture(scope="module")
def game(spark):
    r = np.random.default_rng(0)
    x = lambda: [1.0, *map(float, r.normal(size=2))]
    horizon = [(s, t, x(), float(r.normal())) for s in "abc" for t in range(6)]
    train = [(s, t, f := x(), float(sum(f) + r.normal())) for s in "abc" for t in range(50)]
    base = [(s, list(map(float, r.normal(size=3)))) for s in "abc"]
    schema = "series string, t long, x array<double>, y double"
    return horizon, spark.createDataFrame(horizon, schema), spark.createDataFrame(train, schema), base, spark.createDataFrame(base, "series string, theta array<double>"), train


def test_adversary_equals_enumeration(game):
    horizon, frame, _, base, base_frame, _ = game
    tube = Tube(0.1, 0.05)
    found = {r["series"]: r for r in adversary.adversary(adversary.horizon_cases(frame, base_frame, 0.5), tube).collect()}
    assert sorted(found) == ["a", "b", "c"]
    for s, b in base:
        low, high = brute([r for r in horizon if r[0] == s], b, 0.5, tube)
        r = found[s]
        assert low - 2e-3 * max(1, low) <= r["value"] <= high and r["bound"] >= low
        assert 1 <= r["nodes"] < 2 ** 7 - 1 and 0 <= r["pruned"] <= r["nodes"]  # fewer than all nodes of the tree
    assert any(r["pruned"] for r in found.values())


def test_planes_lie_under_the_losses():
    r = np.random.default_rng(4)
    x, ys, base, tube = r.normal(size=(4, 2)), r.normal(size=(3, 4)), r.normal(size=2), Tube(0.2, 0.1)
    _, lower, _, constant, slope = adversary.losses(x, ys, base, tube)
    assert np.allclose(constant + slope @ base, lower)
    for _ in range(20):
        other = base + r.normal(size=2)
        assert (constant + slope @ other <= adversary.losses(x, ys, other, tube)[0] + 1e-9).all()


def test_cutting_planes_close_the_gap(game):
    horizon, frame, train_frame, _, _, train = game
    tube = Tube(0.1, 0.05)
    found = adversary.worst_case_ridge(train_frame, frame, 0.5, tube, reg=0.2, rho=0.1, threshold=0.02).collect()
    r = np.random.default_rng(6)
    assert sorted(f["series"] for f in found) == ["a", "b", "c"]
    for f in found:
        assert f["gap"] <= 0.02 and f["rounds"] <= 10
        x, y = (np.array([t[k] for t in train if t[0] == f["series"]]) for k in (2, 3))
        mine = [t for t in horizon if t[0] == f["series"]]

        def whole(b, side):
            return ((y - x @ b) ** 2).mean() + 0.1 * b @ b + 0.2 * brute(mine, b, 0.5, tube)[side]

        theta = np.array(f["theta"])
        assert whole(theta, 0) <= f["objective"] + 1e-6
        for _ in range(6):
            assert whole(theta + r.normal(size=3) * 0.1, 1) >= f["below"] - 1e-6
