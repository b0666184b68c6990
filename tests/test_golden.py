"""The toy panel: known mean absolute errors, with the first target taken as a header and without."""

import os

import pytest

from tideweave.operators.learners import Penalty
from tideweave.operators.prep import Split
from tideweave.plans.evaluate import Settings, report
from tideweave.sources import files
from tideweave.sources.panels import to_panel

#: The toy panel that the errors below belong to.
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "toy")

#: Mean absolute error of each method, header taken from the targets and not.
WANT = {
    True: {
        "mean": 0.750308252, "last_timestep": 0.78125, "best_model": 0.6459944, "bandits_full": 0.701168662, "bandits_recent": 0.617052824,
        "PA": 0.640466212, "ridge": 0.779386452, "adaptive_ridge_exact": 0.500551811, "adaptive_ridge_standard": 0.746725566,
        "adaptive_ridge_exact_err_rule": 0.252661687, "adaptive_ridge_standard_err_rule": 0.52400372,
    },
    False: {
        "mean": 0.522083611, "last_timestep": 0.75, "best_model": 0.28214364, "bandits_full": 0.451723084, "bandits_recent": 0.419141188,
        "PA": 0.311058713, "ridge": 0.650169897, "adaptive_ridge_exact": 1.954287895, "adaptive_ridge_standard": 2.123954304,
        "adaptive_ridge_exact_err_rule": 1.286097544, "adaptive_ridge_standard_err_rule": 1.391723788,
    },
}


@pytest.mark.parametrize("header", [True, False])
def test_toy_panel(spark, header):
    wide = files.aligned(files.read_forecasts(spark, f"{DATA}/X.csv"), files.read_target(spark, f"{DATA}/y.csv", header), "toy")
    panel = to_panel(wide, [f"pred_model{k}" for k in range(1, 7)])
    settings = Settings(Split(0.5, 2, 100, 5), Penalty(0.01, 0.01, 0.1), 6, best_with_intercept=header)
    got = {r["method"]: r["mae"] for r in report(panel, settings).collect()}
    assert got == pytest.approx(WANT[header], abs=1e-6)
