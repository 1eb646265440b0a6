"""The registered career-window queries match the oracle end to end on the
prefix scan, the only path."""

import os
import sys

import pytest

from conftest import SF_CHECK

KEYS = ["residual_running_game", "residual_running_year", "win_dense_rank", "market_residual_series",
        "player_timeline", "win_running_range"]


@pytest.mark.parametrize("key", KEYS)
def test_prefix_scan_matches_oracle(spark, key):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from check_oracle import check
    rec = check(spark, SF_CHECK, [key], verbose=False)[key]
    assert "error" not in rec, rec
    assert rec["cols_match"] and rec["approx"], rec
