"""The kept steps of a trial, without a session: numpy merging equals sorting all rows."""

import numpy as np
import pandas as pd

from perfweave.streaming.step_stream import COLS, _earliest


class _State:
    def __init__(self, get=None):
        self.exists, self.get = get is not None, get


def test_earliest_steps_in_any_arrival_order():
    rng = np.random.default_rng(4)
    n = 120
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20, n), unit="s")
    log = pd.DataFrame({"ts": ts, "event_id": rng.permutation(n), "loader_ms": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)),
                        "compute_ms": rng.random(n), "oom": rng.random(n) < 0.1, "n_examples": 32, "n_tokens": rng.integers(0, 128, n)})
    log["oom"] = log["oom"].astype(object).where(log.index % 11 != 0, None)
    state = _State()
    assert _earliest([], state, 25) is None
    for at in range(0, n, 40):
        part = log.iloc[at:at + 40]
        kept = _earliest([part.iloc[:15], part.iloc[15:15], part.iloc[15:]], state, 25)
        state = _State(tuple(c.tolist() for c in kept))
    want = log.sort_values(["ts", "event_id"]).head(25)
    got = pd.DataFrame(dict(zip(COLS, kept)))
    assert got["event_id"].tolist() == want["event_id"].tolist() and got["oom"].tolist() == want["oom"].tolist()
    assert got["ts"].tolist() == want["ts"].tolist()
    for c in ("loader_ms", "compute_ms"):
        np.testing.assert_array_equal(got[c], want[c])
