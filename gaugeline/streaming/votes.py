"""Smoothed scores and alarms by votes on a live stream, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run_id string, index long, ts timestamp, epsilon_adaptive double, epsilon_smooth double, alarm_raw boolean, alarm_filtered boolean"
#: Rows still needed (those of the window before the next one to give, and those not given yet), how many of them were
#: given, the last raw alarms, and the last time.
STATE = "index array<long>, ts array<long>, score array<double>, given long, raw array<boolean>, last long"


def vote_stream(scores: DataFrame, smooth: int = 11, window: int = 8, votes: int = 6, late: str = "10 seconds", idle: str = "1 minute") -> DataFrame:
    """Rows (run_id, index, ts, epsilon_adaptive) with the centred median, the raw alarm and the alarm by votes.

    The same as ``thresholds.apply_phase_threshold`` gives a whole run.  A row
    is given when the rows that its window reaches ahead have come, the last
    ones when the watermark (``late`` behind the latest time) is ``idle`` past the
    run's last row.  State is a window and the last votes of each open run.  A
    row whose index is not over that of one that has come is late, and left out;
    so is one without an index or a time.
    """
    if smooth < 1 or window < 1:
        raise ValueError("windows must be at least one")
    if not 1 <= votes <= window:
        raise ValueError("votes must be from 1 to the window")
    before, ahead = smooth - 1 - (smooth - 1) // 2, (smooth - 1) // 2
    patience = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, ts, score, given, raw, last = state.get if state.exists else ([], [], [], 0, [], None)
        index, ts, score, raw = list(index), list(ts), list(score), list(raw)
        over = state.hasTimedOut
        if not over:
            rows = pd.concat(list(parts)).dropna(subset=["index", "ts"]).sort_values("index", kind="stable")
            for i, t, s in zip(rows["index"].astype("int64"), rows["ts"].astype("datetime64[us]").astype("int64"), rows["epsilon_adaptive"]):
                if not index or i > index[-1]:
                    index.append(int(i))
                    ts.append(int(t))
                    score.append(float(s))
        out = []
        while given < len(index) and (over or given + ahead < len(index)):
            around = [x for x in score[max(0, given - before) : given + ahead + 1] if not np.isnan(x)]
            middle = float(np.median(around)) if around else None
            raw = [*raw, middle is not None and middle > 1][-window:]
            out.append((key[0], index[given], pd.Timestamp(ts[given], unit="us"), score[given], middle, raw[-1], sum(raw) >= votes))
            given += 1
        cut = max(0, min(given - before, len(index) - 1))  # the last row stays: it tells which ones are late
        index, ts, score, given = index[cut:], ts[cut:], score[cut:], given - cut
        if over:
            state.remove()
        elif index:
            state.update((index, ts, score, given, raw, ts[-1]))
            state.setTimeoutTimestamp(max(ts[-1] // 1000 + patience, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    keyed = scores.select("run_id", "index", "ts", "epsilon_adaptive").withWatermark("ts", late).groupBy("run_id")
    return keyed.applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout)
