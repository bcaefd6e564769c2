"""Force and torque runs against nominal runs, from signals to alarms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from gaugeline.operators import mixture, series, thresholds
from gaugeline.sources.shared import settle

INPUTS = ["phase"]
OUTPUTS = list(series.WRENCH)


@dataclass
class TimeSeriesResult:
    segments: DataFrame
    calibration: DataFrame
    threshold: DataFrame
    scores: DataFrame
    alarms: DataFrame


def run(nominal: DataFrame, test: DataFrame, length: int = 500, components: int = 3, inputs=INPUTS, outputs=OUTPUTS, rounds: int = 60, start: str = "parts", restarts: int = 1, segment: dict | None = None, curve: dict | None = None, alarm: dict | None = None) -> TimeSeriesResult:
    """``nominal`` and ``test`` have run_id, seq, time and the wrench channels.

    Every nominal run is scored by a model of the others; those scores give the
    threshold over the phase.  A model of all nominal runs scores the test runs.
    """
    known, _ = series.synchronize(nominal, length, **(segment or {}))
    asked, segments = series.synchronize(test, length, **(segment or {}))
    known = settle(known, "nominal-runs")  # read once a round of each fit
    options = {"components": components, "rounds": rounds, "start": start, "restarts": restarts}
    calibration = mixture.leave_one_out(known, list(inputs), list(outputs), **options)
    table = thresholds.phase_threshold(calibration, **(curve or {}))
    model = mixture.fit(known, list(inputs), list(outputs), **options)[None]
    scores = mixture.score(asked.withColumnRenamed("sample", "index"), model)
    return TimeSeriesResult(segments, calibration, table, scores, thresholds.apply_phase_threshold(scores, table, **(alarm or {})))
