"""STEP and PERSISTENCE on streams: the flags that the batch checks give, whatever the order in which rows arrive.

A row is judged when the watermark has passed it, as all rows before it are there then; rows that come later than that are
dropped by Spark. Each (station, variable) keeps its rows ahead of the watermark, the last judged one, and the
members of a run of equal hourly values while the run is too short to be told: it is flagged as soon as it is
long enough, and let go as soon as it is broken or its next hour has passed. So the state is bounded by the
watermark's delay and the least length of a run. Rows after the last watermark wait for the next run of the query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import contracts as C
from ..operators.qc import PARAMS
from ..workers import ship

HOUR = 3_600_000_000  # microseconds
SCHEMA = "station_id string, variable string, valid_time timestamp, value double, qc_flags int"


class Series:
    """The state of one (station, variable). Rows are [time in microseconds, value or None, flags]."""

    def __init__(self, variable: str, params: Mapping, ahead=(), open_=(), last=None, length=0):
        self.variable, self.limit, self.p = variable, params["step"].get(variable), params["persistence"]
        self.ahead, self.open, self.last, self.length = list(ahead), list(open_), last, length

    def exempt(self, value: float) -> bool:
        calm = self.variable == "wind10m" and value < self.p["wind_calm_exempt_below"]
        return calm or bool(self.p["precip_zero_exempt"]) and self.variable == "precip_1h" and value == 0

    def judged(self, watermark: int) -> Iterator[list]:
        """Rows whose flags are settled now that all rows up to the watermark are there."""
        ready = sorted((r for r in self.ahead if r[0] <= watermark), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        self.ahead = [r for r in self.ahead if r[0] > watermark]
        for time, value, flags in ready:
            hourly = self.last is not None and time - self.last[0] == HOUR and value is not None and self.last[1] is not None
            if hourly and self.limit is not None and abs(value - self.last[1]) > self.limit:
                flags |= C.STEP
            if hourly and value == self.last[1]:
                self.length += 1
            else:
                yield from self.released()
                self.length = 1
            self.last = [time, value]
            self.open.append([time, value, flags])
            if self.length >= self.p["min_repeats_hours"]:
                for r in self.open:
                    yield r if r[1] is None or self.exempt(r[1]) else [*r[:2], r[2] | C.PERSISTENCE]
                self.open = []
        if self.last is not None and self.last[0] + HOUR <= watermark:
            yield from self.released()

    def released(self) -> list[list]:
        out, self.open = self.open, []
        return out

    def wakes_at(self) -> int | None:
        """When the watermark lets the next row be judged."""
        times = [r[0] for r in self.ahead] + ([self.last[0] + HOUR] if self.open else [])
        return min(times, default=None)

    def stored(self) -> str:
        return json.dumps([self.ahead, self.open, self.last, self.length])


def stream_step_persistence(obs: DataFrame, late: str = "2 hours", params: Mapping = PARAMS) -> DataFrame:
    """(station_id, variable, valid_time, value, qc_flags): the stream's rows with STEP and PERSISTENCE added, once each."""
    ship(obs.sparkSession)
    rows = obs.select("station_id", "variable", "valid_time", "value", "qc_flags").withWatermark("valid_time", late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        station, variable = key
        series = Series(variable, params, *(json.loads(state.get[0]) if state.exists else ()))
        if not state.hasTimedOut:
            for b in batches:
                times = b["valid_time"].astype("datetime64[us]").astype("int64").tolist()
                series.ahead += [[t, None if pd.isna(v) else float(v), int(f)] for t, v, f in zip(times, b["value"].tolist(), b["qc_flags"].tolist(), strict=True)]
        watermark = state.getCurrentWatermarkMs()
        out = list(series.judged(watermark * 1000))
        if (wake := series.wakes_at()) is not None:
            state.setTimeoutTimestamp(max(wake // 1000, watermark + 1))
        state.update((series.stored(),))
        if out:
            yield pd.DataFrame({"station_id": station, "variable": variable, "valid_time": pd.to_datetime([r[0] for r in out], unit="us"), "value": pd.array([r[1] for r in out], "Float64").to_numpy(float, na_value=float("nan")), "qc_flags": [r[2] for r in out]})

    return rows.groupBy("station_id", "variable").applyInPandasWithState(run, SCHEMA, "state string", "append", GroupStateTimeout.EventTimeTimeout)
