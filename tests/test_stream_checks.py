"""Streamed STEP and PERSISTENCE equal the batch checks on rows that arrive in any order within the watermark."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gaugemark.operators import qc
from gaugemark.streaming import checks

OBS = "station_id string, variable string, valid_time timestamp, value double, qc_flags int"
T0 = dt.datetime(2024, 1, 1)
PARAMS = qc.PARAMS | {"step": {"t2m": 3.0, "wind10m": 4.0}, "persistence": {"min_repeats_hours": 4, "wind_calm_exempt_below": 2.0, "precip_zero_exempt": True}}


def readings(seed, hours=120):
    r = random.Random(seed)
    out = []
    for station in ("a", "b", "c"):
        for variable in ("t2m", "wind10m", "precip_1h"):
            value = 1.0
            for h in range(hours):
                if r.random() < 0.4:
                    value = float(r.randint(0, 6))
                if r.random() < 0.9:
                    out.append((station, variable, T0 + dt.timedelta(hours=h), None if r.random() < 0.05 else value, r.choice([0, 1])))
    return out


def batch(spark, rows):
    df = spark.createDataFrame(rows, OBS)
    out = qc.persistence_check(qc.step_check(df, PARAMS), PARAMS)
    return {tuple(x)[:3]: (x["value"], x["qc_flags"]) for x in out.select("station_id", "variable", "valid_time", "value", "qc_flags").collect()}


def streamed(spark, folder, files, name, late):
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, OBS).coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    q = checks.stream_step_persistence(stream, late, PARAMS).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    q.stop()
    return spark.table(name).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_flags_equal_the_batch(spark, tmp_path, seed):
    rows, r = readings(seed), random.Random(seed)
    rows.sort(key=lambda x: (x[2] - T0).total_seconds() / 3600 + r.uniform(0, 7))  # up to seven hours out of order
    cut = len(rows) // 8
    files = [rows[a : a + cut] for a in range(0, len(rows), cut)] + [[("far", "t2m", T0 + dt.timedelta(days=90 + k), 1.0, 0)] for k in range(2)]
    got = streamed(spark, tmp_path, files, f"flags{seed}", "12 hours")
    want = batch(spark, rows)
    seen = {tuple(x)[:3]: (x["value"], x["qc_flags"]) for x in got if x["station_id"] != "far"}
    assert len(seen) == len([x for x in got if x["station_id"] != "far"]) == len(rows)
    assert seen == want
    flags = [f for _, f in want.values()]
    assert sum(f & 2 > 0 for f in flags) > 20 and sum(f & 4 > 0 for f in flags) > 20


def test_state_is_bounded_and_rows_come_out_early():
    s = checks.Series("t2m", PARAMS)
    out = []
    for h in range(1000):  # one endless run
        s.ahead.append([h * checks.HOUR, 5.0, 0])
        out += s.judged((h - 2) * checks.HOUR)
        assert len(s.ahead) <= 3 and len(s.open) < 4
    assert len(out) == 998 and all(f == 4 for *_, f in out)
    s = checks.Series("t2m", PARAMS, [[0, 5.0, 0], [checks.HOUR, 5.0, 1], [2 * checks.HOUR, 9.0, 0]])
    assert list(s.judged(checks.HOUR)) == [] and s.wakes_at() == 2 * checks.HOUR
    assert list(s.judged(2 * checks.HOUR)) == [[0, 5.0, 0], [checks.HOUR, 5.0, 1]] and s.wakes_at() == 3 * checks.HOUR
    assert list(s.judged(3 * checks.HOUR)) == [[2 * checks.HOUR, 9.0, 2]] and s.wakes_at() is None
    again = checks.Series("t2m", PARAMS, *__import__("json").loads(s.stored()))
    assert again.stored() == s.stored()


def test_late_rows_are_dropped(spark, tmp_path):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    files = [[("a", "t2m", hour(h), 1.0, 0) for h in range(10)], [("a", "t2m", hour(40), 1.0, 0)], [("a", "t2m", hour(3), 9.0, 0), ("a", "t2m", hour(41), 8.0, 0)], [("a", "t2m", hour(90), 8.0, 0)], [("a", "t2m", hour(91), 8.0, 0)]]
    got = {x["valid_time"]: (x["value"], x["qc_flags"]) for x in streamed(spark, tmp_path, files, "late", "2 hours")}
    assert got == {hour(h): (1.0, 4) for h in range(10)} | {hour(40): (1.0, 0), hour(41): (8.0, 2)}
    assert spark.table("late").where(F.col("value") == 9.0).count() == 0
