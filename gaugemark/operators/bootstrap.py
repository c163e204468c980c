"""Day-block bootstrap: intervals for every published estimate.

All rows of a day move together, so a draw is a vector of day multiplicities and a statistic of a draw
is a function of day sums. Spark sums the rows by (group, day) with partial aggregation; what
remains of a group is one row for each day, and one function call turns it into estimate, interval
and draws by a matrix product. Rows are never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.student import clamped_block_length
from ..workers import ship
from .metrics import BIN_EDGES, percentile_bin, seeps_in_mask, seeps_penalty


@dataclass(frozen=True)
class Statistic:
    """``sums``: name -> expression of a row, summed by day; ``final`` maps arrays of sums to the statistic.

    ``pairs`` names the sum that counts the rows which take part, where not all do; a group without any raises.
    """

    sums: dict[str, Column]
    final: Callable[[dict[str, np.ndarray]], np.ndarray]
    pairs: str | None = None


def _ratio(top: str, bottom: str = "n"):
    def final(s):
        with np.errstate(divide="ignore", invalid="ignore"):
            return s[top] / s[bottom]

    return final


def statistics() -> dict[str, Statistic]:
    e, one = F.col("fcst") - F.col("obs"), F.lit(1.0)
    inside = F.coalesce(seeps_in_mask(), F.lit(False))
    return {
        "bias": Statistic({"e": e, "n": one}, _ratio("e")),
        "mae": Statistic({"a": F.abs(e), "n": one}, _ratio("a")),
        "rmse": Statistic({"q": e * e, "n": one}, lambda s: np.sqrt(_ratio("q")(s))),
        "weighted_mae": Statistic({"a": F.abs(e) * F.col("weight"), "w": F.col("weight")}, _ratio("a", "w")),
        "mse_total": Statistic({"q": e * e, "n": one}, _ratio("q")),
        "repr_floor_mean": Statistic({"f": F.col("repr_floor"), "n": one}, _ratio("f")),
        "seeps": Statistic({"p": F.when(inside, seeps_penalty()), "m": inside.cast("double")}, _ratio("p", "m"), "m"),
    }


@lru_cache(maxsize=16)  # stations of a group share their draws
def multiplicities(n: int, length: int, n_boot: int, seed: int, starts: str = "random") -> np.ndarray:
    """(draws, days): how often each day stands in each resample of moving blocks, cut to n days.

    ``starts``: ``random``, or ``arithmetic`` for a rule that other engines can repeat:
    (draw * 7919 + block * 104729) mod (n - length + 1).
    """
    blocks = -(-n // length)
    if starts == "arithmetic":
        first = (np.arange(n_boot)[:, None] * 7919 + np.arange(blocks)[None] * 104729) % (n - length + 1)
    else:
        first = np.random.default_rng(seed).integers(0, n - length + 1, size=(n_boot, blocks))
    days = (first[:, :, None] + np.arange(length)).reshape(n_boot, -1)[:, :n]
    out = np.bincount((np.arange(n_boot)[:, None] * n + days).ravel(), minlength=n_boot * n).reshape(n_boot, n).astype(float)
    out.flags.writeable = False
    return out


def _check(df: DataFrame, day: str, n_boot: int, block_len: int | None, alpha: float) -> None:
    if day not in df.columns:
        raise ValueError(f"no column {day}")
    if n_boot < 1 or not 0 < alpha < 1 or (block_len is not None and block_len < 1):
        raise ValueError("needs n_boot >= 1, 0 < alpha < 1 and block_len >= 1")
    if df.isEmpty():
        raise ValueError("no rows to draw from")
    ship(df.sparkSession)


def _interval(draws: np.ndarray, alpha: float) -> tuple[float, float]:
    if np.isnan(draws).any():
        return float("nan"), float("nan")
    low, high = np.quantile(draws, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


_D, _I = T.DoubleType(), T.IntegerType()
_RESULT = [("estimate", _D), ("ci_low", _D), ("ci_high", _D), ("alpha", _D), ("n_pairs", T.LongType()), ("n_days", _I), ("block_len_days", _I), ("n_boot", _I)]


def block_bootstrap(df: DataFrame, by: Sequence[str], metrics: Sequence[str], day: str = "day", n_boot: int = 1000, block_len: int | None = None, alpha: float = 0.05, seed: int = 0, starts: str = "random", custom: dict[str, Statistic] | None = None) -> DataFrame:
    """One row for each group and metric with its interval; all metrics of a group share its draws.

    ``block_len`` None takes the automatic length of the group's daily mean error, clamped to 2..30;
    longer than the days it is cut to them. One day blocks make the independent bootstrap.
    """
    _check(df, day, n_boot, block_len, alpha)
    known = statistics() | (custom or {})
    chosen = {m: known[m] for m in metrics}
    sums = {f"{m}__{k}": F.sum(c) for m, s in chosen.items() for k, c in s.sums.items()}
    daily = df.groupBy(*by, F.col(day).alias("day_")).agg(F.count(F.lit(1)).alias("rows_"), F.avg(F.col("fcst") - F.col("obs")).alias("error_"), *(c.alias(k) for k, c in sums.items()))
    schema = T.StructType([*(daily.schema[b] for b in by), T.StructField("metric", T.StringType())])
    for name, kind in _RESULT:
        schema = schema.add(name, kind)

    finals = {m: (s.final, s.pairs) for m, s in chosen.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_")
        n = len(pdf)
        length = min(n, block_len or clamped_block_length(pdf["error_"].to_numpy(float)))
        times = multiplicities(n, length, n_boot, seed, starts)
        rows = []
        for m, (final, pairs) in finals.items():
            days = {c[len(m) + 2 :]: np.nan_to_num(pdf[c].to_numpy(float)) for c in pdf.columns if c.startswith(f"{m}__")}
            used = int(days[pairs].sum() if pairs else pdf["rows_"].sum())
            if not used:
                raise ValueError(f"{m}: every row of the group is masked")
            estimate = float(final({k: np.array([x.sum()]) for k, x in days.items()})[0])
            low, high = _interval(final({k: times @ x for k, x in days.items()}), alpha)
            rows.append([*(pdf[b].iloc[0] for b in by), m, estimate, low, high, alpha, used, n, length, n_boot])
        return pd.DataFrame(rows, columns=schema.names)

    return daily.groupBy(*by).applyInPandas(run, schema)


def decomposition_bootstrap(df: DataFrame, by: Sequence[str], day: str = "day", n_boot: int = 1000, block_len: int | None = None, alpha: float = 0.05, seed: int = 0, starts: str = "random") -> DataFrame:
    """mse_total, repr_floor_mean and mse_model_est on the same draws, with the share of draws clipped at zero."""
    _check(df, day, n_boot, block_len, alpha)
    e = F.col("fcst") - F.col("obs")
    daily = df.where("repr_floor is not null").groupBy(*by, F.col(day).alias("day_")).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("error_"), F.sum(e * e).alias("q"), F.sum("repr_floor").alias("f"))
    schema = T.StructType([*(daily.schema[b] for b in by), T.StructField("metric", T.StringType())])
    for name, kind in [*_RESULT, ("clipped_frac", _D)]:
        schema = schema.add(name, kind)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_")
        days = len(pdf)
        length = min(days, block_len or clamped_block_length(pdf["error_"].to_numpy(float)))
        times = multiplicities(days, length, n_boot, seed, starts)
        n, q, f = (pdf[c].to_numpy(float) for c in "nqf")
        total, floor = q.sum() / n.sum(), f.sum() / n.sum()
        draws = times @ n
        totals, floors = times @ q / draws, times @ f / draws
        rows = []
        for m, estimate, values, clipped in (("mse_total", total, totals, None), ("repr_floor_mean", floor, floors, None), ("mse_model_est", max(total - floor, 0.0), np.maximum(totals - floors, 0), float((totals < floors).mean()))):
            rows.append([*(pdf[b].iloc[0] for b in by), m, estimate, *_interval(values, alpha), alpha, int(n.sum()), days, length, n_boot, clipped])
        return pd.DataFrame(rows, columns=schema.names)

    return daily.groupBy(*by).applyInPandas(run, schema)


#: Draws and stations whose ratios travel in one row; a task that takes medians holds so many draws of every station.
DRAWS_A_ROW, STATIONS_A_ROW = 16, 256


@lru_cache(maxsize=2)  # stations of a group follow each other
def _times_by_day(n: int, length: int, n_boot: int, seed: int, starts: str) -> np.ndarray:
    """(days, 1 + draws): ``multiplicities`` by day, each day's in one stretch of memory, after a column of the days as they are."""
    out = np.ones((n, n_boot + 1))
    out[:, 1:] = multiplicities.__wrapped__(n, length, n_boot, seed, starts).T
    return out


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each run of rows with the same keys begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in keys:
        codes = table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _day_moments(table: pa.Table, first: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """((mean, population variance) of fcst and of obs, smallest obs, largest obs) of each day; nulls do not count."""
    moments, rows = [], np.diff(first, append=table.num_rows)
    for c in ("fcst", "obs"):
        x, valid = table[c].to_numpy(), table[c].is_valid().to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            n = np.add.reduceat(valid.astype(float), first)
            mean = np.add.reduceat(np.where(valid, x, 0.0), first) / n
            off = np.where(valid, x - np.repeat(mean, rows), 0.0)
            moments.append((mean, np.add.reduceat(off * off, first) / n))
    return moments, np.fmin.reduceat(x, first), np.fmax.reduceat(x, first)


def _station_ratios(times: np.ndarray, at: np.ndarray, n: np.ndarray, moments: Sequence[tuple[np.ndarray, np.ndarray]], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """std(fcst) / std(obs) of one station by column of ``times``, NaN where its observations are constant; inputs by day."""
    times, columns = times[at], [n]
    for mean, spread in moments:
        off = mean - (n @ mean) / n.sum()
        columns += [n * off, n * (spread + off * off)]
    n, f, ff, o, oo = np.vstack(columns) @ times
    with np.errstate(divide="ignore", invalid="ignore"):
        var_f, var_o = (np.maximum((q - s * s / n) / (n - 1), 0) for s, q in ((f, ff), (o, oo)))
        ratio = np.sqrt(var_f / var_o)
    good = (n > 1) & np.isfinite(ratio)
    # A spread near rounding may be none: only then the extremes of the drawn days are asked.
    doubt = np.flatnonzero(good & (var_o <= 1e-9 * max(1.0, float(np.square([lo, hi]).max()))))
    if len(doubt):
        present = times[:, doubt] > 0
        good[doubt] = np.where(present, lo[:, None], np.inf).min(axis=0) < np.where(present, hi[:, None], -np.inf).max(axis=0)
    return np.where(good, ratio, np.nan)


def variance_ratio_bootstrap(df: DataFrame, by: Sequence[str], station: str = "station_id", day: str = "day", n_boot: int = 1000, block_len: int | None = None, alpha: float = 0.05, seed: int = 0, starts: str = "random") -> DataFrame:
    """Variance ratio with its interval. A station's days are one matrix product; medians go over stations by draw.

    A station is left out of a draw in which its observations are constant, told by their extremes. Days are
    numbered once for each group (the calendar bounds them, so their numbers are broadcast); rows are shuffled and
    sorted once, by station, and summed by day in blocks of stations. A station's sums are centred after they are collected.
    """
    _check(df, day, n_boot, block_len, alpha)
    e = F.col("fcst") - F.col("obs")
    daily = df.groupBy(*by, F.col(day).alias("day_")).agg(F.avg(e).alias("error_"), F.count(F.lit(1)).alias("rows_"))
    numbered = T.StructType([*(daily.schema[b] for b in by), daily.schema["day_"], *(T.StructField(c, T.IntegerType()) for c in ("at_", "n_days", "block_len_days")), T.StructField("n_pairs", T.LongType())])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_")
        n = len(pdf)
        length = min(n, block_len or clamped_block_length(pdf["error_"].to_numpy(float)))
        return pdf.assign(at_=np.arange(n, dtype=np.int32), n_days=n, block_len_days=length, n_pairs=int(pdf["rows_"].sum()))[numbered.names]

    index = F.broadcast(daily.groupBy(*by).applyInPandas(number, numbered))  # one row for each day of a group
    same = ["n_pairs", "n_days", "block_len_days"]
    rows = df.select(*by, station, F.col(day).alias("day_"), F.col("fcst").cast("double").alias("fcst"), F.col("obs").cast("double").alias("obs"))
    dealt = rows.repartition(*by, station).join(index, [*by, "day_"]).select(*by, *same, station, "at_", "fcst", "obs").sortWithinPartitions(*by, station, "at_")
    groups, counted = [dealt.schema[b] for b in by], [dealt.schema[c] for c in same]
    schema = T.StructType([*groups, *counted, T.StructField("part", T.IntegerType()), T.StructField("ratios", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last station, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = int(_starts(table, [*by, station])[-1])
            yield from ratios_of(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from ratios_of(rest)

    def ratios_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Ratios by draw of whole stations, their rows sorted by group, station and day."""
        if not table.num_rows:
            return
        table = table.combine_chunks()
        first = _starts(table, [*by, station, "at_"])  # of each day
        at, each = table["at_"].to_numpy()[first], np.diff(first, append=table.num_rows).astype(float)
        moments, lo, hi = _day_moments(table, first)
        ends = np.append(np.searchsorted(first, _starts(table, [*by, station])), len(first))  # stations, in days
        group = np.append(np.searchsorted(first[ends[:-1]], _starts(table, by)), len(ends) - 1)  # groups, in stations
        for begin, end in zip(group[:-1], group[1:], strict=True):
            head = table.slice(int(first[ends[begin]]), 1)
            times = _times_by_day(head["n_days"][0].as_py(), head["block_len_days"][0].as_py(), n_boot, seed, starts)
            for k in range(begin, end, STATIONS_A_ROW):
                days = [slice(ends[i], ends[i + 1]) for i in range(k, min(k + STATIONS_A_ROW, end))]
                ratios = np.array([_station_ratios(times, at[d], each[d], [(m[d], v[d]) for m, v in moments], lo[d], hi[d]) for d in days])
                parts = [ratios[:, a : a + DRAWS_A_ROW].ravel() for a in range(0, n_boot + 1, DRAWS_A_ROW)]
                same_head = head.select([*by, *same]).take(pa.array(np.zeros(len(parts), np.int32))).combine_chunks()
                out = [c.chunk(0) for c in same_head.columns]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.list_(pa.float64()))], names=schema.names)

    median = T.StructType([*groups, T.StructField("draw", T.IntegerType()), T.StructField("r", T.DoubleType()), *counted])

    def medians(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["part"].iloc[0]) * DRAWS_A_ROW
        every = np.concatenate(pdf["ratios"].to_numpy()).reshape(-1, min(DRAWS_A_ROW, n_boot + 1 - first))
        some = np.flatnonzero(~np.isnan(every).all(axis=0))
        out = pd.DataFrame({b: [pdf[b].iloc[0]] * len(some) for b in by} | {"draw": (first + some - 1).astype(np.int32), "r": np.array([np.nanmedian(every[:, k]) for k in some])})
        return out.assign(**{c: pdf[c].iloc[0] for c in same})[median.names]

    draws = dealt.mapInArrow(run, schema).groupBy(*by, "part").applyInPandas(medians, median)
    inner = F.when(F.col("draw") >= 0, F.col("r"))
    out = draws.groupBy(*by).agg(F.max(F.when(F.col("draw") < 0, F.col("r"))).alias("estimate"), F.percentile(inner, F.lit(alpha / 2)).alias("ci_low"), F.percentile(inner, F.lit(1 - alpha / 2)).alias("ci_high"), *(F.max(c).alias(c) for c in same))
    return out.withColumns({"n_boot": F.lit(n_boot), "alpha": F.lit(float(alpha))})


def bias_by_bin_bootstrap(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """Bias with its interval in every bin of the observed percentile (column ``obs_pct``); empty bins have no pairs and nulls."""
    if "obs_pct" not in df.columns:
        raise ValueError("bias_by_bin_bootstrap needs column obs_pct")
    binned = df.withColumn("bin", percentile_bin(F.col("obs_pct"))).where("bin is not null")
    got = block_bootstrap(binned, [*by, "bin"], ["bias"], **options).drop("metric")
    bins = F.explode(F.array(*(F.lit(f"{a}-{b}") for a, b in zip(BIN_EDGES, BIN_EDGES[1:], strict=False)))).alias("bin")
    every = df.select(*by).distinct().select(*by, bins) if by else df.sparkSession.range(1).select(bins)
    return every.join(got, [*by, "bin"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long")))
