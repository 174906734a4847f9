"""Irregular readings onto a regular grid (problem 6).

Each series gets a regression on trend and harmonics of a seasonal period,
from normal equations that are summed in parallel and solved per series. The
period comes from a periodogram of the detrended series that is summed in
parallel too; it counts only where it stands out from the frequencies around
it, as the slow swings of a random walk don't. Empty slots take the model's
value plus the residuals of the observed slots on both sides, bridged in a
straight line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .sweep import balanced_next, column, starts_of

#: Periods in ns that are tried in every series: minute, hour, day, week.
CALENDAR_NS = (60_000_000_000, 3_600_000_000_000, 86_400_000_000_000, 604_800_000_000_000)
#: And periods that go into a series' length this many times at most.
CYCLES = 128
#: A period counts if its power is so many times the median of those around it; less is asked of the few calendar periods.
STANDS_OUT, CALENDAR_STANDS_OUT = 25.0, 10.0
#: A peak lies between whole numbers of cycles: so much to both sides is tried.
OFFSETS = (-0.4, -0.2, 0.0, 0.2, 0.4)
HARMONICS = 2
#: Slots that one row of a long gap stands for before it is spread over tasks.
BLOCK = 4096

_P = 2 + 2 * HARMONICS
_UPPER = [(i, j) for i in range(_P) for j in range(i, _P)]
_SUMS = [f"m{k}" for k in range(len(_UPPER) + _P + 2)]


def observed_slots(metrics: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, step_ns, slot, y, n): mean of the slot's readings and how many.

    Repeated rows count once; different readings at one time are averaged with
    the slot's others. Null readings and times, series without a positive
    step_ns, and readings of unlisted series give no slot.
    """
    steps = series.where("step_ns > 0").groupBy("series_id").agg(F.min(F.col("step_ns").cast("bigint")).alias("step_ns"))
    rows = metrics.where("reading is not null and ts is not null").select("series_id", "metric_name", F.col("ts").cast("bigint").alias("ts"), "reading")
    rows = rows.join(steps, "series_id").withColumn("slot", F.expr("(ts - pmod(ts, step_ns)) div step_ns"))
    # one exchange serves both: rows of a slot lie together, repeats included
    rows = rows.repartition("series_id", "slot").groupBy("series_id", "step_ns", "slot", "metric_name", "ts", "reading").agg(F.lit(1).alias("_one"))
    return rows.groupBy("series_id", "step_ns", "slot").agg(F.avg(F.col("reading").cast("double")).alias("y"), F.count("*").alias("n"))


def _features(slot, lo, hi, step, period, lib) -> list:
    """Trend and harmonics; `lib` has sin and cos (numpy's or Spark's)."""
    turn = 2 * np.pi * ((slot - lo) * step) / period
    wave = [f(turn * h) for h in range(1, HARMONICS + 1) for f in (lib.sin, lib.cos)]
    return [(slot - lo) / (hi - lo), *wave]


_WAVES = 1 + CYCLES + 3 * len(CALENDAR_NS)
_POWER = ["a", "b", "c", "d", "e", "f"]


def _periodogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per series and batch, at cycle k: sums of 1, t and y times the wave; at k = 0: n and sums of t, t^2, y, ty, y^2."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sid = column(batch, "series_id")
        order = np.argsort(sid, kind="stable")
        sid = sid[order]
        slot, lo, hi, step = (column(batch, c)[order].astype(np.float64) for c in ("slot", "lo", "hi", "step_ns"))
        y = column(batch, "y")[order]
        at = starts_of(sid)
        t = (slot - lo) / (hi - lo + 1)
        sums = np.add.reduceat(np.stack([np.ones(len(t)), t, t * t, y, t * y, y * y]), at, axis=1)
        out = [(np.zeros(len(at), dtype=np.int32), sums)]
        # powers of one turn are the waves of all cycles
        turn, wave = np.exp(2j * np.pi * t), np.ones(len(t), dtype=complex)
        for k in range(1, _WAVES):
            if k <= CYCLES:
                wave = wave * turn
            else:
                c, side = divmod(k - CYCLES - 1, 3)
                wave = np.exp(2j * np.pi * ((slot - lo) * (step / CALENDAR_NS[c]) + (side - 1) * t))
            s1, st, sy = np.add.reduceat(np.stack([wave, t * wave, y * wave]), at, axis=1)
            out.append((np.full(len(at), k, dtype=np.int32), np.stack([s1.real, s1.imag, st.real, st.imag, sy.real, sy.imag])))
        sums = np.concatenate([v for _, v in out], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(sid[at], len(out))), pa.array(np.concatenate([k for k, _ in out])), *map(pa.array, sums)], names=["series_id", "k", *_POWER])


def _power(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Power of the detrended series at 1, 2, ... cycles, and at each calendar period.

    Rows of `sums` are waves, the first has the plain sums. Both ends of the
    series are faded out, which here joins each wave with its neighbours, so
    that the slow swings of a series don't leak into all frequencies.
    """
    n, t, tt, y, ty, yy = sums[0]
    det = n * tt - t * t
    slope = (n * ty - t * y) / det if det > 1e-12 * n * n else 0.0
    level = (y - slope * t) / n
    w1, wt, wy = (sums[1:, 2 * i] + 1j * sums[1:, 2 * i + 1] for i in range(3))
    rest = wy - level * w1 - slope * wt
    line = np.append(0, rest[:CYCLES])
    sides = rest[CYCLES:].reshape(-1, 3)
    faded = lambda a, b, c: np.abs(b / 2 - (a + c) / 4) ** 2 / n
    return faded(line[:-2], line[1:-1], line[2:]), faded(*sides.T)


def _around(power: np.ndarray, k: int) -> float:
    """Median power of the cycles around the k-th, without it and its neighbours."""
    width = max(6, k // 2)
    near = np.arange(max(0, k - 1 - width), min(len(power), k + width))
    near = near[np.abs(near - (k - 1)) > 2]
    # powers of a random walk fall with the square of the frequency
    return float(np.median(power[near] * ((near + 1) / k) ** 2)) if len(near) else np.inf


def _peaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(series_id, trial, period): 0 for the trend alone, and the periods that stand out."""
    for b in batches:
        out = []
        for sid, span, step, rows in zip(b["series_id"], b["hi"] - b["lo"] + 1, b["step_ns"], b["sums"]):
            out.append((sid, 0, 0.0))
            sums = np.zeros((_WAVES, len(_POWER)))
            for r in rows:
                sums[r["k"]] = [r[c] for c in _POWER]
            n = sums[0, 0]
            most = int(min(CYCLES - 1, n // 8, span // 4))
            if n < 4 * _P or most < 4:
                continue
            known, calendar = _power(sums)
            known, trials = known[:most], []
            ratio = np.array([known[k - 1] / max(_around(known, k), 1e-300) for k in range(1, most + 1)])
            ratio[:2] = 0.0  # two cycles are not a season yet
            k = int(np.argmax(ratio)) + 1
            if ratio[k - 1] >= STANDS_OUT:
                trials += [span * step / (k + o) for o in OFFSETS]
            for c, period in enumerate(CALENDAR_NS):
                cycles = span * step / period
                if cycles >= 3 and period >= 4 * step and calendar[c] >= CALENDAR_STANDS_OUT * max(_around(known, min(most, round(cycles))), 1e-300):
                    trials.append(float(period))
            out += [(sid, i, p) for i, p in enumerate(trials, 1)]
        yield pd.DataFrame(out, columns=["series_id", "trial", "period"])


def _normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of feature products per series, trial period and batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sid, trial = column(batch, "series_id"), column(batch, "trial")
        order = np.lexsort((trial, sid))
        sid, trial = sid[order], trial[order]
        slot, lo, hi, step, period, y = (column(batch, c)[order].astype(np.float64) for c in ("slot", "lo", "hi", "step_ns", "period", "y"))
        at = starts_of(sid, trial)
        x = np.ones((_P, len(sid)))
        x[1:] = _features(slot, lo, np.maximum(hi, lo + 1), step, np.where(period > 0, period, 1.0), np)
        x[2:, period == 0] = 0
        cols = [x[i] * x[j] for i, j in _UPPER] + [x[i] * y for i in range(_P)] + [y * y, np.ones(len(y))]
        sums = np.add.reduceat(np.stack(cols), at, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(trial[at]), *map(pa.array, sums)], names=["series_id", "trial", *_SUMS])


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        out = []
        for r in t.itertuples(index=False):
            m = np.array([getattr(r, c) for c in _SUMS], dtype=np.float64)
            a = np.zeros((_P, _P))
            for (i, j), v in zip(_UPPER, m):
                a[i, j] = a[j, i] = v
            b, yy, n = m[len(_UPPER) : len(_UPPER) + _P], m[-2], m[-1]
            coef = np.linalg.solve(a + 1e-9 * max(n, 1) * np.eye(_P), b)
            left = max(yy - 2 * coef @ b + coef @ a @ coef, 1e-9 * yy + 1e-9)
            out.append((r.series_id, n * np.log(left / n) + (_P if r.period else 2) * np.log(n), r.trial, r.period, coef.tolist()))
        yield pd.DataFrame(out, columns=["series_id", "score", "trial", "period", "coef"])


def seasonal_models(slots: DataFrame, scratch: Scratch) -> DataFrame:
    """(series_id, lo, hi, period_ns, coef) of each series with an observed slot; period_ns 0 is the trend alone."""
    extent = scratch.put(slots.groupBy("series_id").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.min("step_ns").alias("step_ns")))
    rows = slots.select("series_id", "slot", "y").join(extent, "series_id").select("series_id", "slot", "lo", "hi", "step_ns", "y")
    waves = rows.mapInArrow(_periodogram, "series_id bigint, k int, " + ", ".join(f"{c} double" for c in _POWER)).groupBy("series_id", "k").agg(*[F.sum(c).alias(c) for c in _POWER])
    # a list of _WAVES sums per series
    each = waves.groupBy("series_id").agg(F.collect_list(F.struct("k", *_POWER)).alias("sums")).join(extent, "series_id").select("series_id", "lo", "hi", "step_ns", "sums")
    trials = scratch.put(each.mapInPandas(_peaks, "series_id bigint, trial int, period double"))
    sums = rows.join(trials, "series_id").mapInArrow(_normal_equations, "series_id bigint, trial int, " + ", ".join(f"{c} double" for c in _SUMS))
    sums = sums.groupBy("series_id", "trial").agg(*[F.sum(c).alias(c) for c in _SUMS]).join(trials, ["series_id", "trial"])
    fits = sums.mapInPandas(_solve, "series_id bigint, score double, trial int, period double, coef array<double>")
    best = fits.groupBy("series_id").agg(F.min_by(F.struct("period", "coef"), F.struct("score", "trial")).alias("best"))
    return extent.join(best, "series_id").select("series_id", "lo", "hi", F.col("best.period").alias("period_ns"), F.col("best.coef").alias("coef"))


def _predicted(slot: Column) -> Column:
    lo, hi, step = F.col("lo"), F.greatest(F.col("hi"), F.col("lo") + 1), F.col("step_ns")
    feats = _features(slot, lo, hi, step, F.when(F.col("period_ns") > 0, F.col("period_ns")).otherwise(1), F)
    c = lambda i: F.element_at("coef", i + 1)
    seasonal = sum((c(2 + k) * f for k, f in enumerate(feats[1:])), F.lit(0.0))
    return c(0) + c(1) * feats[0] + F.when(F.col("period_ns") > 0, seasonal).otherwise(0.0)


def missing_slots(slots: DataFrame, scratch: Scratch) -> DataFrame:
    """(series_id, slot, value) of slots between observed ones that had no reading."""
    # rows come back in order of their series: few series in each Arrow batch
    pairs = balanced_next(slots.select("series_id", "step_ns", "slot", "y"), ["series_id", "step_ns"], ["slot"], ["slot", "y"], scratch)
    models = scratch.put(seasonal_models(pairs, scratch))
    holes = pairs.where(F.col("next_slot") > F.col("slot") + 1)
    # A long outage is one row here: cut it into blocks and spread those.
    holes = holes.withColumn("block", F.explode(F.expr(f"sequence(slot + 1, next_slot - 1, {BLOCK}L)"))).repartition("series_id", "block")
    holes = holes.join(models, "series_id")
    holes = holes.withColumn("r0", F.col("y") - _predicted(F.col("slot"))).withColumn("r1", F.col("next_y") - _predicted(F.col("next_slot")))
    holes = holes.withColumn("at", F.explode(F.expr(f"sequence(block, least(block + {BLOCK - 1}, next_slot - 1))")))
    share = (F.col("at") - F.col("slot")) / (F.col("next_slot") - F.col("slot"))
    value = _predicted(F.col("at")) + F.col("r0") + (F.col("r1") - F.col("r0")) * share
    return holes.select("series_id", "step_ns", F.col("at").alias("slot"), value.alias("value"))


def regular_grid(metrics: DataFrame, series: DataFrame) -> DataFrame:
    """One row per series and slot from its first observed slot to its last.

    (series_id, slot, slot_start_ns, value, n_readings, filled). Observed slots
    have the mean of their readings, others the bridged seasonal value with
    n_readings 0. See `observed_slots` for nulls, repeats and ties. Empty
    tables give no rows; other columns are ignored.
    """
    scratch = Scratch(metrics.sparkSession, "grid")
    slots = scratch.put(observed_slots(metrics, series))
    seen = slots.select("series_id", "step_ns", "slot", F.col("y").alias("value"), F.col("n").alias("n_readings"), F.lit(False).alias("filled"))
    gone = missing_slots(slots, scratch).select("series_id", "step_ns", "slot", "value", F.lit(0).cast("bigint").alias("n_readings"), F.lit(True).alias("filled"))
    return seen.unionByName(gone).select("series_id", "slot", (F.col("slot") * F.col("step_ns")).alias("slot_start_ns"), "value", "n_readings", "filled")
