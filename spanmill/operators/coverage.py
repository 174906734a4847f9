"""Continuous periods and gaps of overlapping intervals per entity (problem 2).

`IntervalMap` is the keyed state: an ordered map of disjoint intervals. The
batch operator sweeps range-partitioned rows and keeps one map for the entity
at hand; the streaming operator (streaming/coverage.py) keeps one per entity
in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .sweep import balanced_next, column, range_sweep, running_max, starts_of

FOREVER = 2**63 - 1


def coalesce(starts: np.ndarray, ends: np.ndarray, group_starts: np.ndarray | None = None):
    """Merge intervals sorted by start within groups of consecutive rows.

    Returns (first row of each period, start, end) with touching intervals
    merged.
    """
    n = len(starts)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    group_starts = np.zeros(1, dtype=np.int64) if group_starts is None else group_starts
    reach = running_max(ends, group_starts)
    new = np.zeros(n, dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    new[group_starts] = True
    at = np.flatnonzero(new)
    last = np.append(at[1:], n) - 1
    return at, starts[at], reach[last]


class IntervalMap:
    """Disjoint [start, end) intervals in order; touching ones are one period."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts=(), ends=()):
        self.starts = np.asarray(starts, dtype=np.int64)
        self.ends = np.asarray(ends, dtype=np.int64)

    def insert(self, starts, ends) -> None:
        """Insert intervals in any order; those without length are ignored."""
        starts, ends = np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64)
        keep = ends > starts
        if not keep.any():
            return
        starts, ends = starts[keep], ends[keep]
        order = np.argsort(starts, kind="stable")
        _, starts, ends = coalesce(starts[order], ends[order])
        # binary search for the stretch of the map that the new intervals can touch
        lo = int(np.searchsorted(self.ends, starts[0], side="left"))
        hi = int(np.searchsorted(self.starts, ends.max(), side="right"))
        if lo < hi:
            starts = np.concatenate([self.starts[lo:hi], starts])
            ends = np.concatenate([self.ends[lo:hi], ends])
            order = np.argsort(starts, kind="stable")
            _, starts, ends = coalesce(starts[order], ends[order])
        self.starts = np.concatenate([self.starts[:lo], starts, self.starts[hi:]])
        self.ends = np.concatenate([self.ends[:lo], ends, self.ends[hi:]])

    def gaps(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ends[:-1], self.starts[1:]

    def settle(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Forget periods that nothing starting at `start` or later can touch,
        except the last of them; returns the gaps after the forgotten ones."""
        n = max(0, int(np.searchsorted(self.starts, start, side="right")) - 1)
        a, b = self.ends[:n], self.starts[1 : n + 1]
        self.starts, self.ends = self.starts[n:], self.ends[n:]
        return a, b


_SWEPT = "_kind string, _k1 string, _k2 bigint, _pid int, a bigint, b bigint, edge boolean"


def _rows(kind: str, k1: list, k2: list, pid: int, a, b, edge: bool) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * n, pa.string()),
            pa.array(k1, pa.string()),
            pa.array(k2, pa.int64()),
            pa.array(np.full(n, pid, dtype=np.int32)),
            pa.array(a, pa.int64()),
            pa.array(b, pa.int64()),
            pa.array(np.full(n, edge)),
        ],
        names=["_kind", "_k1", "_k2", "_pid", "a", "b", "edge"],
    )


def _sweep(k1: str, k2: str):
    """Gaps of the sorted rows of one task, and what its first and last entity cover."""

    def run(batches: Iterator[pa.RecordBatch], pid: int) -> Iterator[pa.RecordBatch]:
        head = key = held = first = None

        def flush(last: bool):
            a, b = held.gaps()
            edge = key == head
            yield _rows("gap", [key[0]] * len(a), [key[1]] * len(a), pid, a, b, edge)
            if edge or last:
                yield _rows("reach", [key[0]], [key[1]], pid, [first], [int(held.ends[-1])], True)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            s, e = column(batch, "_start"), column(batch, "_end")
            names = batch.column(batch.schema.get_field_index(k1)).dictionary_encode()
            c1, c2 = names.indices.to_numpy(zero_copy_only=False), column(batch, k2)
            names = names.dictionary.to_pylist()
            groups = starts_of(c1, c2)
            keys = [(names[c1[g]], int(c2[g])) for g in groups]
            at, ps, pe = coalesce(s, e, groups)
            bounds = np.append(np.searchsorted(at, groups), len(at))
            ends = np.append(groups[1:], len(s)) - 1
            # entities that lie within this batch as a whole
            if len(keys) > 2:
                lo, hi = bounds[1], bounds[-2]
                owner = np.repeat(np.arange(len(keys)), np.diff(bounds))[lo:hi]
                pair = np.flatnonzero(owner[1:] == owner[:-1])
                who = [keys[j] for j in owner[pair]]
                whole = _rows("gap", [k[0] for k in who], [k[1] for k in who], pid, pe[lo:hi][pair], ps[lo:hi][pair + 1], False)
            for i in dict.fromkeys((0, len(keys) - 1)):
                if keys[i] != key:
                    if key is not None:
                        yield from flush(last=False)
                    if i and len(keys) > 2:
                        yield whole
                    key, held, first = keys[i], IntervalMap(), int(ps[bounds[i]])
                    head = head or key
                held.insert(ps[bounds[i] : bounds[i + 1]], pe[bounds[i] : bounds[i + 1]])
                # rows come in order of start: what ends before the newest start is final
                a, b = held.settle(int(s[ends[i]]))
                if len(a):
                    yield _rows("gap", [key[0]] * len(a), [key[1]] * len(a), pid, a, b, key == head)
        if key is not None:
            yield from flush(last=True)

    return run


def _prepared(df: DataFrame, k1: str, k2: str, start: str, end: str) -> DataFrame:
    return df.select(
        F.col(k1).cast("string").alias(k1),
        F.col(k2).cast("bigint").alias(k2),
        F.col(start).cast("bigint").alias("_start"),
        F.coalesce(F.col(end).cast("bigint"), F.lit(FOREVER)).alias("_end"),
    ).where(F.col(k1).isNotNull() & F.col(k2).isNotNull() & F.col("_start").isNotNull() & (F.col("_end") > F.col("_start")))


def gaps(df: DataFrame, k1: str = "container", k2: str = "container_id", start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """Maximal uncovered stretches (k1, k2, gap_start, gap_end) of each entity.

    Between the first covered moment of an entity and its last. Intervals are
    [start, end). A null end covers all from its start on; an interval whose
    end is not after its start covers nothing and is ignored, as are rows with
    a null key or start. Repeated rows change nothing, an empty table gives no
    rows, and further columns are ignored whatever their names.
    """
    rows = range_sweep(_prepared(df, k1, k2, start, end), [k1, k2], ["_start", "_end"], _sweep(k1, k2), _SWEPT)
    swept = Scratch(df.sparkSession, "gaps").put(rows)
    w = Window.partitionBy("_k1", "_k2").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    reach = swept.where("_kind = 'reach'").withColumn("before", F.max("b").over(w))
    between = reach.where(F.col("a") > F.col("before")).select("_k1", "_k2", F.col("before").alias("a"), F.col("a").alias("b"))
    found = swept.where("_kind = 'gap'")
    inner = found.where(~F.col("edge")).select("_k1", "_k2", "a", "b")
    # `reach` holds at most two rows for each task of the sweep: the size of
    # this broadcast is bounded by the number of tasks, not by the data.
    earlier = F.broadcast(reach.select("_k1", "_k2", "_pid", "before"))
    edge = (
        found.where("edge")
        .join(earlier, ["_k1", "_k2", "_pid"], "left")
        .select("_k1", "_k2", F.greatest("a", F.coalesce("before", "a")).alias("a"), "b")
        .where(F.col("b") > F.col("a"))
    )
    every = inner.unionByName(edge).unionByName(between)
    return every.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("a").alias("gap_start"), F.col("b").alias("gap_end"))


def periods(df: DataFrame, k1: str = "container", k2: str = "container_id", start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """Continuous periods (k1, k2, period_start, period_end) of each entity.

    What lies between the gaps; period_end is null where a period never ends.
    Nulls, empty intervals, repeats and empty tables: see `gaps`.
    """
    scratch = Scratch(df.sparkSession, "periods")
    prepared = _prepared(df, k1, k2, start, end)
    extent = prepared.groupBy(k1, k2).agg(F.min("_start").alias("lo"), F.max("_end").alias("hi"))
    sides = F.array(
        F.struct(F.lit(None).cast("bigint").alias("until"), F.col("lo").alias("since")),
        F.struct(F.col("hi").alias("until"), F.lit(None).cast("bigint").alias("since")),
    )
    marks = extent.select(k1, k2, F.inline(sides)).unionByName(
        gaps(df, k1, k2, start, end).select(k1, k2, F.col("gap_start").alias("until"), F.col("gap_end").alias("since"))
    )
    marks = marks.withColumn("at", F.coalesce("until", F.col("since") - 1))
    paired = balanced_next(marks, [k1, k2], ["at"], ["since", "until"], scratch)
    return paired.where(F.col("since").isNotNull()).select(
        k1, k2, F.col("since").alias("period_start"), F.when(F.col("next_until") < FOREVER, F.col("next_until")).alias("period_end")
    )
