"""Balanced ordered processing per key.

Rows are range partitioned on the composite of key and order, with the split
points taken from sampled quantiles, so that a key holding a third of all rows
is spread over a third of the tasks. Each task then sweeps its sorted rows
once, in Arrow batches. Only the first and the last key of a task can continue
in another task: their partial states, at most two a task, are stitched
afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

PID = "_pid"

#: Nodes of a plan that are not worth running twice.
_COSTLY = re.compile(r"^\W*(?:Aggregate|Join LeftAnti|Join FullOuter|Window|MapInArrow|PythonMapInArrow|Repartition|Sort|Distinct)\b", re.M)


def range_sweep(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    sweep: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Run `sweep(batches, task number)` over rows sorted by keys and order.

    Task numbers increase with (keys, order). Rows with equal keys and order
    always share a task. Split points come from a pass of their own over the
    rows: what needs an exchange, or Python, is written first, so that it runs
    once; scans and what is cheap on top of them are read twice.
    """
    if _COSTLY.search(df._jdf.queryExecution().optimizedPlan().toString()):
        df = Scratch(df.sparkSession, "sweep-input").put(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from sweep(batches, TaskContext.get().partitionId())

    by = [*keys, *order]
    return df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str, null: int | float = 0) -> np.ndarray:
    """A numeric column as an array, nulls replaced by `null`."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(null)
    return col.to_numpy(zero_copy_only=False)


def starts_of(*cols: np.ndarray) -> np.ndarray:
    """Positions where any of the columns differs from the row before."""
    n = len(cols[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def running_max(values: np.ndarray, group_starts: np.ndarray) -> np.ndarray:
    """Running maximum within each group of consecutive rows."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    group = np.zeros(n, dtype=np.int64)
    group[group_starts] = 1
    group = (np.cumsum(group) - 1) * n
    return values[order][np.maximum.accumulate(rank + group) - group]


def balanced_next(df: DataFrame, keys: list[str], order: list[str], values: list[str], scratch, extra: list[str] = ()) -> DataFrame:
    """Each row with the values of the next row of its key, as next_<value>.

    What lead() over a window gives, without one task per key. Rows are
    compared by all of `order`; the last row of a key has nulls. `extra` names
    further columns to keep.
    """
    keep = list(dict.fromkeys([*keys, *order, *values, *extra]))
    rows = df.select(*keep)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"next_{c} {fields[c]}" for c in values] + [f"{PID} int", "_end int"])

    def sweep(batches: Iterator[pa.RecordBatch], pid: int) -> Iterator[pa.RecordBatch]:
        carry = None

        def out(t: pa.Table, nxt: list[pa.Array], end: int):
            t = t.select(keep)
            for c, v in zip(values, nxt):
                t = t.append_column(f"next_{c}", v)
            t = t.append_column(PID, pa.array(np.full(len(t), pid, dtype=np.int32)))
            t = t.append_column("_end", pa.array(np.full(len(t), end, dtype=np.int32)))
            yield from t.combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            none = [pa.nulls(1, t.schema.field(c).type) for c in values]
            if carry is None:
                yield from out(t.slice(0, 1), none, 0)
            else:
                t = pa.concat_tables([carry, t])
            t = t.combine_chunks()
            n = len(t) - 1
            if n:
                same = None
                for k in keys:
                    eq = pc.equal(t[k].slice(0, n), t[k].slice(1, n))
                    same = eq if same is None else pc.and_(same, eq)
                same = pc.fill_null(same, False)
                nxt = [pc.if_else(same, t[c].slice(1, n), pa.nulls(n, t.schema.field(c).type)) for c in values]
                yield from out(t.slice(0, n), nxt, 1)
            carry = t.slice(n, 1)
        if carry is not None:
            yield from out(carry, [pa.nulls(1, carry.schema.field(c).type) for c in values], 2)

    swept = scratch.put(range_sweep(rows, keys, order, sweep, schema))
    inner = swept.where("_end = 1").drop(PID, "_end")
    # Two rows a task: its first, and its last, which lacks its successor.
    w = Window.partitionBy(*keys).orderBy(PID, "_end")
    last = swept.where("_end <> 1").select("*", *[F.lead(c).over(w).alias(f"_l_{c}") for c in values])
    last = last.where("_end = 2").select(*keep, *[F.col(f"_l_{c}").alias(f"next_{c}") for c in values])
    return inner.unionByName(last)


def balanced_prev(df: DataFrame, keys: list[str], order: list[str], values: list[str], scratch) -> DataFrame:
    """Each row with the values of the row before it of its key, as prev_<value>.

    lag() without one task per key: rows are numbered backwards, so that the
    row before is the next one.
    """
    back = [f"_r{i}" for i in range(len(order))]
    turned = df.withColumns({b: F.bitwise_not(F.col(o).cast("bigint")) for b, o in zip(back, order)})
    out = balanced_next(turned, keys, back, values, scratch, extra=[c for c in df.columns if c not in keys])
    return out.select(*df.columns, *[F.col(f"next_{v}").alias(f"prev_{v}") for v in values])


def balanced_prefix(df: DataFrame, keys: list[str], order: list[str], value: str, scratch) -> DataFrame:
    """Each row with `run`, the sum of `value` up to and with it within its key,
    and `low`, the smallest such sum so far (0 at most).

    sum() over a window without one task per key; with no keys it is a global
    running sum. Null values count as 0. The carry between tasks is at most two
    rows a task.
    """
    rows = df if keys else df.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", run bigint, low bigint, {PID} int, _head boolean, _last boolean"

    def sweep(batches: Iterator[pa.RecordBatch], pid: int) -> Iterator[pa.RecordBatch]:
        held, first, total, low = None, None, 0, 0
        back: pa.RecordBatch | None = None

        def mark(b: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            flags = np.zeros(b.num_rows, dtype=bool)
            flags[-1] = last
            return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(flags)], names=b.schema.names)

        for b in batches:
            if b.num_rows == 0:
                continue
            codes = [b.column(names.index(k)).dictionary_encode() for k in by]
            idx = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in codes]
            at = starts_of(*idx)
            key_at = lambda i: tuple(b.column(names.index(k))[int(i)].as_py() for k in by)
            v = column(b, value).astype(np.int64)
            n = len(v)
            run = np.cumsum(v)
            base = np.repeat(np.append(0, run)[at], np.diff(np.append(at, n)))
            run = run - base
            if held is not None and key_at(0) == held:
                stop = at[1] if len(at) > 1 else n
                run[:stop] += total
            else:
                low = 0
            if first is None:
                first = key_at(0)
            lows = -running_max(-run, at)
            lows = np.minimum(lows, 0)
            stop = at[1] if len(at) > 1 else n
            lows[:stop] = np.minimum(lows[:stop], low)
            held, total, low = key_at(n - 1), int(run[-1]), int(lows[-1])
            head = np.zeros(n, dtype=bool)
            if key_at(0) == first:
                head[:stop] = True
            # the key of the task's first rows ends within this batch
            last = np.zeros(n, dtype=bool)
            if back is not None:
                yield mark(back, bool(back.column(back.num_columns - 2)[-1].as_py()) and key_at(0) != first)
            if head.any() and stop < n:
                last[stop - 1] = True
            cols = [*b.columns, pa.array(run), pa.array(lows), pa.array(np.full(n, pid, dtype=np.int32)), pa.array(head), pa.array(last)]
            now = pa.RecordBatch.from_arrays(cols, names=[*names, "run", "low", PID, "_head", "_last"])
            if last.any() and n > 1:
                cut = int(np.flatnonzero(last)[0]) + 1
                yield now.slice(0, cut)
                now = now.slice(cut)
            back = now if now.num_rows else None
        if back is not None:
            yield mark(back, True)

    swept = scratch.put(range_sweep(rows, by, order, sweep, schema))
    # What each task's pieces add to their keys; two rows a task at most.
    ends = swept.where("_last").select(*by, PID, F.col("run").alias("_sum"), F.col("low").alias("_low"))
    w = Window.partitionBy(*by).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.sum("_sum").over(w))
    ends = ends.withColumn("_floor", F.min(F.coalesce("_carry", F.lit(0)) + F.col("_low")).over(w)).drop("_sum", "_low")
    rest = swept.where("not _head").drop(PID, "_head", "_last")
    heads = swept.where("_head")
    cond = [heads[k].eqNullSafe(ends[k]) for k in by] + [heads[PID] == ends[PID]]
    heads = heads.join(F.broadcast(ends), cond, "left").select(
        *[heads[c] for c in names],
        (heads["run"] + F.coalesce("_carry", F.lit(0))).alias("run"),
        F.least(F.lit(0), F.coalesce("_floor", F.lit(0)), heads["low"] + F.coalesce("_carry", F.lit(0))).alias("low"),
    )
    out = rest.unionByName(heads)
    return out if keys else out.drop("_all")


def _alike(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Where two columns agree, two nulls too."""
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return same.to_numpy(zero_copy_only=False) if isinstance(same, pa.Array) else same.combine_chunks().to_numpy(zero_copy_only=False)


def balanced_islands(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, same: list[str], fresh: Callable, scratch) -> DataFrame:
    """Consecutive rows of a key put together: (keys, same, start, end, n), the earliest start and latest end.

    A row begins an island where it differs from the row before in one of
    `same`, or where fresh(start before, end before, start, end) is true;
    `fresh` works on arrays and on Columns. One sweep, which gives out islands
    instead of rows; only the first and last island of a task, two rows, are
    joined with those of its neighbours afterwards.
    """
    cols = list(dict.fromkeys([*keys, *order, start, end, *same]))
    rows = df.select(*cols)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = list(dict.fromkeys([*keys, *same]))
    numbers = ["_s", "_e", "_s0", "_e0", "_s1", "_e1", "_n"]
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{c} bigint" for c in numbers] + [f"{PID} int", "_edge int"])

    def sweep(batches: Iterator[pa.RecordBatch], pid: int) -> Iterator[pa.RecordBatch]:
        held = carry = None
        count = 0

        def out(names: pa.Table, v: dict, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
            for c in numbers:
                names = names.append_column(c, pa.array(v[c], pa.int64()))
            names = names.append_column(PID, pa.array(np.full(len(names), pid, dtype=np.int32))).append_column("_edge", pa.array(edge.astype(np.int32)))
            yield from names.combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            s, e = (column(batch, c).astype(np.int64) for c in (start, end))
            new = np.ones(len(t), dtype=bool)
            both = pa.concat_tables([carry, t]) if carry is not None else t
            n = len(both) - 1
            if n:
                ps, pe = (both[c].to_numpy().astype(np.int64)[:n] for c in (start, end))
                at = len(t) - n
                joined = np.ones(n, dtype=bool)
                for c in kept:
                    joined &= _alike(both[c].slice(0, n), both[c].slice(1, n))
                new[at:] = ~joined | fresh(ps, pe, s[at:], e[at:])
            carry = t.slice(len(t) - 1, 1)
            cut = np.flatnonzero(new)
            goes_on = not new[0]
            if goes_on:
                cut = np.append(0, cut)
            last = np.append(cut[1:], len(t)) - 1
            v = {"_s": np.minimum.reduceat(s, cut), "_e": np.maximum.reduceat(e, cut), "_s0": s[cut], "_e0": e[cut], "_s1": s[last], "_e1": e[last], "_n": last - cut + 1}
            names = t.select(kept).take(pa.array(cut))
            if held is not None:
                if goes_on:
                    h = held[1]
                    v["_s"][0], v["_e"][0], v["_n"][0] = min(v["_s"][0], h["_s"]), max(v["_e"][0], h["_e"]), v["_n"][0] + h["_n"]
                    v["_s0"][0], v["_e0"][0] = h["_s0"], h["_e0"]
                else:
                    names = pa.concat_tables([held[0], names])
                    v = {c: np.append(held[1][c], x) for c, x in v.items()}
            done = len(names) - 1
            if done:
                edge = np.zeros(done, dtype=np.int32)
                edge[0] = count == 0
                count += done
                yield from out(names.slice(0, done), {c: x[:done] for c, x in v.items()}, edge)
            held = names.slice(done, 1), {c: int(x[-1]) for c, x in v.items()}
        if held is not None:
            yield from out(held[0], {c: np.array([x]) for c, x in held[1].items()}, np.array([2]))

    found = scratch.put(range_sweep(rows, keys, order, sweep, schema))
    # Two rows a task at most.
    w = Window.partitionBy(*keys).orderBy(PID, "_edge")
    lag = lambda c: F.lag(c).over(w)
    joins = lag("_s1").isNotNull() & ~fresh(lag("_s1"), lag("_e1"), F.col("_s0"), F.col("_e0"))
    for c in same:
        joins &= F.col(c).eqNullSafe(lag(c))
    edge = found.where("_edge > 0").withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    edge = edge.groupBy(*keys, "_run").agg(*[F.first(c).alias(c) for c in same if c not in keys], F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
    every = found.where("_edge = 0").select(*kept, "_s", "_e", "_n").unionByName(edge.select(*kept, "_s", "_e", "_n"))
    return every.select(*kept, F.col("_s").alias(start), F.col("_e").alias(end), F.col("_n").alias("n"))
