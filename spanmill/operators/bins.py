"""Fixed buckets over time and value: utilization, pixels, histograms, down-sampling."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .sweep import balanced_islands, balanced_next, balanced_prefix, balanced_prev

#: Bins that one row of a long span stands for before it is spread over tasks.
BLOCK = 1024


def explode_bins(df: DataFrame, width: int, spread: list[str]) -> DataFrame:
    """One row per span and bucket that it touches, with `bucket` and `part_ns`.

    A span of very many buckets is cut into blocks of buckets first, which are
    spread over tasks, so no row grows into one task's burden.
    """
    rows = df.where("end_ns > start_ns")
    first, last = f"start_ns div {width}", f"(end_ns - 1) div {width}"
    blocks = rows.withColumn("_b", F.explode(F.expr(f"sequence({first} div {BLOCK}, {last} div {BLOCK})")))
    bins = blocks.withColumn("bucket", F.explode(F.expr(f"sequence(greatest(_b * {BLOCK}, {first}), least(_b * {BLOCK} + {BLOCK - 1}, {last}))"))).drop("_b")
    return bins.withColumn("part_ns", F.expr(f"least(end_ns, (bucket + 1) * {width}) - greatest(start_ns, bucket * {width})"))


def processor_busy(spans: DataFrame, key: str, width: int) -> DataFrame:
    """(key, bucket, busy_ns, pct): covered time per bucket; only buckets with any.

    All spans of a processor count. Utilization is rounded half away from zero.
    """
    parts = explode_bins(spans.select(key, "start_ns", "end_ns"), width, [key])
    return parts.groupBy(key, "bucket").agg(F.sum("part_ns").alias("busy_ns")).withColumn("pct", F.round(F.col("busy_ns") * 100 / F.lit(width)).cast("bigint"))


def state_mix(spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, bucket, state, fraction): share of each bucket that each state covers."""
    parts = explode_bins(spans.select(*keys, "state", "start_ns", "end_ns"), width, keys)
    return parts.groupBy(*keys, "bucket", "state").agg((F.sum("part_ns") / F.lit(width)).alias("fraction"))


def histogram(values: DataFrame, value: str, bins: int = 100, start: int = 0, end: int | None = None, cutoff: DataFrame | None = None) -> DataFrame:
    """(bin, lo, hi, n) of the bins that hold values; the last bin is closed.

    Values outside [start, end] are dropped; without `end` it is the largest
    value. With `cutoff`, a one-row table of that column, values at or above it
    go to an overflow bin `bins`, which ends after the largest value.
    """
    v = F.col(value)
    rows = values.where(v.isNotNull() & (v >= start) & (v <= end if end is not None else F.lit(True))).select(v.alias("v"))
    if cutoff is None:
        rows = rows.withColumn("_over", F.lit(False))
    else:
        rows = rows.withColumn("_over", F.coalesce(F.col("v") >= cutoff.scalar(), F.lit(False)))
    inner = F.when(~F.col("_over"), F.col("v"))
    limit = F.lit(float(end)) if end is not None else F.coalesce(F.max(inner), F.max("v")).cast("double")
    facts = rows.agg(limit.alias("_top"), F.max("v").alias("_max"))
    placed = rows.select("*", facts.select("_top").scalar().alias("_top"), facts.select("_max").scalar().alias("_max"))
    w = F.when(F.col("_top") == start, F.lit(1.0)).otherwise((F.col("_top") - start) / bins)
    at = F.when(F.col("_over"), F.lit(bins)).otherwise(F.least(F.floor((F.col("v") - start) / w), F.lit(bins - 1))).cast("bigint")
    counted = placed.groupBy(at.alias("bin"), w.alias("_w"), "_max").agg(F.count("*").alias("n"))
    lo = start + F.col("bin") * F.col("_w")
    hi = F.when(F.col("bin") == bins, F.col("_max") + 1.0).otherwise(start + (F.col("bin") + 1) * F.col("_w"))
    return counted.select("bin", lo.alias("lo"), hi.cast("double").alias("hi"), "n")


#: Share of the rows to each side of an approximate quartile in which the exact one is looked for first.
BRACKET = 0.002


def exact_ranks(rows: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """Values at some ranks (from 1) among n values `v` that are read more than once.

    Each rank is bracketed by approximate percentiles of one pass; a second
    counts what lies below and puts the bracket's values in order, each value
    once with its count. A bracket that turns out not to hold its rank is
    widened, so the result is exact; what is sorted is a small share.
    """
    found, margin = {}, BRACKET
    while len(found) < len(ranks):
        left = [r for r in ranks if r not in found]
        ps = [p for r in left for p in (max(0.0, r / n - margin), min(1.0, r / n + margin))]
        edges = rows.agg(F.percentile_approx("v", ps, 10_000)).first()[0]
        pairs = list(zip(left, edges[::2], edges[1::2]))
        below = rows.agg(*[F.count(F.when(F.col("v") < lo, 1)) for _, lo, _ in pairs]).first()
        inside = rows.where(reduce(lambda a, b: a | b, [F.col("v").between(lo, hi) for _, lo, hi in pairs]))
        counted = inside.groupBy("v").agg(F.count("*").cast("bigint").alias("_n"))
        scratch = Scratch(rows.sparkSession, "ranks")
        run = scratch.put(balanced_prefix(scratch.put(counted), [], ["v"], "_n", scratch))
        # the running sum counts lower brackets too
        starts = run.agg(*[F.coalesce(F.max(F.when(F.col("v") < lo, F.col("run"))), F.lit(0)) for _, lo, _ in pairs]).first()
        reached = [F.col("v").between(lo, hi) & (F.col("run") >= start + r - less) for (r, lo, hi), start, less in zip(pairs, starts, below)]
        got = run.agg(*[F.min(F.when(x, F.col("v"))) for x in reached]).first()
        found |= {r: float(v) for r, v, less in zip(left, got, below) if v is not None and less < r}
        margin = min(1.0, margin * 8)
    return found


def outlier_cutoff(values: DataFrame, value: str, row_id: str = "") -> DataFrame:
    """One row: Q3 + 2.5 IQR by quartiles of halves that leave out an odd median; null where all values reach it.

    Only the four ranks that are needed are looked up (see `exact_ranks`).
    """
    spark = values.sparkSession
    rows = Scratch(spark, "outliers").put(values.where(F.col(value).isNotNull()).select(F.col(value).alias("v")))
    n, least = rows.agg(F.count("*"), F.min("v")).first()
    cutoff = None
    if n:
        h = n // 2
        halves = [[(h + 1) // 2, (h + 2) // 2], [n - h + (h + 1) // 2, n - h + (h + 2) // 2]]
        halves = [[r for r in ranks if 1 <= r <= n] for ranks in halves]
        at = exact_ranks(rows, sorted({r for ranks in halves for r in ranks}), n)
        q1, q3 = (sum(at[r] for r in ranks) / len(ranks) for ranks in halves)
        cutoff = q3 + 2.5 * (q3 - q1)
    return spark.range(1).select(F.lit(cutoff if n and least < cutoff else None).cast("double").alias("cutoff"))


def m4(points: DataFrame, keys: list[str], ts: str, value: str, start: int, width: int) -> DataFrame:
    """Points that a plot needs: of each bin the first, lowest, highest and last, each once.

    Of equal values the first counts. Points before `start` are skipped; null
    values are no points. Points of one key must differ in time.
    """
    rows = points.where((F.col(ts) >= start) & F.col(value).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(value).alias("value"))
    b = F.expr(f"(ts - {start}) div {width}")
    agg = rows.groupBy(*keys, b.alias("bin")).agg(
        F.min(F.struct("ts", "value")).alias("a"), F.max(F.struct("ts", "value")).alias("d"),
        F.min(F.struct("value", "ts")).alias("lo"), F.max(F.struct("value", (-F.col("ts")).alias("ts"))).alias("hi"),
    )
    four = F.array("a", "d", F.struct(F.col("lo.ts").alias("ts"), F.col("lo.value").alias("value")), F.struct((-F.col("hi.ts")).alias("ts"), F.col("hi.value").alias("value")))
    return agg.select(*keys, "bin", F.inline(F.array_distinct(four)))


def m4_range(points: DataFrame, keys: list[str], ts: str, value: str, start: int, ns_per_bin: float, n_bins: int) -> DataFrame:
    """As `m4`, for a range of n_bins bins whose width need not be whole.

    Bin x ends before round((x + 1) * ns_per_bin + start). The first point
    after the range comes too, as bin n_bins, so that a line leads to it.
    """
    rows = points.where((F.col(ts) >= start) & F.col(value).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(value).alias("value"))
    x = F.floor((F.col("ts") - start) / F.lit(ns_per_bin)).cast("bigint")
    at = F.when((F.col("_x") > 0) & (F.col("ts") < F.round(F.col("_x") * ns_per_bin + start)), F.col("_x") - 1).when(F.col("ts") < F.round((F.col("_x") + 1) * ns_per_bin + start), F.col("_x")).otherwise(F.col("_x") + 1)
    rows = rows.withColumn("_x", x).withColumn("bin", F.least(at, F.lit(n_bins))).drop("_x")
    agg = rows.groupBy(*keys, "bin").agg(
        F.min(F.struct("ts", "value")).alias("a"), F.max(F.struct("ts", "value")).alias("d"),
        F.min(F.struct("value", "ts")).alias("lo"), F.max(F.struct("value", (-F.col("ts")).alias("ts"))).alias("hi"),
    )
    four = F.array("a", "d", F.struct(F.col("lo.ts").alias("ts"), F.col("lo.value").alias("value")), F.struct((-F.col("hi.ts")).alias("ts"), F.col("hi.value").alias("value")))
    return agg.select(*keys, "bin", F.inline(F.when(F.col("bin") < n_bins, F.array_distinct(four)).otherwise(F.array("a"))))


def point_strip(points: DataFrame, keys: list[str], min_width: int, tiny_only: bool = False) -> DataFrame:
    """Points and short spans merged as by `merge_tiny`, each at least min_width wide around its middle.

    With tiny_only those stay that stand for several or are below min_width.
    """
    t = merge_tiny(points, keys, min_width)
    narrow, middle = F.expr(f"end_ns - start_ns < {min_width}"), F.expr("start_ns + (end_ns - start_ns) div 2")
    if tiny_only:
        t = t.where((F.col("n") > 1) | narrow)
    return t.select(*keys, F.when(narrow, middle - min_width // 2).otherwise(F.col("start_ns")).alias("start_ns"), F.when(narrow, middle + min_width // 2).otherwise(F.col("end_ns")).alias("end_ns"), "n")


def with_background(mix: DataFrame, keys: list[str]) -> DataFrame:
    """State mixes of which no more than a whole is taken; what is left of a whole is '(background)'."""
    total = mix.groupBy(*keys).agg(F.sum("fraction").alias("_t"))
    scaled = mix.join(total, keys).select(*keys, "state", (F.col("fraction") / F.greatest(F.lit(1.0), F.col("_t"))).alias("fraction"))
    return scaled.unionByName(total.where("_t < 1").select(*keys, F.lit("(background)").alias("state"), (1 - F.col("_t")).alias("fraction")))


def merge_tiny(spans: DataFrame, keys: list[str], min_width: int) -> DataFrame:
    """Neighbouring short spans as one: (keys, start_ns, end_ns, n).

    A span begins a group if it or the span before is at least min_width long,
    or the gap between them is. Spans must not overlap; rows distinct.
    """
    rows = spans.where("end_ns >= start_ns").select(*keys, "span_id", "start_ns", "end_ns")
    apart = lambda ps, pe, s, e: (e - s >= min_width) | (s - pe >= min_width) | (pe - ps >= min_width)
    return balanced_islands(rows, keys, ["start_ns", "span_id"], "start_ns", "end_ns", [], apart, Scratch(spans.sparkSession, "tiny"))


def pyramid(spans: DataFrame, keys: list[str], base: int, levels: int) -> DataFrame:
    """(keys, level, tile, state, covered_ns): state mix at tile widths base * 2^level.

    The finest level comes from the spans, each coarser one from the level
    below it, so the spans are exploded once.
    """
    parts = explode_bins(spans.select(*keys, "state", "start_ns", "end_ns"), base, keys)
    finest = parts.groupBy(*keys, F.col("bucket").alias("tile"), "state").agg(F.sum("part_ns").alias("covered_ns"))
    up = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    tile = F.expr("shiftright(tile, level)")
    return up.groupBy(*keys, "level", tile.alias("tile"), "state").agg(F.sum("covered_ns").alias("covered_ns"))


def contiguous_runs(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, same: list[str]) -> DataFrame:
    """Stack-track merge: consecutive rows that touch and agree in `same` are one (gaps and islands)."""
    touch = lambda ps, pe, s, e: pe != s
    return balanced_islands(rows, keys, order, start, end, same, touch, Scratch(rows.sparkSession, "islands"))


def decimate_area_by_neighbours(points: DataFrame, keys: list[str], ts: str, value: str, min_area: float) -> DataFrame:
    """Points whose triangle with both neighbours has more than min_area, and the ends.

    Neighbours are the points before and after in the input: a dense curve
    loses all its inner points, however far it bends. See decimate_area.
    """
    rows = points.where(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    prev = balanced_prev(rows, keys, ["ts"], ["ts", "value"], Scratch(points.sparkSession, "area"))
    both = balanced_next(prev, keys, ["ts"], ["ts", "value"], Scratch(points.sparkSession, "area-next"), extra=["prev_ts", "prev_value", "value"])
    area = F.expr("abs((ts - prev_ts) * (next_value - prev_value) - (next_ts - prev_ts) * (value - prev_value)) / 2")
    return both.where(F.col("prev_ts").isNull() | F.col("next_ts").isNull() | (area > min_area)).select(*keys, "ts", "value")


def decimate_area(points: DataFrame, keys: list[str], ts: str, value: str, min_area: float) -> DataFrame:
    """Points whose triangle with the last kept point and the next one has more than min_area, and the ends.

    Each test waits for the one before, so a series is folded in order by one
    task, in sorted Arrow batches that hold one point over; many series share a
    task. Points of one key must differ in time.
    """
    rows = points.where(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    at = [len(keys), len(keys) + 1]

    def fold(batches):
        key = kept = held = None
        for b in batches:
            take, cols = [], [c.to_pylist() for c in b.columns]
            for row in zip(*cols):
                k, t, v = row[: at[0]], row[at[0]], row[at[1]]
                if held is None or k != key:
                    if held is not None and held is not kept:
                        take.append(held)
                    key, kept, held = k, row, row
                    take.append(row)
                    continue
                if held is not kept:
                    (t0, v0), (t1, v1) = kept[at[0] :], held[at[0] :]
                    if abs((t1 - t0) * (v - v0) - (t - t0) * (v1 - v0)) / 2 > min_area:
                        kept = held
                        take.append(held)
                held = row
            if take:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*take), b.schema)], schema=b.schema)
                schema = b.schema
            elif b.num_rows:
                schema = b.schema
        if held is not None and held is not kept:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held, schema)], schema=schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInArrow(fold, rows.schema)
