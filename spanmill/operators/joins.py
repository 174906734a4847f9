"""Interval and as-of joins without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .sweep import balanced_next


def events_in_spans(spans: DataFrame, events: DataFrame, key: str, width: int) -> DataFrame:
    """(key, span_id, event_id): events of a span's container with start_ns <= ts < end_ns.

    Both sides meet on (key, time bin), so a container with most of the rows is
    cut along time; a span reaches the bins that it touches. Spans longer than
    64 bins meet the events at a coarser bin, by powers of two, so no span
    makes more than 64 rows. An event is looked up at the levels that spans of
    its own container have, mostly one or two; containers without spans drop
    out first.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("end_ns") - F.col("start_ns")) / F.lit(64.0 * width)))).cast("int")
    s = spans.where("end_ns > start_ns").select(key, "span_id", "start_ns", "end_ns").withColumn("level", F.least(level, F.lit(40)))
    s = Scratch(spans.sparkSession, "levels").put(s)
    levels = s.groupBy(key).agg(F.collect_set("level").alias("_levels"))  # 41 at most
    w = F.expr(f"{width} * shiftleft(1L, level)")
    s = s.withColumn("_w", w).withColumn("bin", F.explode(F.expr("sequence(start_ns div _w, (end_ns - 1) div _w)"))).drop("_w")
    e = events.join(levels, key).select(key, "event_id", "ts", F.explode("_levels").alias("level")).withColumn("bin", F.expr(f"ts div ({width} * shiftleft(1L, level))"))
    return s.join(e, [key, "level", "bin"]).where("ts >= start_ns and ts < end_ns").select(key, "span_id", "event_id")


def next_time(points: DataFrame, key: str, ts: str, row_id: str, kind: str) -> DataFrame:
    """As-of: every point with the time of the next one of its key (a balanced sweep)."""
    rows = points.select(key, F.col(ts).alias("ts"), row_id, kind)
    return balanced_next(rows, [key], ["ts", row_id], ["ts"], Scratch(points.sparkSession, "asof"), extra=[kind])
