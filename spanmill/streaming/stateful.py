"""Structured Streaming twins of the interval operators.

Times stay whole nanoseconds; only the column for watermarks is a timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.coverage import FOREVER, IntervalMap, gaps
from ..operators.intervals import gauges
from ..session import Scratch


def event_time(df: DataFrame, ts: str = "ts", name: str = "event_time") -> DataFrame:
    """Adds a microsecond timestamp for watermarks beside the nanosecond time."""
    return df.withColumn(name, F.timestamp_micros(F.expr(f"{ts} div 1000")))


def open_spans(events: DataFrame, key: str = "g", state: str = "state") -> DataFrame:
    """Closed spans (key, start_ns, end_ns, state) as soon as the next event of the key comes.

    Events of a batch are ordered by event_id; the last one of each key stays
    open in the state. Events older than the open one are late and ignored.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches)).drop_duplicates("event_id").sort_values("event_id")
        if st.exists:
            event, ts, label = st.get
            t = t[t["event_id"] > event]
            t = pd.concat([pd.DataFrame({"event_id": [event], "ts": [ts], state: [label]}), t[["event_id", "ts", state]]])
        if len(t):
            last = t.iloc[-1]
            st.update((int(last["event_id"]), int(last["ts"]), last[state]))
            n = len(t) - 1
            yield pd.DataFrame({key: [k[0]] * n, "start_ns": t["ts"].to_numpy()[:-1], "end_ns": t["ts"].to_numpy()[1:], "state": t[state].to_numpy()[:-1]})

    out = f"{key} bigint, start_ns bigint, end_ns bigint, state string"
    rows = events.select(key, "event_id", "ts", state)
    return rows.groupBy(key).applyInPandasWithState(step, out, "event_id bigint, ts bigint, state string", "append", GroupStateTimeout.NoTimeout)


#: Width of the stretches of time that an entity's interval map is split into.
STRETCH_NS = 6 * 3_600_000_000_000
#: A span that stays open has one row beyond all stretches, from its start on.
_OPEN = 2**62


def stretches(spans: DataFrame, k1: str, k2: str, width: int = STRETCH_NS) -> DataFrame:
    """(k1, k2, stretch, start_ns, end_ns): spans cut at the borders of stretches.

    Only the first and last stretch of a span are cut out, and what lies
    between is one row keyed by its first whole stretch: a span gives three
    rows at most, however long it is.
    """
    rows = spans.where(F.col(k1).isNotNull() & F.col(k2).isNotNull() & F.col("start_ns").isNotNull() & (F.col("end_ns").isNull() | (F.col("end_ns") > F.col("start_ns"))))
    rows = rows.select(k1, k2, F.col("start_ns").cast("bigint").alias("s"), F.coalesce(F.col("end_ns").cast("bigint"), F.lit(FOREVER)).alias("e"))
    rows = rows.withColumns({"_a": F.expr(f"cast((s - pmod(s, {width}L)) div {width} as bigint)"), "_b": F.expr(f"cast(((e - 1) - pmod(e - 1, {width}L)) div {width} as bigint)")})
    piece = lambda stretch, s, e: f"struct({stretch} as stretch, {s} as start_ns, {e} as end_ns)"
    whole = piece("-2 - abs(_a)", f"(_a + 1) * {width}L", f"_b * {width}L")
    cut = F.expr(
        f"case when e = {FOREVER}L then array({piece(f'{_OPEN}L', 's', 'e')}) when _a = _b then array({piece('_a', 's', 'e')}) "
        f"when _b = _a + 1 then array({piece('_a', 's', f'_b * {width}L')}, {piece('_b', f'_b * {width}L', 'e')}) "
        f"else array({piece('_a', 's', f'(_a + 1) * {width}L')}, {whole}, {piece('_b', f'_b * {width}L', 'e')}) end"
    )
    return rows.select(k1, k2, F.inline(cut))


def coverage_state(spans: DataFrame, k1: str = "container", k2: str = "container_id", width: int = STRETCH_NS) -> DataFrame:
    """Changes (k1, k2, stretch, period_start, period_end, change) of each entity's
    periods: 1 where one appears, -1 where one is gone.

    The keyed state is the ordered map of disjoint intervals of an entity in a
    stretch of time, so it stays small however long an entity lives. Spans may
    come in any order, repeated or late: an insertion finds the intervals that
    it touches by binary search and merges them, and only what it changed goes
    out. `periods_of` adds the changes up.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap(*st.get) if st.exists else IntervalMap()
        before = set(zip(held.starts.tolist(), held.ends.tolist()))
        for b in batches:
            held.insert(b["start_ns"].to_numpy(dtype=np.int64), b["end_ns"].to_numpy(dtype=np.int64))
        after = list(zip(held.starts.tolist(), held.ends.tolist()))
        st.update((held.starts.tolist(), held.ends.tolist()))
        rows = [(*p, 1) for p in after if p not in before] + [(*p, -1) for p in before.difference(after)]
        if rows:
            start, end, change = zip(*rows)
            yield pd.DataFrame({k1: [k[0]] * len(rows), k2: [k[1]] * len(rows), "stretch": [k[2]] * len(rows), "period_start": start, "period_end": end, "change": change})

    out = f"{k1} string, {k2} bigint, stretch bigint, period_start bigint, period_end bigint, change int"
    state = "starts array<bigint>, ends array<bigint>"
    return stretches(spans, k1, k2, width).groupBy(k1, k2, "stretch").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def periods_of(changes: DataFrame, k1: str = "container", k2: str = "container_id") -> DataFrame:
    """(k1, k2, start_ns, end_ns): the periods of each stretch after all changes; a null end is never."""
    now = changes.groupBy(k1, k2, "stretch", "period_start", "period_end").agg(F.sum("change").alias("n")).where("n > 0")
    return now.select(k1, k2, F.col("period_start").alias("start_ns"), F.when(F.col("period_end") < FOREVER, F.col("period_end")).alias("end_ns"))


def streamed_gaps(spark: SparkSession, path: str, files_per_batch: int = 1000, width: int = STRETCH_NS) -> DataFrame:
    """Gaps of the spans in files under `path`, read as a stream until all that is there now is taken in.

    Changes are appended to a table in the shared folder; stretches are joined
    where they meet by the batch operator, over periods instead of spans.
    """
    scratch = Scratch(spark, "coverage")
    # as a pattern, since a stream takes one file for its base folder otherwise
    pattern = f"{path[:-1]}[{path[-1]}]"
    schema = spark.read.parquet(path).schema
    changes = coverage_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern), width=width)
    q = changes.writeStream.format("parquet").option("path", f"{scratch.base}/changes").option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return gaps(periods_of(spark.read.schema(changes.schema).parquet(f"{scratch.base}/changes")))


def stream_gauges(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(metric_name, ts, value): `intervals.gauges` over files of events that come in order of time.

    Each batch is summed by the balanced sweep; only the last value of each of
    the three gauges is carried on, in a table of its own for each batch, so a
    batch that is done again gives the same. A time that two batches share
    counts with its last value.
    """
    scratch = Scratch(spark, "gauges")
    schema = "metric_name string, ts bigint, value bigint"

    def add(batch: DataFrame, n: int) -> None:
        now = gauges(batch)
        if n:
            before = spark.read.schema("metric_name string, value bigint").parquet(f"{scratch.base}/last/{n - 1}")
            carried = before.select("metric_name", F.col("value").alias("base"))
            now = now.join(carried, "metric_name", "left").select("metric_name", "ts", (F.col("value") + F.coalesce("base", F.lit(0))).alias("value"))
        now.write.mode("overwrite").parquet(f"{scratch.base}/out/batch={n}")
        last = spark.read.schema(schema).parquet(f"{scratch.base}/out/batch={n}").groupBy("metric_name").agg(F.max_by("value", "ts").alias("value"))
        if n:
            last = last.unionByName(before.join(last, "metric_name", "left_anti"))
        last.write.mode("overwrite").parquet(f"{scratch.base}/last/{n}")

    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    q = events.writeStream.foreachBatch(add).option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    every = spark.read.schema(schema + ", batch int").parquet(f"{scratch.base}/out")
    return every.groupBy("metric_name", "ts").agg(F.max_by("value", "batch").alias("value"))


def busy_windows(events: DataFrame, key: str, width: str = "100 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling window, appended once the watermark has passed it."""
    return event_time(events).withWatermark("event_time", late).groupBy(F.window("event_time", width), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def bursts(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of activity: stretches without a pause as long as `gap`."""
    return event_time(events).withWatermark("event_time", late).groupBy(F.session_window("event_time", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
