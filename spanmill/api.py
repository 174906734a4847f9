"""One object for a trace: its tables, and each analysis as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .functions.text import timeline_matches
from .operators import bins, coverage, hierarchy, intervals, joins, records, stacks, stats


class TraceDataset:
    """Analyses of an event log (see sources.files.EVENT_SCHEMA) and its stacks."""

    def __init__(self, events: DataFrame, stack_table: DataFrame | None = None):
        self.events = events
        self.stacks = stack_table

    @classmethod
    def from_events(cls, events: DataFrame, stack_table: DataFrame | None = None) -> TraceDataset:
        return cls(events, stack_table)

    def spans(self) -> DataFrame:
        return intervals.goroutine_spans(self.events).withColumn("span_id", F.col("start_event"))

    def processors(self) -> DataFrame:
        return intervals.processor_spans(self.events)

    def goroutines(self) -> DataFrame:
        out = self.spans().groupBy("g").agg(F.min("start_ns").alias("eff_start"), F.max("end_ns").alias("eff_end"), F.count("*").alias("n_spans"))
        return out.join(intervals.goroutine_functions(self.events, self.stacks), "g", "left") if self.stacks is not None else out

    def tasks(self) -> DataFrame:
        """Tasks and stubs; the log must have `task` and `log` (see sources.files.RECORD_SCHEMA)."""
        return records.tasks(self.events)

    def ranges(self) -> DataFrame:
        """Ranges of the collector, of stops of the world, of goroutines and processors."""
        return records.ranges(self.events)

    def links(self) -> DataFrame:
        return records.event_links(self.events)

    def messages(self) -> DataFrame:
        return records.event_messages(self.events, self.stacks)

    def timelines(self) -> DataFrame:
        return records.timelines(self.goroutines(), self.tasks())

    def samples(self, by: str | None = None) -> DataFrame:
        return records.samples(self.events, by)

    @staticmethod
    def _one(df: DataFrame, what: str, ident: int) -> Row:
        row = df.head(1)
        if not row:
            raise KeyError(f"no {what} {ident}")
        return row[0]

    def goroutine(self, g: int) -> Row:
        """One goroutine; KeyError if the trace has none of this id. The id goes down to the scan."""
        one = TraceDataset(self.events.where((F.col("trans.res_kind") == "Goroutine") & (F.col("trans.res_id") == g) | (F.col("kind") != "StateTransition")), self.stacks)
        return self._one(one.goroutines().where(F.col("g") == g), "goroutine", g)

    def processor(self, p: int) -> Row:
        """First start, last end and number of spans of one processor; KeyError if there is none."""
        own = self.processors().where(F.col("p") == p)
        return self._one(own.groupBy("p").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n_spans")), "processor", p)

    def task(self, task_id: int) -> Row:
        """One task; KeyError if the trace has none of this id."""
        return self._one(self.tasks().where(F.col("task_id") == task_id), "task", task_id)

    def stats(self, by: tuple[str, ...] = ("state",)) -> DataFrame:
        return stats.compute_statistics(self.spans(), list(by))

    def busy(self, bucket_ns: int) -> DataFrame:
        return bins.processor_busy(self.processors(), "p", bucket_ns)

    def heatmap(self, bucket_ns: int, y_size: int) -> DataFrame:
        return stats.heat(self.busy(bucket_ns), y_size)

    def flame(self, g: int | None = None) -> DataFrame:
        """Samples that have a processor, by time; of one goroutine its samples and the time that it was blocked."""
        on = stacks.on_cpu(self.events)
        if g is None:
            return stacks.weighted_flame(on.where("p is not null"), self.stacks)
        off = stacks.off_cpu(self.events, self.stacks)
        parts = on.select("g", "stack_id", "root", "w").unionByName(off.select("g", "stack_id", "root", "w"))
        return stacks.weighted_flame(parts.where(F.col("g") == g), self.stacks)

    def stack_tracks(self, level: int | None = None) -> DataFrame:
        """One row per goroutine, level and run of equal frames; all levels, or one."""
        return stacks.stack_tracks(self.events, self.stacks, level)

    def histogram(self, df: DataFrame, value: str, n_bins: int = 100, reject_outliers: bool = False, row_id: str = "span_id") -> DataFrame:
        return bins.histogram(df, value, n_bins, cutoff=bins.outlier_cutoff(df, value, row_id) if reject_outliers else None)

    def events_in(self, spans: DataFrame, width_ns: int = 100_000_000) -> DataFrame:
        """`spans` has g, span_id, start_ns, end_ns."""
        return joins.events_in_spans(spans, self.events.where("g is not null"), "g", width_ns)

    def gaps(self) -> DataFrame:
        s = self.spans().withColumn("container", F.lit("G"))
        return coverage.gaps(s, "container", "g")

    def downsample(self, points: DataFrame, keys: list[str], ts: str, value: str, start: int, width_ns: int) -> DataFrame:
        return bins.m4(points, keys, ts, value, start, width_ns)

    def family(self, goroutines: DataFrame) -> DataFrame:
        return hierarchy.hierarchy(goroutines)

    def search(self, query: str, timelines: DataFrame, kind: Column, ident: Column, label: Column) -> DataFrame:
        return timelines.where(timeline_matches(query, kind, ident, label))
