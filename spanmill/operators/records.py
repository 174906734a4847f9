"""Operators over the full event log: ranges, tasks, logs, samples, messages.

A record has event_id, ts, kind, g, p, stack_id and, by kind, one of the
structs trans, range, task, log, metric (see sources.files.RECORD_SCHEMA).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import Scratch
from .intervals import trace_extent
from .sweep import balanced_prefix


def range_owner(name: Column, scope_kind: Column, scope_id: Column, g: Column) -> Column:
    """Struct (container, container_id) of a range; null for threads and for ranges of everything."""
    of = lambda c, i: F.struct(F.lit(c).alias("container"), i.cast("bigint").alias("container_id"))
    return (
        F.when(F.startswith(name, F.lit("stop-the-world")), of("STW", F.lit(0)))
        .when(name == "GC concurrent mark phase", of("GC", F.lit(0)))
        .when(name == "GC mark assist", of("G", g))
        .when(scope_kind == "Goroutine", of("G", scope_id))
        .when(scope_kind == "Proc", of("P", scope_id))
    )


def ranges(records: DataFrame) -> DataFrame:
    """(container, container_id, name, start_event, start_ns, end_event, end_ns, bytes_swept, bytes_reclaimed).

    A begin opens a range of its owner and name, an end closes the latest one;
    of several ends the last counts, ends before any begin are ignored, and
    what nothing closes ends with the trace. RangeActive counts before the
    first Sync only, as a begin at the start of the trace. Bytes are attributes
    of the end. Ranges of threads and of everything are ignored, ends too.
    """
    extent = trace_extent(records)
    rows = records.where("kind in ('RangeBegin', 'RangeEnd', 'RangeActive')")
    owner = range_owner(F.col("range.name"), F.col("range.scope_kind"), F.col("range.scope_id"), F.col("g"))
    rows = rows.select("event_id", "ts", "kind", owner.alias("o"), F.col("range.name").alias("name"), F.col("range.attrs").alias("attrs"))
    rows = rows.where("o.container_id is not null").select("o.*", "name", "event_id", "ts", "kind", "attrs")
    first_sync = records.where("kind = 'Sync'").agg(F.min("event_id")).scalar()
    rows = rows.select("*", first_sync.alias("_sync"), extent.select("trace_start").scalar().alias("_t0"), extent.select("trace_end").scalar().alias("_t1"))
    rows = rows.where("kind <> 'RangeActive' or _sync is null or event_id < _sync")
    rows = rows.withColumns({"b": (F.col("kind") != "RangeEnd").cast("bigint"), "ts": F.when(F.col("kind") == "RangeActive", F.col("_t0")).otherwise(F.col("ts"))})
    keys = ["container", "container_id", "name"]
    swept = F.element_at("attrs", "bytes swept").alias("swept")
    rows = rows.select(*keys, "event_id", "ts", "b", swept, F.element_at("attrs", "bytes reclaimed").alias("reclaimed"), "_t1")
    run = balanced_prefix(rows, keys, ["event_id"], "b", Scratch(records.sparkSession, "scoped-ranges")).where("run > 0")
    begin, end = F.col("b") == 1, F.when(F.col("b") == 0, F.col("event_id"))
    last = F.max(F.when(F.col("b") == 0, F.struct("event_id", "ts", "swept", "reclaimed")))
    one = run.groupBy(*keys, "run").agg(F.min(F.when(begin, F.col("event_id"))).alias("start_event"), F.min(F.when(begin, F.col("ts"))).alias("start_ns"), F.max(end).alias("end_event"), last.alias("l"), F.max("_t1").alias("_t1"))
    return one.select(*keys, "start_event", "start_ns", "end_event", F.coalesce("l.ts", "_t1").alias("end_ns"), F.col("l.swept").alias("bytes_swept"), F.col("l.reclaimed").alias("bytes_reclaimed"))


def overlay(found: DataFrame, start: int, end: int) -> DataFrame:
    """Collector and stop-the-world ranges that touch [start, end), for the axis."""
    return found.where(F.col("container").isin("GC", "STW") & (F.col("end_ns") > start) & (F.col("start_ns") < end)).select("container", "name", "start_ns", "end_ns")


def tasks(records: DataFrame) -> DataFrame:
    """(task_id, parent, name, start_event, start_ns, end_event, end_ns, created_by, stub, n_refs).

    Tasks that begin, end, or are named by a log or as a parent. A stub has no
    begin: its parent and name come from its end, if it has one. Of several
    begins the first counts, of several ends the last. created_by is the
    goroutine of the begin, null where it has none. Parent 0 is none, a task
    without an id is no task. One
    exchange, with partial aggregation, whatever a task's number of references.
    """
    is_begin, is_end = F.col("kind") == "TaskBegin", F.col("kind") == "TaskEnd"
    own = F.when(is_begin | is_end, F.struct(F.col("task.id").alias("task_id"), F.when(is_begin, "begin").otherwise("end").alias("role")))
    up = F.when((is_begin | is_end) & (F.col("task.parent") != 0), F.struct(F.col("task.parent").alias("task_id"), F.lit("ref").alias("role")))
    named = F.when((F.col("kind") == "Log") & (F.col("log.task") != 0), F.struct(F.col("log.task").alias("task_id"), F.lit("ref").alias("role")))
    rows = records.where("kind in ('TaskBegin', 'TaskEnd', 'Log')").select("event_id", "ts", "g", "task", F.explode(F.filter(F.array(own, up, named), lambda r: r["task_id"].isNotNull())).alias("r"))
    at = F.struct("event_id", "ts", "g", F.col("task.parent").alias("parent"), F.col("task.type").alias("name"))
    role = lambda x: F.when(F.col("r.role") == x, at)
    one = rows.groupBy("r.task_id").agg(F.min(role("begin")).alias("b"), F.max(role("end")).alias("e"), F.count(F.when(F.col("r.role") == "ref", 1)).alias("n_refs"))
    parent = F.coalesce("b.parent", "e.parent")
    return one.select(
        "task_id", F.when(parent != 0, parent).alias("parent"), F.coalesce("b.name", "e.name").alias("name"),
        F.col("b.event_id").alias("start_event"), F.col("b.ts").alias("start_ns"), F.col("e.event_id").alias("end_event"), F.col("e.ts").alias("end_ns"),
        F.when(F.col("b.event_id") > 0, F.col("b.g")).alias("created_by"), F.col("b").isNull().alias("stub"), "n_refs",
    )


def event_links(records: DataFrame) -> DataFrame:
    """(container, container_id, event_id, class): events of goroutines (G) and tasks (T).

    Of a goroutine: its logs, what it created and unblocked, tasks it began. Of
    a task: its logs, begins and ends of its children.
    """
    link = lambda c, i, cls, when: F.when(when & i.isNotNull(), F.struct(F.lit(c).alias("container"), i.alias("container_id"), F.lit(cls).alias("class")))
    kind, move = F.col("kind"), (F.col("kind") == "StateTransition") & (F.col("trans.res_kind") == "Goroutine") & (F.col("trans.to_state") == "Runnable")
    g, task, parent = F.col("g"), F.nullif(F.col("log.task"), F.lit(0)), F.nullif(F.col("task.parent"), F.lit(0))
    every = F.array(
        link("G", g, "log", kind == "Log"), link("G", g, "create", move & (F.col("trans.from_state") == "NotExist")), link("G", g, "unblock", move & (F.col("trans.from_state") == "Waiting")),
        link("G", g, "task", kind == "TaskBegin"), link("T", task, "log", kind == "Log"), link("T", parent, "child begin", kind == "TaskBegin"), link("T", parent, "child end", kind == "TaskEnd"),
    )
    return records.select("event_id", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("l")).select("l.container", "l.container_id", "event_id", "l.class")


def event_class(records: DataFrame) -> DataFrame:
    """Adds `class`: create, unblock, syscall, log or task; null for other records."""
    to, from_ = F.col("trans.to_state"), F.col("trans.from_state")
    move = (F.col("kind") == "StateTransition") & (F.col("trans.res_kind") == "Goroutine")
    cls = (
        F.when(move & (to == "Runnable") & (from_ == "NotExist"), "create").when(move & (to == "Runnable") & (from_ == "Waiting"), "unblock").when(move & (to == "Syscall"), "syscall")
        .when(F.col("kind") == "Log", "log").when(F.col("kind").isin("TaskBegin", "TaskEnd"), "task")
    )
    return records.withColumn("class", cls)


def event_messages(records: DataFrame, stacks: DataFrame) -> DataFrame:
    """(event_id, class, message) of the events that a list shows. `stacks` has stack_id and funcs, leaf first."""
    rows = event_class(records).where("class is not null")
    number = lambda c: F.format_number(c, 0)
    leaf = stacks.where("size(funcs) > 0").select(F.col("stack_id").alias("_s"), F.col("funcs")[0].alias("_leaf"))
    # only syscalls show a function: other rows meet no stack
    rows = rows.withColumn("_st", F.when(F.col("class") == "syscall", F.coalesce("trans.stack_id", "stack_id"))).join(leaf, F.col("_st") == F.col("_s"), "left")
    other = F.when(F.col("log.category") != "", F.concat(F.lit("<"), "log.category", F.lit("> "), "log.message")).otherwise(F.col("log.message"))
    message = (
        F.when(F.col("class") == "create", F.concat(F.lit("Created goroutine "), number(F.col("trans.res_id"))))
        .when(F.col("class") == "unblock", F.concat(F.lit("Unblocked goroutine "), number(F.col("trans.res_id"))))
        .when(F.col("class") == "syscall", F.coalesce(F.concat(F.lit("Syscall ("), "_leaf", F.lit(")")), F.lit("Syscall")))
        .when(F.col("kind") == "TaskBegin", F.concat(F.lit("Created task "), number(F.col("task.id"))))
        .when(F.col("kind") == "TaskEnd", F.concat(F.lit("Subtask ended: "), number(F.col("task.id"))))
        .otherwise(other)
    )
    return rows.select("event_id", "class", message.alias("message"))


def timelines(goroutines: DataFrame, task_table: DataFrame) -> DataFrame:
    """Goroutines by id with the tasks that each created after it: (g, is_task, task_id, label), in order.

    `goroutines` has g and func. Tasks of no goroutine come first.
    """
    one = goroutines.select("g", F.lit(0).alias("is_task"), F.lit(None).cast("bigint").alias("task_id"), text.goroutine_label(F.col("g"), F.col("func")).alias("label"))
    two = task_table.select(F.col("created_by").alias("g"), F.lit(1).alias("is_task"), "task_id", text.task_label(F.col("task_id"), F.col("name")).alias("label"))
    return one.unionByName(two).orderBy(F.asc_nulls_first("g"), "is_task", "task_id")


def samples(records: DataFrame, by: str | None = None) -> DataFrame:
    """CPU samples (event_id, ts, g, p, stack_id): all, or those with a goroutine ('g') or processor ('p')."""
    out = records.where("kind = 'StackSample'").select("event_id", "ts", "g", "p", "stack_id")
    return out if by is None else out.where(F.col(by).isNotNull())


def metric_points(records: DataFrame) -> DataFrame:
    """(metric_name, ts, value) of each reading of a metric."""
    return records.where("kind = 'Metric'").select(F.col("metric.name").alias("metric_name"), "ts", F.col("metric.value").alias("value"))


def effective_times(owners: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, eff_start, eff_end): the owner's own times, else those of its first and last span, else 0.

    `owners` has key, start_ns, end_ns; `spans` key, seq, start_ns, end_ns.
    """
    s = spans.groupBy(F.col(key).alias("_k")).agg(F.min("start_ns").alias("_s"), F.max_by("end_ns", "seq").alias("_e"))
    out = owners.join(s, F.col(key) == F.col("_k"), "left")
    return out.select(key, F.coalesce("start_ns", "_s", F.lit(0)).alias("eff_start"), F.coalesce("end_ns", "_e", F.lit(0)).alias("eff_end"))


def shifted(df: DataFrame, offset: Column, *times: str) -> DataFrame:
    """Times counted from `offset`, for display; give -offset to go back."""
    return df.withColumns({t: F.col(t) - offset for t in times})


def could_match(container: Column, track: Column, func: Column, states: list[str]) -> Column:
    """Whether a track can hold any of the states at all, by what it is; a cheap test before spans are read.

    Processors pass always. Without states nothing matches.
    """
    if not states:
        return F.lit(False)
    has = lambda *s: F.lit(bool(set(s) & set(states)))
    return (
        F.when(container == "P", F.lit(True)).when(container.isin("GC", "STW"), has("active")).when(track == "region", has("user region")).when(track == "task", has("task")).when(track == "stack", has("stack"))
        .when(F.coalesce(func == "runtime.bgsweep", F.lit(False)), has("active", "inactive")).otherwise(F.lit(True))
    )
