"""From the event log to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import WAIT_STATES
from ..session import Scratch
from .sweep import balanced_next, balanced_prefix, balanced_prev


def wait_state(reason: Column) -> Column:
    """State of a wait; null for a reason that is not known, 'blocked (other)' for none."""
    known = F.create_map(*[F.lit(x) for kv in WAIT_STATES.items() for x in kv])
    return known[F.coalesce(reason, F.lit(""))]


def transition_state(from_: Column, to: Column, reason: Column) -> Column:
    """State that a goroutine transition opens; null where it opens none."""
    runnable = F.when(from_ == "NotExist", "created").when(reason.isin("runtime.GoSched", "runtime.Gosched"), "inactive").otherwise("ready")
    return F.when(to == "Runnable", runnable).when(to == "Running", "active").when(to == "Syscall", "blocked (syscall)").when(to == "Waiting", wait_state(reason))


def goroutine_transitions(events: DataFrame) -> DataFrame:
    """(event_id, ts, g, from_state, to_state, reason, by_g, p); re-statements are dropped."""
    t = events.where("kind = 'StateTransition' and trans.res_kind = 'Goroutine' and not (trans.from_state <=> trans.to_state)")
    return t.select("event_id", "ts", F.col("trans.res_id").alias("g"), "trans.from_state", "trans.to_state", "trans.reason", F.col("g").alias("by_g"), "p", F.col("trans.stack_id").alias("stack_id"))


def trace_extent(events: DataFrame) -> DataFrame:
    """One row: trace_start, trace_end and duration_ns, 0 for an empty trace."""
    one = events.agg(F.min_by("ts", "event_id").alias("s"), F.max_by("ts", "event_id").alias("e"))
    return one.select(F.coalesce("s", F.lit(0)).alias("trace_start"), F.coalesce("e", F.lit(0)).alias("trace_end"), F.coalesce(F.col("e") - F.col("s"), F.lit(0)).alias("duration_ns"))


def goroutine_spans(events: DataFrame) -> DataFrame:
    """State spans of goroutines: (g, start_ns, end_ns, start_event, end_event, state, before_trace).

    A transition ends the span before it. A transition to NotExist only ends
    one. A span from Undetermined starts with the trace; the last span of a
    goroutine ends with the trace and has no end event. Successors come from a
    balanced sweep, so a goroutine with most of the events is no long task.
    """
    moves = goroutine_transitions(events)
    paired = balanced_next(moves, ["g"], ["event_id"], ["ts", "event_id"], Scratch(events.sparkSession, "spans"), extra=["from_state", "to_state", "reason"])
    extent = trace_extent(events)
    opened = paired.where("to_state <> 'NotExist'").select("*", extent.select("trace_start").scalar().alias("trace_start"), extent.select("trace_end").scalar().alias("trace_end"))
    return opened.select(
        "g",
        F.when(F.col("from_state") == "Undetermined", F.col("trace_start")).otherwise(F.col("ts")).alias("start_ns"),
        F.coalesce("next_ts", "trace_end").alias("end_ns"),
        F.col("event_id").alias("start_event"),
        F.col("next_event_id").alias("end_event"),
        transition_state(F.col("from_state"), F.col("to_state"), F.col("reason")).alias("state"),
        (F.col("from_state") == "Undetermined").alias("before_trace"),
    )


def spans_with_stack(events: DataFrame, states: list[str]) -> DataFrame:
    """State spans (g, start_ns, end_ns, state, stack_id) of goroutine_spans whose state is one of `states` and whose transition has a stack.

    The sweep carries no more than the time of all other transitions.
    """
    moves = goroutine_transitions(events)
    state = F.when(F.col("to_state") != "NotExist", transition_state(F.col("from_state"), F.col("to_state"), F.col("reason")))
    kept = state.isin(*states) & F.col("stack_id").isNotNull()
    marked = {"state": state, "stack_id": F.col("stack_id"), "before_trace": F.col("from_state") == "Undetermined"}
    lean = moves.select("g", "event_id", "ts", *[F.when(kept, c).alias(name) for name, c in marked.items()])
    paired = balanced_next(lean, ["g"], ["event_id"], ["ts"], Scratch(events.sparkSession, "stack-spans"), extra=[*marked]).where("state is not null")
    extent = trace_extent(events)
    paired = paired.select("*", extent.select("trace_start").scalar().alias("trace_start"), extent.select("trace_end").scalar().alias("trace_end"))
    start = F.when(F.col("before_trace"), F.col("trace_start")).otherwise(F.col("ts"))
    return paired.select("g", start.alias("start_ns"), F.coalesce("next_ts", "trace_end").alias("end_ns"), "state", "stack_id")


def stack_entries(events: DataFrame, stacks: DataFrame) -> DataFrame:
    """(g, event_id, start_ns, end_ns, state, funcs): what a goroutine's stack tracks show, funcs leaf first.

    State spans ('stack') and CPU samples ('CPU sample'). Transitions to
    Running have no stack of their own, and that of an unblocking belongs to
    another goroutine: neither is shown. A sample ends with the next span or
    sample of its goroutine, shown or not, the last one with its last span.
    Samples lose their outermost runtime.goexit and runtime.main, stacks all but
    the innermost 64 frames. Goroutines of runtime.bgsweep have no tracks.
    """
    moves = goroutine_transitions(events)
    hidden = F.coalesce((F.col("to_state") == "Running") | ((F.col("from_state") == "Waiting") & (F.col("to_state") == "Runnable")), F.lit(False))
    about = moves.select(F.col("event_id").alias("start_event"), F.col("ts"), "stack_id", hidden.alias("hidden"))
    spans = goroutine_spans(events).select("g", "start_event", "end_ns").join(about, "start_event")
    spans = spans.select("g", F.col("start_event").alias("event_id"), "ts", "end_ns", "stack_id", F.lit("stack").alias("state"), "hidden")
    samples = events.where("kind = 'StackSample' and g is not null")
    samples = samples.select("g", "event_id", "ts", F.lit(None).cast("bigint").alias("end_ns"), "stack_id", F.lit("CPU sample").alias("state"), F.lit(False).alias("hidden"))
    both = Scratch(events.sparkSession, "entries").put(spans.unionByName(samples))
    paired = balanced_next(both, ["g"], ["event_id"], ["ts"], Scratch(events.sparkSession, "entry-ends"), extra=["ts", "end_ns", "stack_id", "state", "hidden"])
    last = both.where("state = 'stack'").groupBy("g").agg(F.max_by("end_ns", "event_id").alias("last_ns"))
    swept = goroutine_functions(events, stacks).where("func = 'runtime.bgsweep'").select("g")
    shown = paired.where("not hidden").join(last, "g", "left").join(swept, "g", "left_anti").join(stacks, "stack_id")
    trace_end = trace_extent(events).select("trace_end").scalar()
    trim = lambda c, name: F.when(F.try_element_at(c, F.lit(-1)) == name, F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
    funcs = F.when(F.col("state") == "CPU sample", trim(trim(F.col("funcs"), "runtime.goexit"), "runtime.main")).otherwise(F.col("funcs"))
    return shown.select(
        "g", "event_id", F.col("ts").alias("start_ns"), F.coalesce("end_ns", "next_ts", "last_ns", trace_end).alias("end_ns"), "state", F.slice(funcs, 1, 64).alias("funcs")
    )


def processor_spans(events: DataFrame) -> DataFrame:
    """Processor spans (p, start_ns, end_ns, start_event, state).

    Of a processor's own transitions, Running opens 'proc running without
    goroutine' (from Undetermined: since the start of the trace) and Idle only
    closes. Of transitions of goroutines that name a processor, Running opens
    'proc running', a wait or syscall 'proc waiting for goroutine to unblock',
    the end of a goroutine 'proc running without goroutine'; one that becomes
    runnable does not cut. The last span ends with the trace.
    """
    state = (
        F.when(F.col("to_state") == "Running", "proc running")
        .when(F.col("to_state").isin("Waiting", "Syscall"), "proc waiting for goroutine to unblock")
        .when(F.col("to_state") == "NotExist", "proc running without goroutine")
    )
    cuts = goroutine_transitions(events).where("p is not null").select("p", "event_id", "ts", state.alias("state"), F.lit(False).alias("since_start")).where("state is not null")
    own = events.where("kind = 'StateTransition' and trans.res_kind = 'Proc' and not (trans.from_state <=> trans.to_state) and trans.to_state in ('Running', 'Idle')")
    own = own.select(
        F.col("trans.res_id").alias("p"), "event_id", "ts", F.when(F.col("trans.to_state") == "Running", "proc running without goroutine").otherwise("idle").alias("state"),
        F.coalesce(F.col("trans.from_state") == "Undetermined", F.lit(False)).alias("since_start"),
    )
    paired = balanced_next(cuts.unionByName(own), ["p"], ["event_id"], ["ts"], Scratch(events.sparkSession, "procs"), extra=["state", "since_start"]).where("state <> 'idle'")
    extent = trace_extent(events)
    paired = paired.select("*", extent.select("trace_start").scalar().alias("_t0"), extent.select("trace_end").scalar().alias("_t1"))
    start = F.when(F.col("since_start"), F.col("_t0")).otherwise(F.col("ts"))
    return paired.select("p", start.alias("start_ns"), F.coalesce("next_ts", "_t1").alias("end_ns"), F.col("event_id").alias("start_event"), "state")


def attached_events(events: DataFrame) -> DataFrame:
    """(g, event_id, class): goroutines that one created or unblocked."""
    t = goroutine_transitions(events).where("to_state = 'Runnable' and by_g is not null")
    cls = F.when(F.col("from_state") == "NotExist", "create").when(F.col("from_state") == "Waiting", "unblock")
    return t.select(F.col("by_g").alias("g"), "event_id", cls.alias("class")).where("class is not null")


def goroutine_functions(events: DataFrame, stacks: DataFrame) -> DataFrame:
    """(g, func): outermost frame of the first transition that has a stack."""
    t = goroutine_transitions(events).where("stack_id is not null")
    first = t.groupBy("g").agg(F.min_by("stack_id", "event_id").alias("stack_id"))
    return first.join(stacks.where("size(funcs) > 0"), "stack_id").select("g", F.element_at("funcs", -1).alias("func"))


def dense_ids(ids: DataFrame, column: str) -> DataFrame:
    """Each id with seq_id, its place in order from 0; a global number without one task."""
    one = ids.select(column).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return balanced_prefix(one, [], [column], "_one", Scratch(ids.sparkSession, "ids")).select(column, (F.col("run") - 1).alias("seq_id"))


def region_depths(log: DataFrame, delta: Column) -> DataFrame:
    """Rows of the log that open (+1) or close (-1) with the depth after them.

    A close without an open one is ignored: the depth is the running sum less
    the lowest it has been, when that is below 0.
    """
    marks = log.select("g", "event_id", "ts", delta.cast("bigint").alias("delta")).where("delta <> 0")
    run = balanced_prefix(marks, ["g"], ["event_id"], "delta", Scratch(log.sparkSession, "depth"))
    return run.select("g", "event_id", "ts", "delta", (F.col("run") - F.col("low")).alias("depth"), F.col("low"))


def region_pairs(log: DataFrame, delta: Column) -> DataFrame:
    """Nested regions (g, depth, start_event, start_ns, end_event, end_ns).

    An open region lies at the depth it makes; the next close to below that
    depth ends it. Regions still open end with the log and have no end event.
    """
    depths = region_depths(log, delta)
    # unmatched closes leave the depth at 0 and lower `low`
    level = F.when(F.col("delta") > 0, F.col("depth") - 1).otherwise(F.col("depth"))
    scratch = Scratch(log.sparkSession, "regions")
    before = balanced_prev(depths.select("g", "event_id", "ts", "delta", "depth", "low"), ["g"], ["event_id"], ["low"], scratch)
    ignored = (F.col("delta") < 0) & (F.col("low") < F.coalesce("prev_low", F.lit(0)))
    kept = before.where(~ignored).select("g", "event_id", "ts", "delta", level.alias("depth"))
    paired = balanced_next(kept, ["g", "depth"], ["event_id"], ["event_id", "ts", "delta"], Scratch(log.sparkSession, "pairs"), extra=["delta"])
    end = log.agg(F.max_by("ts", "event_id")).scalar()
    closed = F.col("next_delta") < 0
    return paired.where("delta > 0").select("*", end.alias("_end")).select(
        "g", "depth", F.col("event_id").alias("start_event"), F.col("ts").alias("start_ns"),
        F.when(closed, F.col("next_event_id")).alias("end_event"), F.when(closed, F.col("next_ts")).otherwise(F.coalesce("next_ts", "_end")).alias("end_ns"),
    )


def range_spans(log: DataFrame, begin: Column, finish: Column) -> DataFrame:
    """Ranges per scope (g, start_event, start_ns, end_event, end_ns).

    A begin opens a range, an end closes the latest one; of several ends in a
    row the last counts. A range that nothing closes ends with the log. Ends
    before any begin are ignored.
    """
    marks = log.select("g", "event_id", "ts", begin.cast("bigint").alias("b"), finish.cast("bigint").alias("e")).where("b = 1 or e = 1")
    grouped = balanced_prefix(marks, ["g"], ["event_id"], "b", Scratch(log.sparkSession, "ranges")).where("run > 0")
    end = log.agg(F.max_by("ts", "event_id")).scalar()
    one = grouped.groupBy("g", "run").agg(
        F.min_by("event_id", "event_id").alias("start_event"), F.min("ts").alias("start_ns"), F.max(F.when(F.col("e") == 1, F.col("event_id"))).alias("end_event"), F.max(F.when(F.col("e") == 1, F.col("ts"))).alias("_e")
    )
    return one.select("*", end.alias("_end")).select("g", "start_event", "start_ns", "end_event", F.coalesce("_e", "_end").alias("end_ns"))


def relabelled(log: DataFrame, is_state: Column, label: Column) -> DataFrame:
    """States (g, start_event, state) where a later label of the same span, the last one, replaces the state."""
    marks = log.select("g", "event_id", is_state.cast("bigint").alias("s"), "kind", label.alias("_label"))
    run = balanced_prefix(marks.where("s = 1 or _label is not null"), ["g"], ["event_id"], "s", Scratch(log.sparkSession, "labels")).where("run > 0")
    one = run.groupBy("g", "run").agg(F.min("event_id").alias("start_event"), F.min_by("kind", "event_id").alias("kind"), F.max_by("_label", F.when(F.col("_label").isNotNull(), F.col("event_id"))).alias("_l"))
    return one.select("g", "start_event", F.coalesce("_l", "kind").alias("state"))


def gauges(events: DataFrame) -> DataFrame:
    """(metric_name, ts, value): goroutines runnable, running and waiting after each time at which one changed.

    Deltas are summed per time first; the running sum over all time is a
    balanced sweep, not one task.
    """
    move = goroutine_transitions(events)
    cls = lambda c: F.when(c == "Runnable", "runnable").when(c == "Running", "running").when(c.isin("Waiting", "Syscall"), "waiting")
    both = F.array(F.struct(cls(F.col("from_state")).alias("gauge"), F.lit(-1).alias("d")), F.struct(cls(F.col("to_state")).alias("gauge"), F.lit(1).alias("d")))
    # a goroutine first seen from Undetermined was in no counted state before
    d = move.select("ts", F.inline(both)).where("gauge is not null").groupBy("gauge", "ts").agg(F.sum("d").cast("bigint").alias("d"))
    run = balanced_prefix(d, ["gauge"], ["ts"], "d", Scratch(events.sparkSession, "gauges"))
    return run.select(F.concat(F.lit("/sched/goroutines/"), "gauge", F.lit(":goroutines")).alias("metric_name"), "ts", F.col("run").alias("value"))
