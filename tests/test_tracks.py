"""Stack tracks, flame weights and area filters by hand-made traces."""

import pytest

from spanmill.api import TraceDataset
from spanmill.sources.files import EVENT_SCHEMA

STACKS = [(1, ["a", "main"]), (2, ["b", "main"]), (3, ["a", "main", "runtime.main", "runtime.goexit"])]


def trace(spark, rows):
    """Rows (event_id, ts, from, to, reason, stack), or (event_id, ts, stack) for a sample; goroutine 1 on processor 0."""
    full = [(r[0], r[1], "StackSample", 1, 0, 0, r[2], None) if len(r) == 3 else (r[0], r[1], "StateTransition", 1, 0, 0, None, ("Goroutine", 1, *r[2:])) for r in rows]
    return TraceDataset.from_events(spark.createDataFrame(full, EVENT_SCHEMA), spark.createDataFrame(STACKS, "stack_id bigint, funcs array<string>"))


EVENTS = [
    (0, 0, "NotExist", "Running", None, None),
    (1, 10, 3),
    (2, 20, 3),
    (3, 30, "Running", "Waiting", "select", 1),
    (4, 40, "Waiting", "Syscall", None, 2),
    (5, 1000, "Syscall", "Running", None, None),
    (6, 1010, "Running", "NotExist", None, None),
]


def test_stack_tracks_join_equal_frames_by_level(spark):
    got = {tuple(r) for r in trace(spark, EVENTS).stack_tracks().select("g", "level", "func", "state", "start_ns", "end_ns", "n_samples").collect()}
    # samples touch; the outermost frame stays while the leaf changes
    assert got == {
        (1, 0, "main", "CPU sample", 10, 30, 2),
        (1, 1, "a", "CPU sample", 10, 30, 2),
        (1, 0, "main", "stack", 30, 1000, 0),
        (1, 1, "a", "stack", 30, 40, 0),
        (1, 1, "b", "stack", 40, 1000, 0),
    }
    assert trace(spark, EVENTS).stack_tracks(1).count() == 3


def test_flame_weighs_paths_by_time(spark):
    t = trace(spark, EVENTS)
    whole = {tuple(r.path): r.duration for r in t.flame(1).collect()}
    # the processor has 1010 ns of spans and two samples; waits last 10 and 960 ns
    assert whole[("Running",)] == 1010 and whole[("Running", "runtime.goexit", "runtime.main", "main", "a")] == 1010
    assert whole[("select", "main", "a")] == 10 and whole[("blocking syscall", "main", "b")] == 960
    assert {tuple(r.path)[0] for r in t.flame().collect()} == {"Running"}


LONG = 9 * 10**18  # two of these exceed a BIGINT


def saved(spark, path, moves, samples=()):
    """A folder with the tables of a trace: moves (g, p, ts, from, to, reason, stack), samples (g, stack)."""
    full = [(i, m[2], "StateTransition", m[0], m[1], 0, None, ("Goroutine", m[0], *m[3:])) for i, m in enumerate(moves)]
    full += [(len(full) + i, LONG, "StackSample", g, 0, 0, stack, None) for i, (g, stack) in enumerate(samples)]
    spark.createDataFrame([*full, (len(full), LONG, "Sync", None, None, None, None, None)], EVENT_SCHEMA).write.parquet(f"{path}/trace_events.parquet")
    spark.createDataFrame([*STACKS, (4, ["main"])], "stack_id bigint, funcs array<string>").write.parquet(f"{path}/stacks.parquet")
    return str(path)


def test_flame_shares_of_roots_that_exceed_a_bigint_together(spark, tmp_path):
    from spanmill.plans.records import QUERIES

    d = saved(spark, tmp_path, [(1, None, 0, "Running", "Waiting", "select", 1), (2, None, 0, "Running", "Syscall", None, 2)])
    got = {r.path: (r.pct_top, r.pct_visible) for r in QUERIES["flame_shares"](spark, d).collect()}
    assert got == {p: (100.0, 50.0) for p in ("select", "select;main", "select;main;a", "blocking syscall", "blocking syscall;main", "blocking syscall;main;b")}


#: Two goroutines that wait, two that run on processors of their own, each for all the trace.
LONG_MOVES = [(1, None, 0, "Running", "Waiting", "select", 1), (2, None, 0, "Running", "Waiting", "select", 2), (3, 0, 0, "Runnable", "Running", None, None), (4, 1, 0, "Runnable", "Running", None, None)]


def test_flame_prefix_time_beyond_a_bigint(spark, tmp_path):
    from spanmill.plans.trace import QUERIES

    d = saved(spark, tmp_path, LONG_MOVES, [(3, 1), (4, 2), (4, 2)])
    out = QUERIES["flame_prefix_time"](spark, d)
    once, share = LONG, 2 * LONG // 3
    want = {"select": 2 * once, "select;main": 2 * once, "select;main;a": once, "select;main;b": once}
    want |= {"Running": 3 * share, "Running;main": 3 * share, "Running;main;a": share, "Running;main;b": 2 * share}
    assert dict(out.dtypes)["duration"] == "decimal(38,0)" and {r.path: int(r.duration) for r in out.collect()} == want


def test_flame_self_time_beyond_a_bigint(spark, tmp_path):
    from spanmill.plans.trace import QUERIES

    # a third wait, whose stack ends where the others have their leaves
    d = saved(spark, tmp_path, [*LONG_MOVES, (5, None, 0, "Running", "Waiting", "select", 4)])
    got = {r.path: (int(r.self), r.n_children, r.pct_parent) for r in QUERIES["flame_self_time"](spark, d).collect()}
    assert got == {"select": (0, 1, None), "select;main": (LONG, 2, 100.0), "select;main;a": (LONG, 0, 33.333333), "select;main;b": (LONG, 0, 33.333333)}


#: Moves, samples and (self, n_children, pct_parent) by path, where single values fit a BIGINT and what comes of them does not.
FAR = {
    # time runs backwards for the third goroutine: no duration is too long, but what "main" has without "a" is
    "backwards": (
        [(1, None, 0, "Running", "Waiting", "select", 4), (2, None, 0, "Running", "Waiting", "select", 4), (3, None, LONG, "Running", "Waiting", "select", 1), (3, None, 0, "Waiting", "Running", None, None)],
        [],
        {"select": (0, 1, None), "select;main": (2 * LONG, 1, 100.0), "select;main;a": (-LONG, 0, -100.0)},
    ),
    "one span": ([(1, None, -LONG, "Running", "Waiting", "select", 4)], [], {"select": (0, 1, None), "select;main": (2 * LONG, 0, 100.0)}),
    "one sample for two processors": (LONG_MOVES[2:], [(3, 4)], {"Running": (0, 1, None), "Running;main": (2 * LONG, 0, 100.0)}),
}


@pytest.mark.parametrize("case", FAR)
def test_flame_self_time_of_values_that_fit_alone(spark, tmp_path, case):
    from spanmill.plans.trace import QUERIES

    moves, samples, want = FAR[case]
    out = QUERIES["flame_self_time"](spark, saved(spark, tmp_path, moves, samples))
    assert dict(out.dtypes)["self"] == "decimal(38,0)" and {r.path: (int(r.self), r.n_children, r.pct_parent) for r in out.collect()} == want


def test_flame_metrics_add_up_in_any_order(spark):
    from spanmill.operators.stacks import flame_metrics

    x = 6 * 10**18
    for kids in ([x, x, -x], [-x, -x, x]):
        tree = [(["r"], 1, sum(kids)), *[(["r", str(i)], 2, w) for i, w in enumerate(kids)]]
        # in one partition: rows are added as they stand here
        out = flame_metrics(spark.createDataFrame(tree, "path array<string>, depth int, duration bigint").coalesce(1))
        assert {tuple(r.path): (int(r.self), r.n_children) for r in out.collect()} == {("r",): (0, 3), **{("r", str(i)): (w, 0) for i, w in enumerate(kids)}}


def test_flame_self_time_takes_the_stack_of_each_transition(spark, tmp_path):
    from spanmill.plans.trace import QUERIES

    # an event that is in the log twice is two spans, of which one takes no time
    d = saved(spark, tmp_path, [(1, None, 0, "Running", "Waiting", "select", 1), (2, None, 5, "Running", "Syscall", None, 2), (1, None, 9, "Waiting", "Running", None, None)])
    events = spark.read.parquet(f"{d}/trace_events.parquet")
    events.unionByName(events.where("event_id = 0")).coalesce(1).write.parquet(f"{d}/again/trace_events.parquet")
    spark.read.parquet(f"{d}/stacks.parquet").coalesce(1).write.parquet(f"{d}/again/stacks.parquet")
    got = {r.path: int(r.self) for r in QUERIES["flame_self_time"](spark, f"{d}/again").collect()}
    assert got == {"select": 0, "select;main": 0, "select;main;a": 9, "blocking syscall": 0, "blocking syscall;main": 0, "blocking syscall;main;b": LONG - 5}


def test_flame_duration_is_bigint_up_to_its_last_value(spark):
    from spanmill.operators.stacks import weighted_flame

    stacks = spark.createDataFrame(STACKS, "stack_id bigint, funcs array<string>")
    for more, kind in ((0, "bigint"), (1, "decimal(38,0)")):
        tree = weighted_flame(spark.createDataFrame([(1, "select", 2**63 - 6), (2, "select", 5 + more)], "stack_id bigint, root string, w bigint"), stacks)
        assert dict(tree.dtypes)["duration"] == kind and {int(r.duration) for r in tree.where("depth = 1").collect()} == {2**63 - 1 + more}


def test_area_filter_keeps_the_curve(spark):
    import math

    from spanmill.operators.bins import decimate_area

    curves = {n: [(n, i * 3_600_000_000_000 // n, 1000 * math.sin(2 * math.pi * i / n)) for i in range(n)] for n in (1, 2, 20, 100, 1000)}
    want = set()
    for pts in curves.values():
        out = pts[:1]
        for b, c in zip(pts[1:], pts[2:]):
            a = out[-1]
            if abs((b[1] - a[1]) * (c[2] - a[2]) - (c[1] - a[1]) * (b[2] - a[2])) / 2 > 1e12:
                out.append(b)
        want |= {*out, pts[-1]}
    df = spark.createDataFrame([p for c in curves.values() for p in c] + [(20, 5, None)], "k int, t bigint, v double").orderBy("v")
    got = decimate_area(df, ["k"], "t", "v", 1e12).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r.k == 1000 for r in got) > 2
