import pytest

from spanmill.api import TraceDataset
from spanmill.operators import frames, intervals, records
from spanmill.sources.files import RECORD_SCHEMA
from spanmill.streaming.stateful import stream_gauges

NONE = (None,) * 4


def rec(i, kind, g=None, p=None, trans=None, range_=None, task=None, log=None, ts=None, metric=None):
    return (i, 10 * i if ts is None else ts, kind, g, p, None, None, trans, range_, task, log, metric)


def log_of(spark, rows):
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def test_processors(spark):
    own = lambda i, p, a, b: rec(i, "StateTransition", trans=("Proc", p, a, b, None, None))
    run = lambda i, g, a, b, p: rec(i, "StateTransition", p=p, trans=("Goroutine", g, a, b, None, None))
    rows = [rec(0, "Sync"), own(1, 0, "Undetermined", "Running"), run(2, 7, "Runnable", "Running", 0), run(3, 7, "Running", "Waiting", 0), run(4, 8, "Waiting", "Runnable", 0), own(5, 0, "Running", "Idle"), own(6, 0, "Idle", "Idle"), own(7, 0, "Idle", "Running"), own(8, 1, "NotExist", "Running"), rec(9, "Sync")]
    got = sorted(tuple(r)[:3] + (r.state.removeprefix("proc "),) for r in intervals.processor_spans(log_of(spark, rows)).collect())
    assert got == [(0, 0, 20, "running without goroutine"), (0, 20, 30, "running"), (0, 30, 50, "waiting for goroutine to unblock"), (0, 70, 90, "running without goroutine"), (1, 80, 90, "running without goroutine")]


def test_ranges(spark):
    r = lambda i, kind, name, scope="None", ident=None, g=None, **attrs: rec(i, kind, g=g, range_=(name, scope, ident, {k.replace("_", " "): v for k, v in attrs.items()}))
    mark, assist = "GC concurrent mark phase", "GC mark assist"
    rows = [
        r(0, "RangeEnd", mark), r(1, "RangeActive", mark), rec(2, "Sync"), r(3, "RangeActive", "stop-the-world (x)"), r(4, "RangeEnd", mark), r(5, "RangeBegin", assist, g=3), r(6, "RangeBegin", assist, g=4),
        r(7, "RangeEnd", assist, g=3), r(8, "RangeEnd", assist, g=3), r(9, "RangeBegin", "sweep", "Proc", 2), r(10, "RangeEnd", "sweep", "Proc", 2, bytes_swept=5, bytes_reclaimed=1),
        r(11, "RangeBegin", "x", "Thread", 1), r(12, "RangeEnd", "x", "Thread", 1), r(13, "RangeEnd", "y"), r(14, "RangeBegin", "stop-the-world (x)"), r(15, "RangeBegin", None),
    ]
    got = {(x.container, x.container_id, x.start_event): (x.start_ns, x.end_event, x.end_ns, x.bytes_swept, x.bytes_reclaimed) for x in records.ranges(log_of(spark, rows)).collect()}
    assert got == {
        ("GC", 0, 1): (0, 4, 40, None, None), ("G", 3, 5): (50, 8, 80, None, None), ("G", 4, 6): (60, None, 150, None, None),
        ("P", 2, 9): (90, 10, 100, 5, 1), ("STW", 0, 14): (140, None, 150, None, None),
    }
    over = records.overlay(records.ranges(log_of(spark, rows)), 40, 140)
    assert over.count() == 0 and records.overlay(records.ranges(log_of(spark, rows)), 39, 141).count() == 2
    assert records.ranges(log_of(spark, [])).count() == 0


def test_tasks(spark):
    rows = [
        rec(0, "TaskBegin", g=9, task=(5, 0, "zero")), rec(1, "TaskBegin", g=1, task=(10, 3, "ten")), rec(2, "Log", g=2, log=(11, "", "hello")), rec(3, "TaskEnd", task=(12, 10, "late")),
        rec(4, "TaskEnd", task=(10, 3, "other")), rec(5, "TaskBegin", g=4, task=(10, 3, "again")), rec(6, "Log", g=2, log=(0, "c", "m")), rec(7, "TaskEnd", task=None), rec(8, "TaskBegin", task=(13, None, None)),
    ]
    data = log_of(spark, rows)
    got = {r.task_id: tuple(r)[1:] for r in records.tasks(data).collect()}
    assert got == {
        3: (None, None, None, None, None, None, None, True, 3), 5: (None, "zero", 0, 0, None, None, None, False, 0), 10: (3, "ten", 1, 10, 4, 40, 1, False, 1),
        11: (None, None, None, None, None, None, None, True, 1), 12: (10, "late", None, None, 3, 30, None, True, 0), 13: (None, None, 8, 80, None, None, None, False, 0),
    }
    links = {tuple(r) for r in records.event_links(data).collect()}
    assert links == {
        ("G", 9, 0, "task"), ("G", 1, 1, "task"), ("T", 3, 1, "child begin"), ("G", 2, 2, "log"), ("T", 11, 2, "log"), ("T", 10, 3, "child end"), ("T", 3, 4, "child end"), ("G", 4, 5, "task"), ("T", 3, 5, "child begin"), ("G", 2, 6, "log"),
    }
    stacks = spark.createDataFrame([(1, ["a.b"])], "stack_id bigint, funcs array<string>")
    text = {r.event_id: r.message for r in records.event_messages(data, stacks).collect()}
    assert text[2] == "hello" and text[6] == "<c> m" and text[1] == "Created task 10" and text[3] == "Subtask ended: 12"
    t = TraceDataset.from_events(data, stacks)
    assert t.task(12).name == "late"
    for look in (t.task, t.goroutine, t.processor):
        with pytest.raises(KeyError):
            look(777)


def test_could_match(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("P", "state", None), ("G", "state", "runtime.bgsweep"), ("G", "state", None), ("G", "region", "f"), ("GC", "state", None)], "c string, t string, f string")
    ask = lambda *states: [r[0] for r in df.select(records.could_match(F.col("c"), F.col("t"), F.col("f"), list(states))).collect()]
    assert ask() == [False] * 5 and ask("blocked (sync)") == [True, False, True, False, False]
    assert ask("active") == [True, True, True, False, True] and ask("user region") == [True, False, True, True, False]


def test_frames(spark):
    rows = [(1, "a.f", "/x/a.go", 3, 0), (1, "a.g", "/x/b.go", 4, 1), (2, "runtime.h", "/r/go/src/runtime/h.go", 5, 0), (None, "z", "z", 1, 0)]
    d = frames.frame_dictionary(spark.createDataFrame(rows, "pc bigint, func string, file string, line int, seq bigint"))
    st = spark.createDataFrame([(7, [1, 2, 99]), (7, [1, 2, 99]), (8, [])], "stack_id bigint, pcs array<bigint>")
    got = {r.stack_id: [tuple(f) for f in r.frames] for r in frames.resolve(st, d).collect()}
    assert got == {7: [("a.g", "/x/b.go", 4), ("runtime.h", "/r/go/src/runtime/h.go", 5), (None, None, None)]}
    assert frames.go_root(d).first()[0] == "/r/go" and frames.go_root(d.where("false")).first()[0] == ""


def test_gauges_of_a_stream(spark, tmp_path):
    moves = [("NotExist", "Runnable"), ("Runnable", "Running"), ("Running", "Waiting"), ("Waiting", "Runnable"), ("Runnable", "Running")]
    rows = [rec(i, "StateTransition", trans=("Goroutine", g, a, b, None, None), ts=10 * (i // 2)) for i, (g, (a, b)) in enumerate((g, m) for m in moves for g in (1, 2))]
    for i in range(3):
        log_of(spark, rows[i * 4 : i * 4 + 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    out = stream_gauges(spark, str(tmp_path / "s"), files_per_batch=1)
    want = {tuple(r) for r in intervals.gauges(log_of(spark, rows)).collect()}
    assert {tuple(r) for r in out.collect()} == want
