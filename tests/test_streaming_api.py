from spanmill.api import TraceDataset
from spanmill.operators.coverage import gaps
from spanmill.session import table
from spanmill.sources.files import TraceHeaderSource, read_events, write_statistics_csv
from spanmill.streaming.stateful import bursts, busy_windows, coverage_state, open_spans, streamed_gaps


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_open_spans(spark, tmp_path):
    rows = [(g, 10 * i + g, 100 * i, f"s{i}") for g in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "g bigint, event_id bigint, ts bigint, state string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = run(open_spans(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "g"), "closed", "append")
    assert {tuple(r) for r in out.collect()} == {(g, 100 * i, 100 * i + 100, f"s{i}") for g in (1, 2) for i in range(5)}


def test_coverage_stream_ends_as_the_batch(spark, tmp_path):
    big = 2**60
    rows = [("G", i % 3, (i * 37) % 500, (i * 37) % 500 + 1 + i % 9) for i in range(90)] + [("G", 1, 900, None), ("G", 1, 950, 960), ("G", 2, 700, 1200), ("P", 0, big + 1, big + 3), ("P", 0, big + 5, big + 6)]
    rows += [("P", 1, 5, 5), ("P", None, 1, 2), (None, 1, 1, 2), ("P", 1, None, 4), ("P", 2, -30, -20), ("P", 2, -11, 7), ("G", 0, 0, 4)]
    df = spark.createDataFrame(rows, "container string, container_id bigint, start_ns bigint, end_ns bigint")
    df.repartition(3).write.parquet(str(tmp_path / "c"))
    want = {tuple(r) for r in gaps(df).collect()}
    assert len(want) > 20
    for width in (16, 1000):
        assert {tuple(r) for r in streamed_gaps(spark, str(tmp_path / "c"), files_per_batch=1, width=width).collect()} == want


def test_coverage_state_sends_changes_only(spark, tmp_path):
    schema = "container string, container_id bigint, start_ns bigint, end_ns bigint"
    for i, rows in enumerate([[("G", 1, 0, 5), ("G", 1, 10, 15), ("G", 1, 20, 25)], [("G", 1, 5, 10)], [("G", 1, 6, 7)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    got = run(coverage_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))), "changes", "append").collect()
    total = {}
    for r in got:
        total[r.period_start, r.period_end] = total.get((r.period_start, r.period_end), 0) + r.change
    assert {k for k, n in total.items() if n} == {(0, 15), (20, 25)}
    # the third file changes nothing
    assert len(got) <= 3 + 3


def test_windows_and_sessions(spark, tmp_path):
    rows = [(1, i, i * 1_000_000_000) for i in range(5)] + [(1, 9, 100_000_000_000)]
    df = spark.createDataFrame(rows, "g bigint, event_id bigint, ts bigint")
    w = run(busy_windows(stream(spark, df, tmp_path / "w"), "g", "10 seconds", "0 seconds"), "w", "append")
    assert [r.n for r in w.collect() if r.n == 5] == [5]
    s = run(bursts(stream(spark, df, tmp_path / "s"), "g", "5 seconds", "0 seconds"), "s", "append")
    assert 5 in [r.n for r in s.collect()]


def test_api(spark, sf_dir):
    t = TraceDataset.from_events(table(spark, sf_dir, "trace_events"), table(spark, sf_dir, "stacks"))
    n = t.spans().count()
    assert n > 0 and t.stats().agg({"cnt": "sum"}).first()[0] == n
    assert t.goroutines().count() > 0 and t.flame(1).count() > 0 and t.gaps().count() >= 0
    assert t.heatmap(3_600_000_000_000, 10).count() > 0


def test_sources(spark, sf_dir, tmp_path):
    assert read_events(spark, f"{sf_dir}/trace_events.parquet").count() > 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "ok").write_bytes(b"go 1.22 trace\0\0\0rest")
    (tmp_path / "b" / "short").write_bytes(b"go")
    (tmp_path / "b" / "other").write_bytes(b"x" * 40)
    spark.dataSource.register(TraceHeaderSource)
    out = {r.path.rsplit("/", 1)[1]: (r.version, r.problem) for r in spark.read.format("trace_header").load(str(tmp_path / "b")).collect()}
    assert out == {"ok": ("1.22", None), "short": (None, "shorter than a header"), "other": (None, "not a trace")}
    write_statistics_csv(spark.createDataFrame([("Active", 1)], "State string, Count bigint"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["State", "Count"]
