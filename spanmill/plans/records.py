"""Queries of the record, frame and view operators, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bins, frames, intervals, records, stacks, stats
from ..session import table
from ..sources import tables
from .trace import _BUSY, _D, _FLAME_TIME, _GOR, _LOG, _M, _NAMED, _SPANS, HOUR, _busy, _coded, _durations, _flame_time, _named, _points

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_REC = f"""{_LOG}, rec AS (
  SELECT event_id, ts, g, k, value, CASE WHEN k % 3 <> 0 THEN p END AS p, p AS p0,
    CASE kind WHEN 'signup' THEN 'TaskBegin' WHEN 'purchase' THEN 'TaskEnd' WHEN 'click' THEN 'RangeBegin' WHEN 'error' THEN 'RangeEnd'
      ELSE CASE WHEN k % 50 = 49 THEN 'Sync' WHEN k % 10 = 8 THEN 'RangeActive' WHEN k % 2 = 1 THEN 'StackSample' ELSE 'Log' END END AS kind,
    g // 10 AS parent, 'job ' || (k % 7) AS job, g // 3 AS log_task, CASE WHEN k % 4 = 0 THEN '' ELSE 'c' || (k % 4) END AS category, 'message ' || k AS message
  FROM lg)"""

# ------------------------------------------------------------ ranges
_RANGES = f"""{_REC}, ext AS (SELECT arg_min(ts, event_id) AS t0, arg_max(ts, event_id) AS t1, min(CASE WHEN kind = 'Sync' THEN event_id END) AS sync FROM rec),
rg AS (SELECT event_id, kind, value, k, CASE WHEN kind = 'RangeActive' THEN t0 ELSE ts END AS ts,
    CASE k % 5 WHEN 0 THEN 'GC' WHEN 1 THEN 'STW' WHEN 2 THEN 'G' WHEN 3 THEN 'P' END AS container, CASE k % 5 WHEN 2 THEN g WHEN 3 THEN p0 ELSE 0 END AS container_id,
    CASE k % 5 WHEN 0 THEN 'GC concurrent mark phase' WHEN 1 THEN 'stop-the-world (sweep)' WHEN 2 THEN 'GC mark assist' ELSE 'GC incremental sweep' END AS name
  FROM rec, ext WHERE kind IN ('RangeBegin', 'RangeEnd', 'RangeActive') AND k % 5 <> 4 AND (kind <> 'RangeActive' OR sync IS NULL OR event_id < sync)),
rn AS (SELECT *, sum(CASE WHEN kind <> 'RangeEnd' THEN 1 ELSE 0 END) OVER (PARTITION BY container, container_id, name ORDER BY event_id) AS run FROM rg),
ranges AS (SELECT container, container_id, name, min(CASE WHEN kind <> 'RangeEnd' THEN event_id END) AS start_event, min(CASE WHEN kind <> 'RangeEnd' THEN ts END) AS start_ns,
    max(CASE WHEN kind = 'RangeEnd' THEN event_id END) AS end_event, coalesce(arg_max(ts, event_id) FILTER (WHERE kind = 'RangeEnd'), (SELECT t1 FROM ext)) AS end_ns,
    arg_max(value, event_id) FILTER (WHERE kind = 'RangeEnd') AS bytes_swept, arg_max(k, event_id) FILTER (WHERE kind = 'RangeEnd') AS bytes_reclaimed
  FROM rn WHERE run > 0 GROUP BY container, container_id, name, run)"""


def _ranges(spark, sf_dir):
    return records.ranges(tables.records(spark, sf_dir))


@query(f"WITH {_RANGES} SELECT container, container_id, name, start_event, start_ns, end_event, end_ns FROM ranges")
def scoped_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir).drop("bytes_swept", "bytes_reclaimed")


@query(f"WITH {_RANGES} SELECT start_event, bytes_swept, bytes_reclaimed FROM ranges WHERE name = 'GC incremental sweep'")
def sweep_attributes(spark, sf_dir):
    return _ranges(spark, sf_dir).where("name = 'GC incremental sweep'").select("start_event", "bytes_swept", "bytes_reclaimed")


_DAY = 86_400_000_000_000
_FROM = 1_704_067_200_000_000_000


@query(f"WITH {_RANGES} SELECT container, name, start_ns, end_ns FROM ranges WHERE container IN ('GC', 'STW') AND end_ns > {_FROM + _DAY} AND start_ns < {_FROM + 3 * _DAY}")
def axis_overlay(spark, sf_dir):
    """Collector and stop-the-world ranges of the second and third day."""
    return records.overlay(_ranges(spark, sf_dir), _FROM + _DAY, _FROM + 3 * _DAY)


# ------------------------------------------------------------ tasks
_TASKS = f"""{_REC}, refs AS (
  SELECT parent AS task_id FROM rec WHERE kind IN ('TaskBegin', 'TaskEnd') AND parent <> 0 UNION ALL SELECT log_task FROM rec WHERE kind = 'Log' AND log_task <> 0),
rf AS (SELECT task_id, count(*) AS n_refs FROM refs GROUP BY 1),
bg AS (SELECT g AS task_id, min(event_id) AS start_event, arg_min(ts, event_id) AS start_ns, arg_min(parent, event_id) AS parent, arg_min(job, event_id) AS name FROM rec WHERE kind = 'TaskBegin' GROUP BY 1),
en AS (SELECT g AS task_id, max(event_id) AS end_event, arg_max(ts, event_id) AS end_ns, arg_max(parent, event_id) AS parent, arg_max(job, event_id) AS name FROM rec WHERE kind = 'TaskEnd' GROUP BY 1),
ids AS (SELECT task_id FROM rf UNION SELECT task_id FROM bg UNION SELECT task_id FROM en),
tasks AS (SELECT task_id, nullif(coalesce(bg.parent, en.parent), 0) AS parent, coalesce(bg.name, en.name) AS name, start_event, start_ns, end_event, end_ns,
  CASE WHEN start_event > 0 THEN task_id END AS created_by, start_event IS NULL AS stub, coalesce(n_refs, 0) AS n_refs
  FROM ids LEFT JOIN rf USING (task_id) LEFT JOIN bg USING (task_id) LEFT JOIN en USING (task_id))"""
_TASK_LABEL = "'task ' || format('{:,}', task_id) || CASE WHEN name <> '' THEN ': ' || name ELSE '' END"


def _tasks(spark, sf_dir):
    return records.tasks(tables.records(spark, sf_dir))


@query(f"WITH {_TASKS} SELECT * FROM tasks")
def tasks_and_stubs(spark, sf_dir):
    return _tasks(spark, sf_dir)


@query(f"WITH {_TASKS} SELECT task_id, name, n_refs FROM tasks WHERE stub")
def stub_tasks(spark, sf_dir):
    """Tasks that are only named, or only end."""
    return _tasks(spark, sf_dir).where("stub").select("task_id", "name", "n_refs")


@query(f"WITH {_TASKS} SELECT a.task_id, b.task_id AS parent_task, b.name AS parent_name, a.created_by FROM tasks a LEFT JOIN tasks b ON a.parent = b.task_id")
def task_parents(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    up = t.select(F.col("task_id").alias("parent_task"), F.col("name").alias("parent_name"))
    return t.join(up, t.parent == up.parent_task, "left").select("task_id", "parent_task", "parent_name", "created_by")


@query(
    f"""WITH {_TASKS}, e AS (SELECT max(ts) AS t1 FROM rec) SELECT task_id, coalesce(name, '') AS name, coalesce(end_ns, t1 + 1) - coalesce(start_ns, -1) AS sort_ns,
  CASE WHEN start_ns IS NULL AND end_ns IS NULL THEN t1 WHEN start_ns IS NULL THEN end_ns WHEN end_ns IS NULL THEN t1 - start_ns ELSE end_ns - start_ns END AS shown_ns, start_ns IS NULL OR end_ns IS NULL AS approx
FROM tasks, e ORDER BY sort_ns DESC, task_id"""
)
def tasks_by_duration(spark, sf_dir):
    """Tasks by duration; where the begin or the end is not known, what is known counts."""
    r = tables.records(spark, sf_dir)
    t = records.tasks(r).select("*", r.agg(F.max("ts")).scalar().alias("t1"))
    s, e = F.col("start_ns"), F.col("end_ns")
    shown = F.when(s.isNull() & e.isNull(), F.col("t1")).when(s.isNull(), e).when(e.isNull(), F.col("t1") - s).otherwise(e - s)
    return t.select(
        "task_id", F.coalesce("name", F.lit("")).alias("name"), (F.coalesce(e, F.col("t1") + 1) - F.coalesce(s, F.lit(-1))).alias("sort_ns"), shown.alias("shown_ns"), (s.isNull() | e.isNull()).alias("approx")
    ).orderBy(F.desc("sort_ns"), "task_id")


@query(
    f"""WITH {_TASKS}, {_GOR} SELECT g_id AS g, 0 AS is_task, NULL::BIGINT AS task_id, CASE WHEN coalesce(func, '') = '' THEN 'goroutine ' || g_id ELSE 'goroutine ' || g_id || ': ' || func END AS label FROM gor
UNION ALL SELECT created_by, 1, task_id, {_TASK_LABEL} FROM tasks ORDER BY 1 NULLS FIRST, 2, 3"""
)
def timelines_with_tasks(spark, sf_dir):
    return records.timelines(tables.goroutines(spark, sf_dir).select(F.col("g_id").alias("g"), "func"), _tasks(spark, sf_dir))


@query(
    f"""WITH {_TASKS}, l AS (SELECT 'T' AS container, task_id AS container_id, {_TASK_LABEL} AS label, 1 AS n_spans, start_ns, end_ns FROM tasks WHERE start_ns IS NOT NULL AND end_ns >= start_ns
  UNION ALL SELECT container, 0, CASE container WHEN 'GC' THEN 'GC' ELSE 'STW' END, count(*), min(start_ns), arg_max(end_ns, start_event) FROM (WITH {_RANGES} SELECT * FROM ranges) WHERE container IN ('GC', 'STW') GROUP BY 1)
SELECT *, end_ns - start_ns AS duration_ns FROM l"""
)
def timeline_table(spark, sf_dir):
    """What a jump to a timeline shows of tasks, the collector and stops of the world."""
    t = _tasks(spark, sf_dir).where("start_ns is not null and end_ns >= start_ns")
    one = t.select(F.lit("T").alias("container"), F.col("task_id").alias("container_id"), text.task_label(F.col("task_id"), F.col("name")).alias("label"), F.lit(1).cast("bigint").alias("n_spans"), "start_ns", "end_ns")
    r = _ranges(spark, sf_dir).where("container in ('GC', 'STW')").groupBy("container").agg(F.count("*").alias("n_spans"), F.min("start_ns").alias("start_ns"), F.max_by("end_ns", "start_event").alias("end_ns"))
    two = r.select("container", F.lit(0).cast("bigint").alias("container_id"), F.col("container").alias("label"), "n_spans", "start_ns", "end_ns")
    return one.unionByName(two).withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


# ------------------------------------------------------------ events
@query(
    f"""WITH {_REC} SELECT 'G' AS container, g AS container_id, event_id, 'log' AS class FROM rec WHERE kind = 'Log' UNION ALL SELECT 'G', g, event_id, 'task' FROM rec WHERE kind = 'TaskBegin'
UNION ALL SELECT 'T', log_task, event_id, 'log' FROM rec WHERE kind = 'Log' AND log_task <> 0 UNION ALL SELECT 'T', parent, event_id, 'child begin' FROM rec WHERE kind = 'TaskBegin' AND parent <> 0
UNION ALL SELECT 'T', parent, event_id, 'child end' FROM rec WHERE kind = 'TaskEnd' AND parent <> 0"""
)
def record_links(spark, sf_dir):
    return records.event_links(tables.records(spark, sf_dir))


_MOVE = "kind = 'StateTransition' AND trans.res_kind = 'Goroutine' AND trans.to_state = 'Runnable' AND g IS NOT NULL"


@query(f"SELECT 'G' AS container, g AS container_id, event_id, CASE trans.from_state WHEN 'NotExist' THEN 'create' ELSE 'unblock' END AS class FROM trace_events WHERE {_MOVE} AND trans.from_state IN ('NotExist', 'Waiting')")
def transition_links(spark, sf_dir):
    return records.event_links(_with_records(table(spark, sf_dir, "trace_events")))


def _with_records(events):
    """Events of transitions only, with the other records' columns."""
    return events.selectExpr("*", "cast(null as struct<id:bigint,parent:bigint,type:string>) as task", "cast(null as struct<task:bigint,category:string,message:string>) as log")


@query(f"WITH {_REC} SELECT event_id, CASE kind WHEN 'Log' THEN 'log' ELSE 'task' END AS class FROM rec WHERE kind IN ('Log', 'TaskBegin', 'TaskEnd')")
def event_list(spark, sf_dir):
    """The event list with logs and tasks shown."""
    return records.event_class(tables.records(spark, sf_dir)).where(F.col("class").isin("log", "task")).select("event_id", "class")


@query(
    f"""WITH {_REC} SELECT event_id, CASE kind WHEN 'Log' THEN 'log' ELSE 'task' END AS class,
  CASE kind WHEN 'TaskBegin' THEN 'Created task ' || format('{{:,}}', g) WHEN 'TaskEnd' THEN 'Subtask ended: ' || format('{{:,}}', g) ELSE CASE WHEN category <> '' THEN '<' || category || '> ' || message ELSE message END END AS message
FROM rec WHERE kind IN ('Log', 'TaskBegin', 'TaskEnd')"""
)
def record_messages(spark, sf_dir):
    return records.event_messages(tables.records(spark, sf_dir), table(spark, sf_dir, "stacks"))


@query(
    """WITH m AS (SELECT event_id, trans.res_id AS g, trans.from_state AS f, trans.to_state AS t, coalesce(trans.stack_id, stack_id) AS st FROM trace_events WHERE kind = 'StateTransition' AND trans.res_kind = 'Goroutine')
SELECT event_id, CASE WHEN t = 'Syscall' THEN 'syscall' WHEN f = 'NotExist' THEN 'create' ELSE 'unblock' END AS class,
  CASE WHEN t = 'Syscall' THEN CASE WHEN len(funcs) > 0 THEN 'Syscall (' || funcs[1] || ')' ELSE 'Syscall' END WHEN f = 'NotExist' THEN 'Created goroutine ' || format('{:,}', g) ELSE 'Unblocked goroutine ' || format('{:,}', g) END AS message
FROM m LEFT JOIN stacks ON m.st = stacks.stack_id AND t = 'Syscall' WHERE t = 'Syscall' OR t = 'Runnable' AND f IN ('NotExist', 'Waiting')"""
)
def transition_messages(spark, sf_dir):
    return records.event_messages(_with_records(table(spark, sf_dir, "trace_events")), table(spark, sf_dir, "stacks"))


@query(f"WITH {_REC}, s AS (SELECT * FROM rec WHERE kind = 'StackSample') SELECT 'p' AS by, p AS id, count(*) AS n FROM s WHERE p IS NOT NULL GROUP BY p UNION ALL SELECT 'g', g, count(*) FROM s WHERE g IS NOT NULL GROUP BY g UNION ALL SELECT 'all', NULL, count(*) FROM s")
def sample_index(spark, sf_dir):
    """CPU samples of each processor, of each goroutine, and all."""
    r = tables.records(spark, sf_dir)
    count = lambda by: records.samples(r, by).groupBy(F.lit(by).alias("by"), F.col(by).alias("id")).agg(F.count("*").alias("n"))
    return count("p").unionByName(count("g")).unionByName(records.samples(r).agg(F.count("*").alias("n")).select(F.lit("all").alias("by"), F.lit(None).cast("bigint").alias("id"), "n"))


@query(f"WITH {_REC} SELECT p, count(*) AS n, count(DISTINCT g) AS goroutines FROM rec WHERE kind = 'StackSample' AND p IS NOT NULL GROUP BY p")
def cpu_samples(spark, sf_dir):
    s = records.samples(tables.records(spark, sf_dir), "p")
    return s.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("g").alias("goroutines"))


_MIN = 60_000_000_000
_MERGED = f"""{_REC}, p AS (SELECT g, event_id, ts, lag(ts) OVER (PARTITION BY g ORDER BY ts, event_id) AS pt FROM rec WHERE kind = 'StackSample'),
r AS (SELECT *, sum(CASE WHEN pt IS NULL OR ts - pt >= {_MIN} THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY ts, event_id) AS run FROM p)"""


def _sample_points(spark, sf_dir):
    s = records.samples(tables.records(spark, sf_dir), "g")
    return s.select("g", F.col("event_id").alias("span_id"), F.col("ts").alias("start_ns"), F.col("ts").alias("end_ns"))


@query(f"WITH {_MERGED} SELECT g, min(ts) AS start_ns, max(ts) AS end_ns, count(*) AS n FROM r GROUP BY g, run")
def sample_track(spark, sf_dir):
    """Samples of each goroutine as points, merged where they are less than a minute apart."""
    return bins.merge_tiny(_sample_points(spark, sf_dir), ["g"], _MIN)




@query(
    f"""WITH {_MERGED}, t AS (SELECT g, min(ts) AS a, max(ts) AS b, count(*) AS n FROM r GROUP BY g, run)
SELECT g, CASE WHEN b - a < {_MIN} THEN a + (b - a) // 2 - {_MIN // 2} ELSE a END AS start_ns, CASE WHEN b - a < {_MIN} THEN a + (b - a) // 2 + {_MIN // 2} ELSE b END AS end_ns, n FROM t WHERE n > 1 OR b - a < {_MIN}"""
)
def sample_strip(spark, sf_dir):
    """The strip of samples that are merged or below a minute, each a minute wide at least."""
    return bins.point_strip(_sample_points(spark, sf_dir), ["g"], _MIN, tiny_only=True)


@query("SELECT DISTINCT series_id, metric_name, ts, reading AS value FROM metrics")
def metric_points(spark, sf_dir):
    m = table(spark, sf_dir, "metrics").select("series_id", "metric_name", "ts", "reading").distinct()
    return m.select("series_id", "metric_name", "ts", F.col("reading").alias("value"))


# ------------------------------------------------------------ owners and views
_TRACK = "container = 'G' AND track = 'state'"


@query(
    f"""WITH {_SPANS}, {_GOR}, x AS (SELECT container_id, min(start_ns) AS s, arg_max(end_ns, seq) FILTER (WHERE end_ns IS NOT NULL) AS e FROM s WHERE {_TRACK} GROUP BY 1)
SELECT g_id, coalesce(start_ns, x.s, 0) AS eff_start, coalesce(end_ns, x.e, 0) AS eff_end FROM gor LEFT JOIN x ON g_id = container_id"""
)
def effective_times(spark, sf_dir):
    s = tables.spans(spark, sf_dir, "container", "track", "container_id", "seq", "start_ns", "end_ns").where(_TRACK)
    s = s.select(F.col("container_id").alias("g_id"), "start_ns", "end_ns", F.when(F.col("end_ns").isNotNull(), F.col("seq")).alias("seq"))
    return records.effective_times(tables.goroutines(spark, sf_dir), s, "g_id")


@query(f"WITH {_SPANS}, {_GOR}, u AS (SELECT g_id FROM gor WHERE g_id IN (SELECT container_id FROM s WHERE container = 'G')) SELECT 'G' AS container, g_id AS id, row_number() OVER (ORDER BY g_id) - 1 AS seq_id FROM u UNION ALL SELECT 'P', container_id, row_number() OVER (ORDER BY container_id) - 1 FROM (SELECT DISTINCT container_id FROM s WHERE container = 'P')")
def dense_ids_in_use(spark, sf_dir):
    """Places of the goroutines and processors that have spans."""
    s = tables.spans(spark, sf_dir, "container", "container_id").select("container", F.col("container_id").alias("id")).distinct()
    g = tables.goroutines(spark, sf_dir).select(F.col("g_id").alias("id")).join(s.where("container = 'G'").select("id"), "id", "left_semi")
    number = lambda ids, c: intervals.dense_ids(ids, "id").select(F.lit(c).alias("container"), "id", "seq_id")
    return number(g, "G").unionByName(number(s.where("container = 'P'").select("id"), "P"))


@query("SELECT event_id, ts - (SELECT arg_min(ts, event_id) FROM trace_events) AS shown_ts, ts FROM trace_events")
def shown_times(spark, sf_dir):
    """Times counted from the start of the trace, and back again."""
    e = table(spark, sf_dir, "trace_events")
    t0 = intervals.trace_extent(e).select("trace_start").scalar()
    out = records.shifted(e.select("event_id", F.col("ts").alias("shown_ts"), "ts", t0.alias("t0")), F.col("t0"), "shown_ts", "ts")
    return records.shifted(out, -F.col("t0"), "ts").drop("t0")


@query(
    f"""WITH {_SPANS}, {_GOR} SELECT container, track, count(*) AS n, CAST(sum(CASE WHEN container = 'P' THEN 1 WHEN track = 'region' THEN 0 WHEN func = 'runtime.bgsweep' THEN 0 ELSE 1 END) AS BIGINT) AS could
FROM s LEFT JOIN gor ON container = 'G' AND container_id = g_id GROUP BY 1, 2"""
)
def filter_pruning(spark, sf_dir):
    """How many spans are left to look at when blocked states are searched for."""
    s = tables.spans(spark, sf_dir, "container", "container_id", "track")
    g = tables.goroutines(spark, sf_dir).select("g_id", "func")
    j = s.join(g, (s.container == "G") & (s.container_id == g.g_id), "left")
    could = records.could_match(F.col("container"), F.col("track"), F.col("func"), ["blocked (sync)", "blocked (select)"])
    return j.groupBy("container", "track").agg(F.count("*").alias("n"), F.sum(could.cast("bigint")).alias("could"))


@query(f"WITH {_NAMED} SELECT kind, span_id, container_id, start_ns FROM (SELECT * FROM s WHERE track = 'region') ORDER BY kind, start_ns, span_id")
def regions_of_label(spark, sf_dir):
    """Regions of each label over all goroutines, merged in order of their starts."""
    s = tables.spans(spark, sf_dir, "track", "kind", "container_id", "start_ns").where("track = 'region'")
    return s.select("kind", "span_id", "container_id", "start_ns").orderBy(F.asc_nulls_last("kind"), "start_ns", "span_id")


@query(f"WITH {_GOR}, x AS (SELECT g_id, eff_end - eff_start AS d FROM gor) SELECT g_id, d AS duration_ns FROM x WHERE d >= 1000000000")
def goroutines_from(spark, sf_dir):
    """Goroutines of a second or more: a range of durations that is open above."""
    g = tables.goroutines(spark, sf_dir).select("g_id", (F.col("eff_end") - F.col("eff_start")).alias("duration_ns"))
    return g.where(stats.in_range(F.col("duration_ns"), 1_000_000_000, 0))


_ROLL = ", ".join(f"CAST(coalesce(sum(CASE WHEN d.{c} AND end_ns >= start_ns THEN end_ns - start_ns END), 0) AS BIGINT) AS {c}_ns" for c in ("blocked", "running", "inactive", "gc_assist"))
_PCT = ", ".join(f"coalesce({c}_ns, 0) AS {c}_ns, round(100.0 * coalesce({c}_ns, 0) / nullif(eff_end - eff_start, 0), 6) AS {c}_pct" for c in ("blocked", "running", "inactive", "gc_assist"))
_CODED_SQL = _NAMED.split(", n AS (")[0]


@query(f"WITH {_CODED_SQL}, {_GOR}, r AS (SELECT container_id, count(*) AS n_spans, {_ROLL} FROM c LEFT JOIN state_dim d ON c.code = d.code WHERE {_TRACK} GROUP BY 1) SELECT g_id, eff_end - eff_start AS lifetime_ns, coalesce(n_spans, 0) AS n_spans, {_PCT} FROM gor LEFT JOIN r ON g_id = container_id")
def goroutine_shares(spark, sf_dir):
    """Each goroutine's time in the four classes of states, and its share of the lifetime."""
    dim = table(spark, sf_dir, "state_dim").withColumnRenamed("code", "state_code").drop("name", "label")
    s = _coded(spark, sf_dir, "container", "track", "container_id", "start_ns", "end_ns").where(_TRACK)
    r = s.join(dim, "state_code", "left").groupBy("container_id").agg(F.count("*").alias("n_spans"), *stats.roll_ups())
    g = tables.goroutines(spark, sf_dir)
    life, zero = F.col("eff_end") - F.col("eff_start"), lambda c: F.coalesce(c, F.lit(0))
    each = [x for c in ("blocked", "running", "inactive", "gc_assist") for x in (zero(f"{c}_ns").alias(f"{c}_ns"), F.round(F.try_divide(100.0 * zero(f"{c}_ns"), life), 6).alias(f"{c}_pct"))]
    return g.join(r, g.g_id == r.container_id, "left").select("g_id", life.alias("lifetime_ns"), zero("n_spans").alias("n_spans"), *each)


_GRID = f"{_BUSY}, heat AS (SELECT bucket AS x, least(pct // 10, 9) AS y, count(*) AS n FROM pct GROUP BY 1, 2)"


_RANKED = f"""{_GRID}, ee AS (SELECT CASE WHEN count(*) < (max(x) - min(x) + 1) * 10 THEN 1 ELSE 0 END AS e FROM heat), r AS (SELECT n, dense_rank() OVER (ORDER BY n) AS r FROM (SELECT DISTINCT n FROM heat)), f AS (SELECT count(*) AS k, max(n) AS top FROM r),
cells AS (SELECT x, y, heat.n, CAST(greatest(1, 255 * heat.n // top) AS BIGINT) AS linear, CAST(greatest(1, 255 * (r + e) // (k + e)) AS BIGINT) AS ranked FROM heat JOIN r USING (n), f, ee)"""


def _cells(spark, sf_dir):
    cells = stats.heat(_busy(spark, sf_dir), 10)
    return stats.heat_saturation(cells, cells.agg((F.max("x") - F.min("x") + 1) * 10).scalar())


@query(f"WITH {_RANKED} SELECT * FROM cells")
def heatmap_ranked(spark, sf_dir):
    """Cells of the heat map in its true grid, whose empty cells count as one more rank."""
    return _cells(spark, sf_dir)


@query(f"WITH {_RANKED} SELECT *, x * {HOUR} AS x_start, (x + 1) * {HOUR} AS x_end, y * 10 AS y_start, (y + 1) * 10 AS y_end FROM cells")
def heatmap_cells(spark, sf_dir):
    """Cells with the bounds shown under the pointer."""
    return stats.with_bounds(_cells(spark, sf_dir), HOUR, 10)


@query(
    f"""WITH {_FLAME_TIME}, tt AS (SELECT tree.*, r.duration AS top FROM tree JOIN tree r ON r.depth = 1 AND r.path[1] = tree.path[1]), al AS (SELECT sum(duration) AS total FROM tree WHERE depth = 1)
SELECT array_to_string(path, ';') AS path, round(CAST(duration AS DOUBLE) * 100 / nullif(top, 0), 6) AS pct_top, round(CAST(duration AS DOUBLE) * 100 / nullif(total, 0), 6) AS pct_visible FROM tt, al"""
)
def flame_shares(spark, sf_dir):
    """Share of each path in its top root, and in all that is visible when nothing is zoomed."""
    return stacks.flame_shares(_flame_time(spark, sf_dir)).select(F.array_join("path", ";").alias("path"), F.round("pct_top", 6).alias("pct_top"), F.round("pct_visible", 6).alias("pct_visible"))


@query(
    f"""WITH {_NAMED}, {_D}, r AS (SELECT v, row_number() OVER (ORDER BY v, span_id) AS i, count(*) OVER () AS n FROM d),
q AS (SELECT avg(CASE WHEN i = (n // 2 + 1) // 2 OR i = (n // 2 + 2) // 2 THEN v END) AS q1, avg(CASE WHEN i = n - n // 2 + (n // 2 + 1) // 2 OR i = n - n // 2 + (n // 2 + 2) // 2 THEN v END) AS q3 FROM r),
cut AS (SELECT q3 + 2.5 * (q3 - q1) AS c FROM q), w AS (SELECT CAST(max(v) AS DOUBLE) / 100 AS w, c FROM d, cut WHERE v < c GROUP BY c), mx AS (SELECT max(v) AS m FROM d)
SELECT bin, round(bin * w, 3) AS lo, round(CASE WHEN bin = 100 THEN m + 1.0 ELSE (bin + 1) * w END, 3) AS hi, count(*) AS n FROM (SELECT CASE WHEN v >= c THEN 100 ELSE CAST(least(floor(v / w), 99) AS BIGINT) END AS bin, w, m FROM d, w, mx) GROUP BY 1, 2, 3"""
)
def hist_outlier_bounds(spark, sf_dir):
    d = _durations(spark, sf_dir)
    h = bins.histogram(d, "v", cutoff=bins.outlier_cutoff(d, "v", "span_id"))
    return h.select("bin", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "n")


_BIN, _N_BINS = 61_234_567_890.25, 20_000


@query(
    f"""WITH {_M}, t AS (SELECT *, CAST(floor(ts / {_BIN}) AS BIGINT) AS x0 FROM m WHERE ts >= 0), b AS (
  SELECT series_id, ts, value, CASE WHEN x0 > 0 AND ts < round(x0 * {_BIN}) THEN x0 - 1 WHEN ts < round((x0 + 1) * {_BIN}) THEN x0 ELSE x0 + 1 END AS bin FROM t),
a AS (SELECT series_id, bin, min(ts) AS a, max(ts) AS d, min({{'v': value, 't': ts}}).t AS lo, -max({{'v': value, 't': -ts}}).t AS hi FROM b WHERE bin < {_N_BINS} GROUP BY 1, 2),
nx AS (SELECT series_id, min(ts) AS ts FROM b WHERE bin >= {_N_BINS} GROUP BY 1)
SELECT DISTINCT b.series_id, b.bin, b.ts, b.value FROM b JOIN a ON a.series_id = b.series_id AND a.bin = b.bin AND b.ts IN (a, d, lo, hi) UNION ALL SELECT b.series_id, {_N_BINS}, b.ts, b.value FROM b JOIN nx ON b.series_id = nx.series_id AND b.ts = nx.ts"""
)
def m4_range(spark, sf_dir):
    """A plot's points at a bin width that is no whole number, with the first point after the range."""
    return bins.m4_range(_points(spark, sf_dir), ["series_id"], "ts", "value", 0, _BIN, _N_BINS)


@query(
    f"""WITH {_SPANS}, e AS (SELECT state, start_ns, end_ns, container_id, unnest(range(start_ns // {HOUR}, (end_ns - 1) // {HOUR} + 1)) AS bucket FROM s WHERE container = 'P' AND end_ns > start_ns),
f AS (SELECT container_id, bucket, state, sum(least(end_ns, (bucket + 1) * {HOUR}) - greatest(start_ns, bucket * {HOUR})) / {HOUR}.0 AS f FROM e GROUP BY 1, 2, 3), t AS (SELECT container_id, bucket, sum(f) AS t FROM f GROUP BY 1, 2)
SELECT container_id, bucket, state, round(f / greatest(1, t), 6) AS fraction FROM f JOIN t USING (container_id, bucket) UNION ALL SELECT container_id, bucket, '(background)', round(1 - t, 6) FROM t WHERE t < 1"""
)
def pixel_shares(spark, sf_dir):
    """The mix of states of each processor and hour: at most a whole, the rest is background."""
    p = tables.spans(spark, sf_dir, "container", "container_id", "state", "start_ns", "end_ns").where("container = 'P'")
    return bins.with_background(bins.state_mix(p, ["container_id"], HOUR), ["container_id", "bucket"]).withColumn("fraction", F.round("fraction", 6))


_ST = "SELECT state, count(*) AS cnt, min(end_ns - start_ns) AS min_ns, max(end_ns - start_ns) AS max_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_ns, CAST(sum(end_ns - start_ns) AS DOUBLE) / count(*) AS average_ns, median(end_ns - start_ns) AS median_ns FROM n WHERE end_ns >= start_ns GROUP BY 1"


@query(
    f"""WITH {_NAMED}, st AS ({_ST}) SELECT name_cap AS "State", coalesce(cnt, 0) AS "Count", coalesce(min_ns, 0) AS "Min", coalesce(max_ns, 0) AS "Max", coalesce(total_ns, 0) AS "Total",
  printf('%.6f', coalesce(average_ns, 0)) AS "Average", printf('%.6f', coalesce(median_ns, 0)) AS "Median" FROM state_dim LEFT JOIN st ON st.state = name ORDER BY code"""
)
def csv_stats(spark, sf_dir):
    """Rows of the statistics file in their order: every named state, zeros where nothing was seen, averages as they are."""
    st = stats.compute_statistics(_named(spark, sf_dir, "start_ns", "end_ns"), ["state"])
    return stats.statistics_rows(st.withColumn("average_ns", F.col("total_ns").cast("double") / F.col("cnt")), table(spark, sf_dir, "state_dim"))


@query(
    f"""WITH {_SPANS}, d AS (SELECT DISTINCT end_ns - start_ns AS d FROM s WHERE end_ns >= start_ns), r AS (
  SELECT d, CAST(CASE WHEN d < 1000000 THEN d WHEN d < 1000000000 THEN (d + 500) // 1000 * 1000 ELSE (d + 500000) // 1000000 * 1000000 END AS BIGINT) AS r FROM d),
u AS (SELECT *, CASE WHEN r < 1000000 THEN 1000 WHEN r < 1000000000 THEN 1000000 ELSE 1000000000 END AS unit, CASE WHEN r < 1000000 THEN 3 WHEN r < 1000000000 THEN 6 ELSE 9 END AS digits, r % 60000000000 AS part FROM r),
v AS (SELECT d, r, CASE WHEN r >= 60000000000 THEN part ELSE r END AS x, unit, digits FROM u)
SELECT d, CASE WHEN r = 0 THEN '0s' WHEN r < 1000 THEN r || 'ns' ELSE (CASE WHEN r >= 3600000000000 THEN (r // 3600000000000) || 'h' ELSE '' END) || (CASE WHEN r >= 60000000000 THEN (r // 60000000000 % 60) || 'm' ELSE '' END)
  || (x // unit) || CASE WHEN x % unit = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(x % unit AS VARCHAR), digits, '0'), '0') END || CASE unit WHEN 1000 THEN 'µs' WHEN 1000000 THEN 'ms' ELSE 's' END END AS si FROM v"""
)
def durations_si(spark, sf_dir):
    d = tables.spans(spark, sf_dir, "start_ns", "end_ns").where("end_ns >= start_ns").select(stats.duration().alias("d")).distinct()
    return d.select("d", text.duration_si(F.col("d")).alias("si"))


@query(f"WITH {_SPANS} SELECT container, container_id, track, min(start_ns) AS lo, max(coalesce(end_ns, start_ns)) AS hi FROM s GROUP BY 1, 2, 3")
def zoom_to_fit(spark, sf_dir):
    """Extent of each track, for a view that picks from them."""
    s = tables.spans(spark, sf_dir, "container", "container_id", "track", "start_ns", "end_ns")
    return s.groupBy("container", "container_id", "track").agg(F.min("start_ns").alias("lo"), F.max(F.coalesce("end_ns", "start_ns")).alias("hi"))


@query(f"WITH {_SPANS}, {_GOR} SELECT count(*) AS n, count(*) FILTER (WHERE g_id IN (SELECT container_id FROM s WHERE container = 'G' AND track = 'region')) AS with_regions, count(*) FILTER (WHERE g_id NOT IN (SELECT container_id FROM s WHERE container = 'G')) AS without_spans FROM gor")
def without_spans(spark, sf_dir):
    """Goroutines, those that have regions, and those that no span names."""
    g, s = tables.goroutines(spark, sf_dir).select("g_id"), tables.spans(spark, sf_dir, "container", "track", "container_id").where("container = 'G'")
    has = g.join(s.where("track = 'region'"), g.g_id == s.container_id, "left_semi").agg(F.count("*").alias("with_regions"))
    no = g.join(s, g.g_id == s.container_id, "left_anti").agg(F.count("*").alias("without_spans"))
    return g.agg(F.count("*").alias("n")).select("n", has.scalar().alias("with_regions"), no.scalar().alias("without_spans"))


# ------------------------------------------------------------ frames
_CLASS = "CASE WHEN package = 'runtime' THEN 'runtime' WHEN package = 'main' THEN 'main' WHEN NOT contains(split_part(package, '/', 1), '.') THEN 'stdlib' ELSE 'third-party' END"
_FRAMES = f"""fr0 AS (SELECT stack_id, unnest(funcs) AS func, generate_subscripts(funcs, 1) - 1 AS i FROM stacks), fr1 AS (SELECT *, regexp_extract(func, '^((?:.*/)?[^./]*)', 1) AS package FROM fr0),
fr AS (SELECT stack_id, i, stack_id % 50 * 1000 + i AS pc, func, CASE {_CLASS} WHEN 'runtime' THEN '/usr/lib/go/src/' || package || '/a.go' WHEN 'stdlib' THEN '/usr/lib/go/src/' || package || '/a.go' WHEN 'main' THEN '/work/app/main.go' ELSE '/home/u/pkg/mod/' || package || '@v1.2/b.go' END AS file, i + 10 AS line FROM fr1)"""
_DICT = f"{_FRAMES}, dict AS (SELECT pc, arg_max(func, stack_id) AS func, arg_max(file, stack_id) AS file, arg_max(line, stack_id) AS line FROM fr GROUP BY pc)"


@query(f"WITH {_DICT} SELECT * FROM dict")
def frame_dictionary(spark, sf_dir):
    """Counters with their frame; the last of several counts."""
    return frames.frame_dictionary(tables.frames(spark, sf_dir))


def _resolved(spark, sf_dir):
    f = tables.frames(spark, sf_dir)
    pcs = f.groupBy("stack_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pc"))), lambda x: x["pc"]).alias("pcs"))
    return frames.resolve(pcs, frames.frame_dictionary(f))


@query(
    f"""WITH {_DICT}, l AS (SELECT stack_id, list(dict.func || chr(10) || '        ' || dict.file || ':' || dict.line ORDER BY i) AS l FROM fr JOIN dict USING (pc) GROUP BY 1)
SELECT stack_id, CASE WHEN len(l) > 5 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '[' || (len(l) - 5) || ' frames hidden]' || chr(10) || array_to_string(l[-2:], chr(10)) ELSE array_to_string(l, chr(10)) END AS stack,
  array_to_string(l[1:1], chr(10)) || CASE WHEN len(l) > 2 THEN chr(10) || '[' || (len(l) - 2) || ' frames hidden]' ELSE '' END || CASE WHEN len(l) > 1 THEN chr(10) || l[-1] ELSE '' END AS shortest FROM l"""
)
def located_stacks(spark, sf_dir):
    """Stacks as text with files and lines, cut to five frames and to the fewest there can be."""
    return _resolved(spark, sf_dir).select("stack_id", frames.located_text(F.col("frames"), 5).alias("stack"), frames.located_text(F.col("frames"), 1).alias("shortest"))


_ROOTS = f"""{_FRAMES}, f AS (SELECT DISTINCT func, file FROM fr), gr AS (SELECT coalesce(min(regexp_extract(file, '^(.*)go/src/runtime', 1) || 'go'), '') AS goroot FROM f
  WHERE starts_with(func, 'runtime.') AND len(func) - len(replace(func, '.', '')) = 1 AND NOT contains(func, '/') AND contains(file, 'go/src/runtime')),
c0 AS (SELECT file, split_part(func, '/', 1) AS dir, split_part(substr(func, strpos(func, '/') + 1), '.', 1) AS pkg FROM f, gr WHERE goroot <> '' AND NOT starts_with(file, goroot) AND contains(func, '/')),
c1 AS (SELECT CASE WHEN contains(file, 'src/' || dir || '/' || pkg) THEN left(file, len(file) - len('src/' || dir || '/' || pkg) - len(string_split(file, 'src/' || dir || '/' || pkg)[-1])) WHEN contains(file, 'pkg/mod/' || dir) THEN left(file, len(file) - len('pkg/mod/' || dir) - len(string_split(file, 'pkg/mod/' || dir)[-1])) END AS prefix FROM c0),
gp AS (SELECT coalesce(arg_min(prefix, {{'a': -n, 'b': prefix}}), '') AS gopath FROM (SELECT prefix, count(*) AS n FROM c1 WHERE prefix IS NOT NULL GROUP BY 1))"""


def _roots(f):
    root = frames.go_root(f)
    return root, frames.go_path(f, root.scalar())


@query(f"WITH {_ROOTS} SELECT goroot, gopath FROM gr, gp")
def source_roots(spark, sf_dir):
    f = tables.frames(spark, sf_dir).select("func", "file").distinct()
    root, path = _roots(f)
    return root.select("goroot", path.scalar().alias("gopath"))


@query(f"WITH {_ROOTS} SELECT gopath AS prefix FROM gp")
def gopath_vote(spark, sf_dir):
    """The most frequent prefix of the files outside the language's own."""
    f = tables.frames(spark, sf_dir).select("func", "file").distinct()
    return _roots(f)[1].select(F.col("gopath").alias("prefix"))


@query(f"WITH {_ROOTS} SELECT DISTINCT file, CASE WHEN goroot <> '' AND starts_with(file, goroot) THEN '$GOROOT/' || ltrim(substr(file, len(goroot) + 1), '/') WHEN gopath <> '' AND starts_with(file, gopath) THEN '$GOPATH/' || ltrim(substr(file, len(gopath) + 1), '/') ELSE file END AS shown FROM f, gr, gp")
def display_paths(spark, sf_dir):
    f = tables.frames(spark, sf_dir).select("func", "file").distinct()
    root, path = _roots(f)
    one = f.select("file").distinct().select("file", root.scalar().alias("r"), path.scalar().alias("p"))
    return one.select("file", frames.display_path(F.col("file"), F.col("r"), F.col("p")).alias("shown"))
