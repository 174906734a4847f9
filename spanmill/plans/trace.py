"""Queries of the trace operators, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.states import state_key, with_state_code
from ..operators import bins, intervals, joins, stacks, stats
from ..schema import LEGAL_NEXT, OFF_CPU, PATTERNS, TAG_ORDER, TAGS, WAIT_STATES
from ..operators.sweep import balanced_prev
from ..session import Scratch, table
from ..sources import tables

QUERIES: dict = {}
ORACLE: dict = {}

MS100 = 100_000_000
HOUR = 3_600_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return s.replace("'", "''")


# ------------------------------------------------------------ shared SQL pieces
_SPANS = "s AS (SELECT DISTINCT span_id, container, container_id, track, depth, seq, start_ns, end_ns, start_event, end_event, at_frame, state, tags, kind FROM spans)"
_GOR = "gor AS (SELECT DISTINCT g_id, seq_id, parent, func, start_ns, end_ns, eff_start, eff_end FROM goroutines)"
_CODES = """nm AS (
  SELECT min(code) AS code, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS k FROM (SELECT code, unnest([ident, name, name_cap, label]) AS n FROM state_dim) WHERE n IS NOT NULL GROUP BY 2
)"""
_CODED = f"{_SPANS}, {_CODES}, c AS (SELECT s.*, nm.code FROM s LEFT JOIN nm ON regexp_replace(lower(s.state), '[^a-z0-9]', '', 'g') = nm.k)"
_MOVES = """m AS (
  SELECT event_id, ts, trans.res_id AS g, trans.from_state AS f, trans.to_state AS t, trans.reason AS reason, g AS by_g, p, trans.stack_id AS st
  FROM trace_events WHERE kind = 'StateTransition' AND trans.res_kind = 'Goroutine' AND trans.from_state IS DISTINCT FROM trans.to_state
), ext AS (SELECT arg_min(ts, event_id) AS t0, arg_max(ts, event_id) AS t1 FROM trace_events)"""
_WAIT = "CASE coalesce(reason, '') " + " ".join(f"WHEN '{_q(k)}' THEN '{_q(v)}'" for k, v in WAIT_STATES.items()) + " END"
_STATE = f"""CASE t WHEN 'Runnable' THEN CASE WHEN f = 'NotExist' THEN 'created' WHEN reason IN ('runtime.GoSched', 'runtime.Gosched') THEN 'inactive' ELSE 'ready' END
  WHEN 'Running' THEN 'active' WHEN 'Syscall' THEN 'blocked (syscall)' WHEN 'Waiting' THEN {_WAIT} END"""
_LOG = """lg AS (
  SELECT event_id, epoch_us(ts) * 1000 AS ts, user_id AS g, user_id % 8 AS p, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
)"""


def _coded(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return with_state_code(tables.spans(spark, sf_dir, "state", *columns), table(spark, sf_dir, "state_dim"))


def _named(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Spans of goroutines' state tracks with state as its one name."""
    dim = table(spark, sf_dir, "state_dim").select(F.col("code").alias("state_code"), "name")
    s = _coded(spark, sf_dir, "container", "track", *columns).where("container = 'G' and track = 'state'")
    return s.join(dim, "state_code", "left").withColumn("state", F.col("name")).drop("name", "state_code")


_NAMED = f"{_CODED}, n AS (SELECT c.* EXCLUDE (state), d.name AS state FROM c LEFT JOIN state_dim d ON c.code = d.code WHERE container = 'G' AND track = 'state')"


# ------------------------------------------------------------ event log to intervals
@query(
    f"""WITH {_MOVES}, l AS (SELECT *, lead(ts) OVER w AS nts, lead(event_id) OVER w AS ne FROM m WINDOW w AS (PARTITION BY g ORDER BY event_id))
SELECT g, CASE WHEN f = 'Undetermined' THEN t0 ELSE ts END AS start_ns, coalesce(nts, t1) AS end_ns, event_id AS start_event, ne AS end_event,
  {_STATE} AS state, coalesce(f = 'Undetermined', false) AS before_trace FROM l, ext WHERE t <> 'NotExist'"""
)
def spans_basic(spark, sf_dir):
    out = intervals.goroutine_spans(table(spark, sf_dir, "trace_events"))
    return out.withColumn("before_trace", F.coalesce("before_trace", F.lit(False)))


@query(
    f"""WITH {_MOVES}, c AS (SELECT *, CASE WHEN t = 'Running' THEN 'proc running' WHEN t IN ('Waiting', 'Syscall') THEN 'proc waiting for goroutine to unblock'
    WHEN t = 'NotExist' THEN 'proc running without goroutine' END AS state FROM m WHERE p IS NOT NULL),
l AS (SELECT *, lead(ts) OVER (PARTITION BY p ORDER BY event_id) AS nts FROM c WHERE state IS NOT NULL)
SELECT p, ts AS start_ns, coalesce(nts, t1) AS end_ns, event_id AS start_event, state FROM l, ext"""
)
def proc_spans(spark, sf_dir):
    return intervals.processor_spans(table(spark, sf_dir, "trace_events"))


@query(f"WITH {_MOVES} SELECT t0 AS trace_start, t1 AS trace_end, t1 - t0 AS duration_ns FROM ext")
def trace_extent(spark, sf_dir):
    return intervals.trace_extent(table(spark, sf_dir, "trace_events"))


@query(f"WITH {_MOVES} SELECT by_g AS g, event_id, CASE WHEN f = 'NotExist' THEN 'create' ELSE 'unblock' END AS class FROM m WHERE t = 'Runnable' AND by_g IS NOT NULL AND f IN ('NotExist', 'Waiting')")
def attached_events(spark, sf_dir):
    return intervals.attached_events(table(spark, sf_dir, "trace_events"))


@query(
    f"""WITH {_MOVES}, c AS (SELECT event_id, g, CASE WHEN t = 'Runnable' AND f = 'NotExist' THEN 'create' WHEN t = 'Runnable' AND f = 'Waiting' THEN 'unblock' WHEN t = 'Syscall' THEN 'syscall' END AS class FROM m)
SELECT * FROM c WHERE class IN ('create', 'syscall')"""
)
def event_filter(spark, sf_dir):
    m = intervals.goroutine_transitions(table(spark, sf_dir, "trace_events"))
    made = (F.col("to_state") == "Runnable") & (F.col("from_state") == "NotExist")
    woken = (F.col("to_state") == "Runnable") & (F.col("from_state") == "Waiting")
    cls = F.when(made, "create").when(woken, "unblock").when(F.col("to_state") == "Syscall", "syscall")
    return m.select("event_id", "g", cls.alias("class")).where(F.col("class").isin("create", "syscall"))


@query("SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN trans.from_state = trans.to_state THEN 1 ELSE 0 END), 0) AS BIGINT) AS restated FROM trace_events WHERE kind = 'StateTransition'")
def restated(spark, sf_dir):
    t = table(spark, sf_dir, "trace_events").where("kind = 'StateTransition'")
    return t.agg(F.count("*").alias("n"), F.count(F.when(F.col("trans.from_state") == F.col("trans.to_state"), 1)).alias("restated"))


@query(f"WITH {_MOVES}, f1 AS (SELECT g, arg_min(st, event_id) AS st FROM m WHERE st IS NOT NULL GROUP BY g) SELECT g, funcs[-1] AS func FROM f1 JOIN stacks ON f1.st = stacks.stack_id WHERE len(funcs) > 0")
def goroutine_functions(spark, sf_dir):
    return intervals.goroutine_functions(table(spark, sf_dir, "trace_events"), table(spark, sf_dir, "stacks"))


@query("SELECT g_id, row_number() OVER (ORDER BY g_id) - 1 AS seq_id FROM (SELECT DISTINCT g_id FROM goroutines)")
def dense_ids(spark, sf_dir):
    return intervals.dense_ids(table(spark, sf_dir, "goroutines"), "g_id")


@query(
    f"""WITH {_MOVES}, d AS (
  SELECT ts, CASE f WHEN 'Runnable' THEN 'runnable' WHEN 'Running' THEN 'running' WHEN 'Waiting' THEN 'waiting' WHEN 'Syscall' THEN 'waiting' END AS gauge, -1 AS d FROM m
  UNION ALL SELECT ts, CASE t WHEN 'Runnable' THEN 'runnable' WHEN 'Running' THEN 'running' WHEN 'Waiting' THEN 'waiting' WHEN 'Syscall' THEN 'waiting' END, 1 FROM m),
s AS (SELECT gauge, ts, sum(d) AS d FROM d WHERE gauge IS NOT NULL GROUP BY 1, 2)
SELECT '/sched/goroutines/' || gauge || ':goroutines' AS metric_name, ts, CAST(sum(d) OVER (PARTITION BY gauge ORDER BY ts) AS BIGINT) AS value FROM s"""
)
def gauge_running(spark, sf_dir):
    return intervals.gauges(table(spark, sf_dir, "trace_events"))


def _delta() -> Column:
    return F.when(F.col("kind").isin("signup", "click"), 1).when(F.col("kind").isin("purchase", "error"), -1).otherwise(0)


_DEPTH = f"""{_LOG}, d AS (SELECT g, event_id, ts, CASE WHEN kind IN ('signup', 'click') THEN 1 WHEN kind IN ('purchase', 'error') THEN -1 ELSE 0 END AS delta FROM lg),
r AS (SELECT *, sum(delta) OVER (PARTITION BY g ORDER BY event_id) AS run FROM d WHERE delta <> 0),
x AS (SELECT *, least(0, min(run) OVER (PARTITION BY g ORDER BY event_id)) AS low FROM r)"""


@query(f"WITH {_DEPTH} SELECT g, event_id, CAST(delta AS BIGINT) AS delta, CAST(run - low AS BIGINT) AS depth FROM x")
def region_depth(spark, sf_dir):
    return intervals.region_depths(tables.log(spark, sf_dir), _delta()).select("g", "event_id", "delta", "depth")


@query(
    f"""WITH {_DEPTH}, y AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY g ORDER BY event_id), 0) AS plow FROM x),
z AS (SELECT g, event_id, ts, delta, CAST(CASE WHEN delta > 0 THEN run - low - 1 ELSE run - low END AS BIGINT) AS depth FROM y WHERE NOT (delta < 0 AND low < plow)),
l AS (SELECT *, lead(event_id) OVER w AS ne, lead(ts) OVER w AS nts, lead(delta) OVER w AS nd FROM z WINDOW w AS (PARTITION BY g, depth ORDER BY event_id))
SELECT g, depth, event_id AS start_event, ts AS start_ns, CASE WHEN nd < 0 THEN ne END AS end_event, coalesce(nts, (SELECT max(ts) FROM lg)) AS end_ns FROM l WHERE delta > 0"""
)
def region_pairs(spark, sf_dir):
    return intervals.region_pairs(tables.log(spark, sf_dir), _delta())


@query(
    f"""WITH {_LOG}, r AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY event_id) AS grp FROM lg WHERE kind IN ('signup', 'error'))
SELECT g, min(event_id) AS start_event, min(ts) AS start_ns, max(CASE WHEN kind = 'error' THEN event_id END) AS end_event,
  coalesce(max(CASE WHEN kind = 'error' THEN ts END), (SELECT max(ts) FROM lg)) AS end_ns FROM r WHERE grp > 0 GROUP BY g, grp"""
)
def range_spans(spark, sf_dir):
    return intervals.range_spans(tables.log(spark, sf_dir), F.col("kind") == "signup", F.col("kind") == "error")


@query(
    f"""WITH {_LOG}, r AS (SELECT *, sum(CASE WHEN kind <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY event_id) AS grp FROM lg)
SELECT g, min(event_id) AS start_event, coalesce(arg_max(CASE WHEN kind = 'view' THEN 'view ' || (k // 50) END, event_id) FILTER (WHERE kind = 'view'), arg_min(kind, event_id)) AS state FROM r WHERE grp > 0 GROUP BY g, grp"""
)
def relabel(spark, sf_dir):
    log = tables.log(spark, sf_dir)
    label = F.when(F.col("kind") == "view", F.concat(F.lit("view "), F.expr("k div 50")))
    return intervals.relabelled(log, F.col("kind") != "view", label)


@query(
    """WITH l AS (SELECT l_orderkey AS task_id, count(*) AS n_regions, max(l_shipdate) AS last_end FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, task_id) AS task_id, o_custkey AS parent, o_orderpriority AS name, o_orderkey IS NULL AS stub, coalesce(n_regions, 0) AS n_regions,
  CASE WHEN o_orderkey IS NULL THEN NULL ELSE epoch_us(o_orderdate) * 1000 END AS start_ns, epoch_us(last_end) * 1000 AS end_ns
FROM orders FULL OUTER JOIN l ON o_orderkey = task_id"""
)
def task_table(spark, sf_dir):
    """Tasks with a begin, with only references (stubs), or with both."""
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ref")).agg(F.count("*").alias("n_regions"), F.max("l_shipdate").alias("last_end"))
    o = table(spark, sf_dir, "orders")
    return o.join(refs, F.col("o_orderkey") == F.col("ref"), "full_outer").select(
        F.coalesce("o_orderkey", "ref").alias("task_id"), F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").isNull().alias("stub"),
        F.coalesce("n_regions", F.lit(0)).alias("n_regions"), ns("o_orderdate").alias("start_ns"), ns("last_end").alias("end_ns"),
    )


@query("SELECT metric_name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT DISTINCT series_id, metric_name, ts, reading FROM metrics) GROUP BY 1")
def metric_series(spark, sf_dir):
    m = table(spark, sf_dir, "metrics").select("series_id", "metric_name", "ts", "reading").distinct()
    return m.groupBy("metric_name").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ------------------------------------------------------------ statistics
def _stat_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, count(*) AS cnt, min(end_ns - start_ns) AS min_ns, max(end_ns - start_ns) AS max_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_ns,
  round(avg(CAST(end_ns - start_ns AS DOUBLE)), 0) AS average_ns, median(end_ns - start_ns) AS median_ns FROM {source} WHERE end_ns >= start_ns GROUP BY {keys}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("average_ns", F.round("average_ns", 0))


@query(f"WITH {_NAMED} {_stat_sql('state', 'n')}")
def state_stats_all(spark, sf_dir):
    return _rounded(stats.compute_statistics(_named(spark, sf_dir, "start_ns", "end_ns"), ["state"]))


@query(f"WITH {_NAMED} {_stat_sql('container_id, state', 'n')}")
def state_stats_by_g(spark, sf_dir):
    return _rounded(stats.compute_statistics(_named(spark, sf_dir, "container_id", "start_ns", "end_ns"), ["container_id", "state"]))


@query(
    f"""WITH {_NAMED}, z AS (SELECT state, max(CASE WHEN end_ns = start_ns THEN span_id END) AS z FROM n WHERE end_ns >= start_ns GROUP BY 1)
SELECT n.state, coalesce(min(CASE WHEN z IS NULL OR span_id > z THEN end_ns - start_ns END), 0) AS compat_min_ns FROM n JOIN z ON n.state IS NOT DISTINCT FROM z.state WHERE end_ns >= start_ns GROUP BY 1"""
)
def compat_min(spark, sf_dir):
    return stats.min_after_zero(_named(spark, sf_dir, "start_ns", "end_ns"), ["state"], "span_id")


_ROLL = ", ".join(f"CAST(coalesce(sum(CASE WHEN d.{c} AND end_ns >= start_ns THEN end_ns - start_ns END), 0) AS BIGINT) AS {c}_ns" for c in ("blocked", "running", "inactive", "gc_assist"))


@query(f"WITH {_CODED} SELECT container_id, {_ROLL} FROM c LEFT JOIN state_dim d ON c.code = d.code WHERE container = 'G' AND track = 'state' GROUP BY 1")
def rollups(spark, sf_dir):
    dim = table(spark, sf_dir, "state_dim").withColumnRenamed("code", "state_code").drop("name", "label")
    s = _coded(spark, sf_dir, "container", "track", "container_id", "start_ns", "end_ns").where("container = 'G' and track = 'state'")
    return s.join(dim, "state_code", "left").groupBy("container_id").agg(*stats.roll_ups())


@query(
    f"""WITH {_CODED}, {_GOR}, r AS (SELECT container_id, count(*) AS n_spans, {_ROLL} FROM c LEFT JOIN state_dim d ON c.code = d.code WHERE container = 'G' AND track = 'state' GROUP BY 1)
SELECT g_id, eff_end - eff_start AS lifetime_ns, coalesce(n_spans, 0) AS n_spans, coalesce(blocked_ns, 0) AS blocked_ns, coalesce(running_ns, 0) AS running_ns,
  round(100.0 * running_ns / nullif(eff_end - eff_start, 0), 6) AS running_pct FROM gor LEFT JOIN r ON g_id = container_id"""
)
def goroutine_summary(spark, sf_dir):
    dim = table(spark, sf_dir, "state_dim").withColumnRenamed("code", "state_code").drop("name", "label")
    s = _coded(spark, sf_dir, "container", "track", "container_id", "start_ns", "end_ns").where("container = 'G' and track = 'state'")
    r = s.join(dim, "state_code", "left").groupBy("container_id").agg(F.count("*").alias("n_spans"), *stats.roll_ups())
    g = tables.goroutines(spark, sf_dir)
    life = F.col("eff_end") - F.col("eff_start")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.join(r, g.g_id == r.container_id, "left").select(
        "g_id", life.alias("lifetime_ns"), zero("n_spans"), zero("blocked_ns"), zero("running_ns"), F.round(F.try_divide(100.0 * F.col("running_ns"), life), 6).alias("running_pct")
    )


@query(f"WITH {_GOR} SELECT func, count(*) AS n_goroutines, CAST(sum(eff_end - eff_start) AS BIGINT) AS total_ns FROM gor GROUP BY func")
def function_totals(spark, sf_dir):
    g = tables.goroutines(spark, sf_dir)
    return g.groupBy("func").agg(F.count("*").alias("n_goroutines"), F.sum(F.col("eff_end") - F.col("eff_start")).alias("total_ns"))


@query(
    f"""WITH {_NAMED} SELECT container_id, count(*) AS n_spans, CAST(sum(CASE WHEN end_ns >= start_ns THEN end_ns - start_ns END) AS BIGINT) AS total_ns, min(start_ns) AS first_start,
  max_by(end_ns, {{'a': start_ns, 'b': span_id}}) AS last_end, CASE WHEN min(state) = max(state) THEN min(state) ELSE 'mixed' END AS state FROM n WHERE end_ns IS NOT NULL GROUP BY 1"""
)
def set_summary(spark, sf_dir):
    return stats.set_summary(_named(spark, sf_dir, "container_id", "start_ns", "end_ns").where("end_ns is not null"), ["container_id"])


@query(f"WITH {_SPANS} SELECT container, container_id, track, count(*) AS n_spans, min(start_ns) AS first_start, max(end_ns) AS last_end, max(end_ns) - min(start_ns) AS alive_ns, bool_and(end_ns IS NOT NULL) AS ended FROM s GROUP BY 1, 2, 3")
def timeline_summary(spark, sf_dir):
    s = tables.spans(spark, sf_dir, "container", "container_id", "track", "start_ns", "end_ns")
    return s.groupBy("container", "container_id", "track").agg(
        F.count("*").alias("n_spans"), F.min("start_ns").alias("first_start"), F.max("end_ns").alias("last_end"), (F.max("end_ns") - F.min("start_ns")).alias("alive_ns"), F.bool_and(F.col("end_ns").isNotNull()).alias("ended")
    )


@query(f"WITH {_NAMED} SELECT container_id, count(*) AS n, bool_or(coalesce(state IN ('stuck', 'blocked (select)'), false)) AS hit FROM n GROUP BY 1 HAVING hit")
def highlight(spark, sf_dir):
    s = _named(spark, sf_dir, "container_id")
    hit = F.bool_or(F.coalesce(F.col("state").isin("stuck", "blocked (select)"), F.lit(False)))
    return s.groupBy("container_id").agg(F.count("*").alias("n"), hit.alias("hit")).where("hit")


@query(
    "WITH legal(a, b) AS (VALUES " + ", ".join(f"('{_q(a)}', '{_q(b)}')" for a, bs in LEGAL_NEXT.items() for b in bs) + f""")
, {_NAMED}, l AS (SELECT lag(state) OVER (PARTITION BY container_id ORDER BY seq) AS a, state AS b FROM n)
SELECT l.a AS from_state, l.b AS to_state, count(*) AS n FROM l LEFT JOIN legal ON l.a = legal.a AND l.b = legal.b WHERE l.a IS NOT NULL AND l.b IS NOT NULL AND l.a <> l.b AND legal.a IS NULL GROUP BY 1, 2"""
)
def legal_transitions(spark, sf_dir):
    """Changes of state that the matrix does not allow, with their counts."""
    s = _named(spark, sf_dir, "container_id", "seq").select("container_id", "seq", "state")
    pairs = balanced_prev(s, ["container_id"], ["seq"], ["state"], Scratch(spark, "legal"))
    counted = pairs.where("prev_state <> state").groupBy(F.col("prev_state").alias("from_state"), F.col("state").alias("to_state")).agg(F.count("*").alias("n"))
    allowed = F.create_map(*[x for a, bs in LEGAL_NEXT.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    return counted.where(~F.coalesce(F.array_contains(allowed[F.col("from_state")], F.col("to_state")), F.lit(False)))


# ------------------------------------------------------------ buckets
_BUSY = f"""{_SPANS}, e AS (SELECT container_id, start_ns, end_ns, unnest(range(start_ns // {HOUR}, (end_ns - 1) // {HOUR} + 1)) AS bucket FROM s WHERE container = 'P' AND end_ns > start_ns),
busy AS (SELECT container_id, bucket, CAST(sum(least(end_ns, (bucket + 1) * {HOUR}) - greatest(start_ns, bucket * {HOUR})) AS BIGINT) AS busy_ns FROM e GROUP BY 1, 2),
pct AS (SELECT *, CAST(round(busy_ns * 100 / {HOUR}.0) AS BIGINT) AS pct FROM busy)"""


def _busy(spark, sf_dir):
    p = tables.spans(spark, sf_dir, "container", "container_id", "start_ns", "end_ns").where("container = 'P'")
    return bins.processor_busy(p, "container_id", HOUR)


@query(f"WITH {_BUSY} SELECT * FROM pct")
def proc_busy(spark, sf_dir):
    return _busy(spark, sf_dir)


_HEAT = f"{_BUSY}, heat AS (SELECT bucket AS x, least(pct // 10, 9) AS y, count(*) AS n FROM pct GROUP BY 1, 2)"


@query(f"WITH {_HEAT} SELECT * FROM heat")
def heatmap(spark, sf_dir):
    return stats.heat(_busy(spark, sf_dir), 10)


@query(
    f"""WITH {_SPANS}, e AS (SELECT state, start_ns, end_ns, unnest(range(start_ns // {HOUR}, (end_ns - 1) // {HOUR} + 1)) AS bucket FROM s WHERE container = 'P' AND end_ns > start_ns)
SELECT bucket, state, round(sum(least(end_ns, (bucket + 1) * {HOUR}) - greatest(start_ns, bucket * {HOUR})) / {HOUR}.0, 9) AS fraction FROM e GROUP BY 1, 2"""
)
def pixel_mix(spark, sf_dir):
    p = tables.spans(spark, sf_dir, "container", "state", "start_ns", "end_ns").where("container = 'P'")
    return bins.state_mix(p, [], HOUR).withColumn("fraction", F.round("fraction", 9))


@query(
    f"""WITH {_SPANS}, e AS (SELECT container_id, state, start_ns, end_ns, unnest(range(start_ns // {HOUR}, (end_ns - 1) // {HOUR} + 1)) AS bucket FROM s WHERE container = 'P' AND end_ns > start_ns),
f AS (SELECT container_id, bucket, state, sum(least(end_ns, (bucket + 1) * {HOUR}) - greatest(start_ns, bucket * {HOUR})) AS c FROM e GROUP BY 1, 2, 3)
SELECT container_id, level, bucket >> level AS tile, state, CAST(sum(c) AS BIGINT) AS covered_ns FROM f, (SELECT unnest([0, 1, 2, 3]) AS level) GROUP BY 1, 2, 3, 4"""
)
def level_pyramid(spark, sf_dir):
    p = tables.spans(spark, sf_dir, "container", "container_id", "state", "start_ns", "end_ns").where("container = 'P'")
    return bins.pyramid(p, ["container_id"], HOUR, 4)


_D = "d AS (SELECT span_id, end_ns - start_ns AS v FROM n WHERE end_ns >= start_ns)"


def _durations(spark, sf_dir):
    return _named(spark, sf_dir, "start_ns", "end_ns").where("end_ns >= start_ns").select("span_id", stats.duration().alias("v"))


@query(
    f"""WITH {_NAMED}, {_D}, w AS (SELECT CASE WHEN max(v) = 0 THEN 1.0 ELSE CAST(max(v) AS DOUBLE) / 100 END AS w FROM d)
SELECT CAST(least(floor(v / w), 99) AS BIGINT) AS bin, round(least(floor(v / w), 99) * w, 0) AS lo, round((least(floor(v / w), 99) + 1) * w, 0) AS hi, count(*) AS n FROM d, w GROUP BY 1, 2, 3"""
)
def hist_plain(spark, sf_dir):
    h = bins.histogram(_durations(spark, sf_dir), "v")
    return h.select("bin", F.round("lo", 0).alias("lo"), F.round("hi", 0).alias("hi"), "n")


@query(
    f"""WITH {_NAMED}, {_D}, r AS (SELECT v, row_number() OVER (ORDER BY v, span_id) AS i, count(*) OVER () AS n FROM d),
q AS (SELECT avg(CASE WHEN i = (n // 2 + 1) // 2 OR i = (n // 2 + 2) // 2 THEN v END) AS q1, avg(CASE WHEN i = n - n // 2 + (n // 2 + 1) // 2 OR i = n - n // 2 + (n // 2 + 2) // 2 THEN v END) AS q3 FROM r),
cut AS (SELECT q3 + 2.5 * (q3 - q1) AS c FROM q), w AS (SELECT CAST(max(v) AS DOUBLE) / 100 AS w, c FROM d, cut WHERE v < c GROUP BY c)
SELECT CASE WHEN v >= c THEN 100 ELSE CAST(least(floor(v / w), 99) AS BIGINT) END AS bin, count(*) AS n FROM d, w GROUP BY 1"""
)
def hist_outlier(spark, sf_dir):
    d = Scratch(spark, "durations").put(_durations(spark, sf_dir))
    return bins.histogram(d, "v", cutoff=bins.outlier_cutoff(d, "v", "span_id")).select("bin", "n")


@query(
    f"""WITH {_NAMED}, {_D} SELECT CAST(least(floor((v - 1000) / 9990.0), 99) AS BIGINT) AS bin, count(*) AS n FROM d WHERE v >= 1000 AND v <= 1000000 GROUP BY 1"""
)
def hist_drill(spark, sf_dir):
    """The durations of one dragged range as a histogram of their own."""
    return bins.histogram(_durations(spark, sf_dir), "v", start=1000, end=1_000_000).select("bin", "n")


_M = "m AS (SELECT series_id, ts, max(reading) AS value FROM metrics WHERE reading IS NOT NULL GROUP BY 1, 2)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "metrics").where("reading is not null").groupBy("series_id", "ts").agg(F.max("reading").alias("value"))


@query(
    f"""WITH {_M}, b AS (SELECT *, ts // 60000000000 AS bin FROM m), a AS (SELECT series_id, bin, min(ts) AS a, max(ts) AS d, min({{'v': value, 't': ts}}).t AS lo, -max({{'v': value, 't': -ts}}).t AS hi FROM b GROUP BY 1, 2)
SELECT DISTINCT b.series_id, b.bin, b.ts, b.value FROM b JOIN a ON a.series_id = b.series_id AND a.bin = b.bin AND b.ts IN (a, d, lo, hi)"""
)
def m4_downsample(spark, sf_dir):
    return bins.m4(_points(spark, sf_dir), ["series_id"], "ts", "value", 0, 60_000_000_000)


@query(
    f"""WITH {_M}, l AS (SELECT *, lag(ts) OVER w AS pt, lag(CAST(value AS DOUBLE)) OVER w AS pv, lead(ts) OVER w AS nt, lead(CAST(value AS DOUBLE)) OVER w AS nv FROM m WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, CAST(value AS DOUBLE) AS value FROM l WHERE pt IS NULL OR nt IS NULL OR abs((ts - pt) * (nv - pv) - (nt - pt) * (value - pv)) / 2 > 1e12"""
)
def area_filter(spark, sf_dir):
    """Points tested against their neighbours in the input; area_filter_kept tests against the last kept one."""
    return bins.decimate_area_by_neighbours(_points(spark, sf_dir), ["series_id"], "ts", "value", 1e12)


@query()
def area_filter_kept(spark, sf_dir):
    """Points that matter for the curve, each tested against the last one kept."""
    return bins.decimate_area(_points(spark, sf_dir), ["series_id"], "ts", "value", 1e12)


@query(
    f"""WITH {_M}, x AS (SELECT series_id, min(ts) + (max(ts) - min(ts)) // 4 AS a, min(ts) + (max(ts) - min(ts)) // 2 AS b FROM m GROUP BY 1),
p AS (SELECT m.series_id, max(CASE WHEN ts < a THEN ts END) AS p FROM m JOIN x USING (series_id) GROUP BY 1)
SELECT m.series_id, min(value) AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 1 ELSE max(value) END AS hi FROM m JOIN x USING (series_id) JOIN p USING (series_id) WHERE ts < b AND ts >= coalesce(p, a) GROUP BY 1"""
)
def extents(spark, sf_dir):
    """Lowest and highest value of the second quarter of each series and the point before it."""
    m = _points(spark, sf_dir)
    x = m.groupBy("series_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).selectExpr("series_id", "t0 + (t1 - t0) div 4 as a", "t0 + (t1 - t0) div 2 as b")
    p = m.join(x, "series_id").groupBy("series_id", "a", "b").agg(F.max(F.when(F.col("ts") < F.col("a"), F.col("ts"))).alias("p"))
    inside = m.join(p, "series_id").where("ts < b and ts >= coalesce(p, a)")
    return inside.groupBy("series_id").agg(F.min("value").alias("lo"), F.when(F.min("value") == F.max("value"), F.max("value") + 1).otherwise(F.max("value")).alias("hi"))


@query(
    f"""WITH {_SPANS}, p AS (SELECT container_id, span_id, start_ns, end_ns, lag(start_ns) OVER w AS ps, lag(end_ns) OVER w AS pe FROM s WHERE container = 'P' AND end_ns >= start_ns WINDOW w AS (PARTITION BY container_id ORDER BY start_ns, span_id)),
r AS (SELECT *, sum(CASE WHEN pe IS NULL OR end_ns - start_ns >= 1000000 OR start_ns - pe >= 1000000 OR pe - ps >= 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY container_id ORDER BY start_ns, span_id) AS run FROM p)
SELECT container_id, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n FROM r GROUP BY container_id, run"""
)
def tiny_merge(spark, sf_dir):
    p = tables.spans(spark, sf_dir, "container", "container_id", "start_ns", "end_ns").where("container = 'P'")
    return bins.merge_tiny(p, ["container_id"], 1_000_000)


@query(
    f"""WITH {_NAMED}, p AS (SELECT container_id, span_id, start_ns, end_ns, state, lag(end_ns) OVER w AS pe, lag(state) OVER w AS pst FROM n WHERE end_ns >= start_ns WINDOW w AS (PARTITION BY container_id ORDER BY start_ns, span_id)),
r AS (SELECT *, sum(CASE WHEN pe = start_ns AND pst IS NOT DISTINCT FROM state THEN 0 ELSE 1 END) OVER (PARTITION BY container_id ORDER BY start_ns, span_id) AS run FROM p)
SELECT container_id, min(state) AS state, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n FROM r GROUP BY container_id, run"""
)
def stack_islands(spark, sf_dir):
    """State spans that touch and agree in state, without stacks; see stack_tracks for those."""
    s = _named(spark, sf_dir, "container_id", "start_ns", "end_ns").where("end_ns >= start_ns")
    return bins.contiguous_runs(s, ["container_id"], ["start_ns", "span_id"], "start_ns", "end_ns", ["state"])


@query(
    f"""WITH {_MOVES}, l AS (SELECT m.g, ts, unnest(funcs) AS func, generate_subscripts(funcs, 1) AS i, len(funcs) AS n FROM m JOIN stacks ON m.st = stacks.stack_id)
SELECT g, n - i AS level, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT func) AS n_funcs FROM l WHERE i <= 64 GROUP BY 1, 2"""
)
def stack_extents(spark, sf_dir):
    """Per goroutine and level from the outermost frame: extent and number of functions; innermost 64 frames."""
    m = intervals.goroutine_transitions(table(spark, sf_dir, "trace_events")).where("stack_id is not null")
    j = m.join(table(spark, sf_dir, "stacks"), "stack_id").select("g", "ts", F.size("funcs").alias("n"), F.posexplode(F.slice("funcs", 1, 64)).alias("i", "func"))
    return j.groupBy("g", (F.col("n") - F.col("i") - 1).cast("bigint").alias("level")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("func").alias("n_funcs"))


@query(
    f"""WITH {_MOVES}, sp AS (SELECT * FROM (SELECT m.*, coalesce(lead(ts) OVER (PARTITION BY g ORDER BY event_id), t1) AS e, t1 FROM m, ext) WHERE t <> 'NotExist'),
en AS (SELECT g, event_id, ts, e, st, 'stack' AS state, t = 'Running' OR (f = 'Waiting' AND t = 'Runnable') AS hidden FROM sp
  UNION ALL SELECT g, event_id, ts, NULL, stack_id, 'CPU sample', false FROM trace_events WHERE kind = 'StackSample' AND g IS NOT NULL),
nx AS (SELECT *, lead(ts) OVER (PARTITION BY g ORDER BY event_id) AS nts FROM en), ls AS (SELECT g, arg_max(e, event_id) AS le FROM sp GROUP BY 1),
bg AS (SELECT g FROM (SELECT g, arg_min(st, event_id) AS st FROM m WHERE st IS NOT NULL GROUP BY 1) x JOIN stacks ON x.st = stacks.stack_id WHERE funcs[-1] = 'runtime.bgsweep'),
a AS (SELECT nx.g, event_id, ts, coalesce(e, nts, le, t1) AS e, state, CASE WHEN state = 'CPU sample' AND funcs[-1] = 'runtime.goexit' THEN funcs[:-2] ELSE funcs END AS funcs
  FROM nx JOIN stacks ON nx.st = stacks.stack_id LEFT JOIN ls ON ls.g = nx.g, ext WHERE NOT hidden AND nx.g NOT IN (SELECT g FROM bg)),
b AS (SELECT g, event_id, ts, e, state, (CASE WHEN state = 'CPU sample' AND funcs[-1] = 'runtime.main' THEN funcs[:-2] ELSE funcs END)[1:64] AS funcs FROM a),
l AS (SELECT g, event_id, ts, e, state, unnest(funcs) AS func, len(funcs) - generate_subscripts(funcs, 1) AS level FROM b),
p AS (SELECT *, lag(e) OVER w AS pe, lag(func) OVER w AS pf, lag(state) OVER w AS ps FROM l WINDOW w AS (PARTITION BY g, level ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN pe = ts AND pf = func AND ps = state THEN 0 ELSE 1 END) OVER (PARTITION BY g, level ORDER BY event_id) AS run FROM p)
SELECT g, level, min(func) AS func, min(state) AS state, min(ts) AS start_ns, max(e) AS end_ns, CASE WHEN min(state) = 'CPU sample' THEN count(*) ELSE 0 END AS n_samples FROM r GROUP BY g, level, run"""
)
def stack_tracks(spark, sf_dir):
    """Per goroutine and level: runs of the same frame, from spans and samples."""
    return stacks.stack_tracks(table(spark, sf_dir, "trace_events"), table(spark, sf_dir, "stacks"))


# ------------------------------------------------------------ stacks
_PAT_CASES = []
for _of, _abs, _any, _to, _at, _tag in PATTERNS:
    _c = [f"state = '{_q(_of)}'", "funcs IS NOT NULL"]
    _c += [f"len(funcs) > {i}" if f == "" else f"len(funcs) > {i} AND funcs[{i + 1}] = '{_q(f)}'" for i, f in enumerate(_abs)]
    _c += [f"list_contains(funcs, '{_q(f)}')" for f in _any] + ([f"len(funcs) > {_at}"] if _at else [])
    _PAT_CASES.append((" AND ".join(_c), _to, _at, _tag))
_PAT_STATE = "CASE " + " ".join(f"WHEN {c} THEN '{_q(t)}'" for c, t, _, _ in reversed(_PAT_CASES) if t) + " ELSE state END"
_PAT_AT = "CASE " + " ".join(f"WHEN {c} THEN {a}" for c, _, a, _ in reversed(_PAT_CASES) if a) + " ELSE 0 END"
_PAT_TAGS = " | ".join("CASE WHEN " + " OR ".join(f"({c})" for c, _, _, t in _PAT_CASES if t == tag) + f" THEN {TAGS[tag]} ELSE 0 END" for tag in ("read", "network", "accept", "TCP", "dial", "TLS", "HTTP"))
_TAG_TEXT = "list_filter([" + ", ".join(f"CASE WHEN (tags & {TAGS[t]}) <> 0 THEN '{t}' END" for t in TAG_ORDER) + "], lambda x: x IS NOT NULL)"


@query(
    f"""WITH {_MOVES}, b AS (SELECT event_id, {_STATE} AS state, funcs FROM m LEFT JOIN stacks ON m.st = stacks.stack_id WHERE t <> 'NotExist'),
a AS (SELECT event_id, funcs, {_PAT_STATE} AS new_state, {_PAT_AT} AS a0, {_PAT_TAGS} AS tags FROM b)
SELECT event_id, new_state, CAST(CASE WHEN funcs IS NULL OR len(funcs) = 0 THEN a0 ELSE coalesce(list_min(list_filter(range(a0, len(funcs)), lambda i: NOT starts_with(funcs[i + 1], 'runtime.'))), len(funcs) - 1) END AS INTEGER) AS at_frame,
  CAST(tags AS INTEGER) AS tags, array_to_string({_TAG_TEXT}, ', ') AS tag_names FROM a"""
)
def pattern_tags(spark, sf_dir):
    m = intervals.goroutine_transitions(table(spark, sf_dir, "trace_events")).where("to_state <> 'NotExist'")
    s = m.select("event_id", "stack_id", intervals.transition_state(F.col("from_state"), F.col("to_state"), F.col("reason")).alias("state"))
    p = stacks.apply_patterns(s.join(table(spark, sf_dir, "stacks"), "stack_id", "left"))
    return p.select("event_id", "new_state", stacks.skip_runtime(F.col("new_at")).cast("int").alias("at_frame"), F.col("new_tags").alias("tags"), stacks.tag_names(F.col("new_tags")).alias("tag_names"))


_FLAME = f"""{_MOVES}, b AS (SELECT {_STATE} AS state, st, count(*) AS w FROM m WHERE st IS NOT NULL AND t <> 'NotExist' GROUP BY 1, 2),
p AS (SELECT list_prepend(state, list_reverse(funcs)) AS path, w FROM b JOIN stacks ON b.st = stacks.stack_id WHERE state IS NOT NULL),
f AS (SELECT path[1:d] AS path, d AS depth, w FROM (SELECT path, w, unnest(range(1, len(path) + 1)) AS d FROM p)),
tree AS (SELECT path, depth, CAST(sum(w) AS BIGINT) AS duration FROM f GROUP BY 1, 2)"""


def _flame(spark, sf_dir):
    m = intervals.goroutine_transitions(table(spark, sf_dir, "trace_events")).where("stack_id is not null and to_state <> 'NotExist'")
    s = m.select("stack_id", intervals.transition_state(F.col("from_state"), F.col("to_state"), F.col("reason")).alias("state"))
    n = s.where("state is not null").groupBy("stack_id", "state").agg(F.count("*").alias("w"))
    return stacks.flame(n.join(table(spark, sf_dir, "stacks"), "stack_id"), F.col("state"), F.col("w"))


@query(f"WITH {_FLAME} SELECT array_to_string(path, ';') AS path, CAST(depth AS BIGINT) AS depth, duration FROM tree")
def flame_prefix(spark, sf_dir):
    """Transitions counted by path; flame_prefix_time has their time."""
    return _flame(spark, sf_dir).select(F.array_join("path", ";").alias("path"), F.col("depth").cast("bigint").alias("depth"), "duration")


@query(
    f"""WITH {_FLAME}, k AS (SELECT path[1:depth - 1] AS path, CAST(sum(duration) AS BIGINT) AS below, count(*) AS nc FROM tree WHERE depth > 1 GROUP BY 1)
SELECT array_to_string(t.path, ';') AS path, t.duration - coalesce(below, 0) AS self, coalesce(nc, 0) AS n_children, round(t.duration * 100 / u.duration, 6) AS pct_parent
FROM tree t LEFT JOIN k ON t.path = k.path LEFT JOIN tree u ON t.depth > 1 AND u.path = t.path[1:t.depth - 1]"""
)
def flame_self(spark, sf_dir):
    # counts are never negative: what is left of one fits where it does
    return stacks.flame_metrics(_flame(spark, sf_dir)).select(F.array_join("path", ";").alias("path"), F.col("self").cast("bigint").alias("self"), "n_children", F.round("pct_parent", 6).alias("pct_parent"))


_ROOT = "CASE new_state " + " ".join(f"WHEN '{_q(k)}' THEN '{_q(v)}'" for k, v in OFF_CPU.items()) + " END"
_FLAME_TIME = f"""{_MOVES}, sp AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY g ORDER BY event_id), t1) - CASE WHEN f = 'Undetermined' THEN t0 ELSE ts END AS d FROM m, ext),
b AS (SELECT {_STATE} AS state, d, funcs FROM sp JOIN stacks ON sp.st = stacks.stack_id WHERE t <> 'NotExist'), a AS (SELECT {_PAT_STATE} AS new_state, d, funcs FROM b),
pr AS (SELECT coalesce(lead(ts) OVER (PARTITION BY p ORDER BY event_id), t1) - ts AS d FROM m, ext WHERE p IS NOT NULL AND t IN ('Running', 'Waiting', 'Syscall', 'NotExist')),
sm AS (SELECT funcs FROM trace_events e JOIN stacks ON e.stack_id = stacks.stack_id WHERE kind = 'StackSample' AND g IS NOT NULL),
w AS (SELECT CAST(round((SELECT sum(d) FROM pr) / nullif(count(*), 0)) AS BIGINT) AS w FROM trace_events WHERE kind = 'StackSample'),
p AS (SELECT list_prepend(root, list_reverse(funcs)) AS path, sum(d) AS w FROM (SELECT {_ROOT} AS root, funcs, d FROM a UNION ALL SELECT 'Running', funcs, w FROM sm, w) WHERE root IS NOT NULL AND len(funcs) > 0 GROUP BY 1),
f AS (SELECT path[1:d] AS path, d AS depth, w FROM (SELECT path, w, unnest(range(1, len(path) + 1)) AS d FROM p)),
tree AS (SELECT path, depth, CAST(sum(w) AS BIGINT) AS duration FROM f GROUP BY 1, 2)"""


def _flame_time(spark, sf_dir):
    events, stack_table = table(spark, sf_dir, "trace_events"), table(spark, sf_dir, "stacks")
    on, off = stacks.on_cpu(events).where("g is not null"), stacks.off_cpu(events, stack_table)
    return stacks.weighted_flame(on.select("stack_id", "root", "w").unionByName(off.select("stack_id", "root", "w")), stack_table)


@query(f"WITH {_FLAME_TIME} SELECT array_to_string(path, ';') AS path, CAST(depth AS BIGINT) AS depth, duration FROM tree")
def flame_prefix_time(spark, sf_dir):
    """Time of all goroutines by path: samples under 'Running', blocked spans under their root."""
    return _flame_time(spark, sf_dir).select(F.array_join("path", ";").alias("path"), F.col("depth").cast("bigint").alias("depth"), "duration")


@query(
    f"""WITH {_FLAME_TIME}, k AS (SELECT path[1:depth - 1] AS path, CAST(sum(duration) AS BIGINT) AS below, count(*) AS nc FROM tree WHERE depth > 1 GROUP BY 1)
SELECT array_to_string(t.path, ';') AS path, t.duration - coalesce(below, 0) AS self, coalesce(nc, 0) AS n_children, round(CAST(t.duration AS DOUBLE) * 100 / nullif(u.duration, 0), 6) AS pct_parent
FROM tree t LEFT JOIN k ON t.path = k.path LEFT JOIN tree u ON t.depth > 1 AND u.path = t.path[1:t.depth - 1]"""
)
def flame_self_time(spark, sf_dir):
    return stacks.narrowed(stacks.flame_metrics(_flame_time(spark, sf_dir)), "self", "flame-self").select(F.array_join("path", ";").alias("path"), "self", "n_children", F.round("pct_parent", 6).alias("pct_parent"))


@query(
    """SELECT stack_id, CASE WHEN len(funcs) > 4 THEN array_to_string(funcs[1:2], chr(10)) || chr(10) || '[' || (len(funcs) - 4) || ' frames hidden]' || chr(10) || array_to_string(funcs[-2:], chr(10)) ELSE array_to_string(funcs, chr(10)) END AS stack FROM stacks"""
)
def stack_text(spark, sf_dir):
    return table(spark, sf_dir, "stacks").select("stack_id", stacks.stack_text(F.col("funcs"), 4).alias("stack"))


@query("SELECT DISTINCT func, regexp_extract(func, '^((?:.*/)?[^./]*)', 1) AS package, regexp_extract(func, '[^.]*$', 0) AS short FROM (SELECT unnest(funcs) AS func FROM stacks)")
def frames(spark, sf_dir):
    """The dictionary of functions of all stacks, with package and short name."""
    f = table(spark, sf_dir, "stacks").select(F.explode("funcs").alias("func")).distinct()
    return f.select("func", text.package_of(F.col("func")).alias("package"), text.short_function(F.col("func")).alias("short"))


# ------------------------------------------------------------ joins
@query(
    f"""WITH {_SPANS} SELECT s.container_id, s.span_id, e.event_id FROM s JOIN trace_events e ON e.g = s.container_id AND e.ts >= s.start_ns AND e.ts < s.end_ns WHERE s.container = 'G' AND s.track = 'region'"""
)
def events_in_spans(spark, sf_dir):
    s = tables.spans(spark, sf_dir, "container", "track", "container_id", "start_ns", "end_ns").where("container = 'G' and track = 'region'")
    e = table(spark, sf_dir, "trace_events").where("g is not null").select(F.col("g").alias("container_id"), "event_id", "ts")
    return joins.events_in_spans(s, e, "container_id", MS100)


@query(f"WITH {_NAMED} SELECT span_id, container_id, e.g AS unblocked_by FROM n JOIN trace_events e ON n.end_event = e.event_id WHERE n.state LIKE 'blocked%' AND n.state <> 'blocked (syscall)' AND e.g IS NOT NULL")
def unblocked_by(spark, sf_dir):
    s = _named(spark, sf_dir, "container_id", "end_event").where("state like 'blocked%' and state <> 'blocked (syscall)' and end_event is not null")
    e = table(spark, sf_dir, "trace_events").where("g is not null").select(F.col("event_id").alias("end_event"), F.col("g").alias("unblocked_by"))
    return s.join(e, "end_event").select("span_id", "container_id", "unblocked_by")


@query(f"WITH {_NAMED} SELECT span_id, container_id, e.p AS processor FROM n LEFT JOIN trace_events e ON n.start_event = e.event_id WHERE n.state = 'active'")
def running_on(spark, sf_dir):
    s = _named(spark, sf_dir, "container_id", "start_event").where("state = 'active'")
    e = table(spark, sf_dir, "trace_events").select(F.col("event_id").alias("start_event"), F.col("p").alias("processor"))
    return s.join(e, "start_event", "left").select("span_id", "container_id", "processor")


@query(f"WITH {_SPANS} SELECT span_id, container_id AS processor, e.trans.res_id AS g_id FROM s LEFT JOIN trace_events e ON s.start_event = e.event_id WHERE s.container = 'P'")
def proc_goroutine(spark, sf_dir):
    s = tables.spans(spark, sf_dir, "container", "container_id", "start_event").where("container = 'P'")
    e = table(spark, sf_dir, "trace_events").select(F.col("event_id").alias("start_event"), F.col("trans.res_id").alias("g_id"))
    return s.join(e, "start_event", "left").select("span_id", F.col("container_id").alias("processor"), "g_id")


@query(f"WITH {_GOR} SELECT a.g_id, b.g_id AS parent_id, b.func AS parent_func FROM gor a LEFT JOIN gor b ON a.parent = b.g_id AND a.parent NOT IN (0, -1)")
def parent_function(spark, sf_dir):
    g = tables.goroutines(spark, sf_dir)
    up = g.select(F.col("g_id").alias("parent_id"), F.col("func").alias("parent_func"))
    own = g.select("g_id", F.when(~F.col("parent").isin(0, -1), F.col("parent")).alias("p"))
    return own.join(up, F.col("p") == F.col("parent_id"), "left").select("g_id", "parent_id", "parent_func")


@query(f"WITH {_LOG} SELECT g, event_id, kind, ts, lead(ts) OVER (PARTITION BY g ORDER BY ts, event_id) AS next_ts FROM lg")
def next_sample_end(spark, sf_dir):
    return joins.next_time(tables.log(spark, sf_dir), "g", "ts", "event_id", "kind")


_GC_FUNCS = "('runtime.bgscavenge', 'runtime.bgsweep', 'runtime.gcBgMarkWorker')"


@query(f"WITH {_SPANS}, {_GOR} SELECT span_id, CAST(s.tags | CASE WHEN gor.func IN {_GC_FUNCS} THEN 128 ELSE 0 END AS INTEGER) AS tags FROM s LEFT JOIN trace_events e ON s.start_event = e.event_id LEFT JOIN gor ON gor.g_id = e.trans.res_id WHERE s.container = 'P'")
def gc_tags(spark, sf_dir):
    """The GC tag on processor spans whose goroutine runs one of the collector's functions."""
    s = tables.spans(spark, sf_dir, "container", "start_event", "tags").where("container = 'P'")
    e = table(spark, sf_dir, "trace_events").select(F.col("event_id").alias("start_event"), F.col("trans.res_id").alias("g_id"))
    g = tables.goroutines(spark, sf_dir).select("g_id", F.col("func").isin("runtime.bgscavenge", "runtime.bgsweep", "runtime.gcBgMarkWorker").alias("gc"))
    bit = F.when(F.col("gc"), 128).otherwise(0)
    return s.join(e, "start_event", "left").join(g, "g_id", "left").select("span_id", F.col("tags").bitwiseOR(bit).alias("tags"))


@query(f"WITH {_SPANS}, {_GOR} SELECT 'G' AS container, g_id AS id, coalesce(func, '') AS label FROM gor UNION ALL SELECT DISTINCT 'P', container_id, 'Processor ' || container_id FROM s WHERE container = 'P' ORDER BY 2, 1, 3")
def timeline_merge(spark, sf_dir):
    """Goroutine and processor timelines as one list, by id."""
    g = tables.goroutines(spark, sf_dir).select(F.lit("G").alias("container"), F.col("g_id").alias("id"), F.coalesce("func", F.lit("")).alias("label"))
    p = tables.spans(spark, sf_dir, "container", "container_id").where("container = 'P'").select("container", F.col("container_id").alias("id")).distinct()
    return g.unionByName(p.withColumn("label", F.concat(F.lit("Processor "), F.col("id")))).orderBy("id", "container", "label")


@query(f"WITH {_SPANS} SELECT span_id, container, container_id, start_ns, end_ns FROM s WHERE coalesce(end_ns, 9223372036854775807) > {HOUR} AND start_ns < {24 * HOUR}")
def visible_range(spark, sf_dir):
    s = tables.spans(spark, sf_dir, "container", "container_id", "start_ns", "end_ns")
    return s.where(f"(end_ns is null or end_ns > {HOUR}) and start_ns < {24 * HOUR}")


@query(f"WITH {_SPANS} SELECT kind, count(*) AS n, count(DISTINCT container_id) AS goroutines, min(start_ns) AS first_start FROM s WHERE track = 'region' GROUP BY 1")
def regions_by_label(spark, sf_dir):
    s = tables.spans(spark, sf_dir, "track", "kind", "container_id", "start_ns").where("track = 'region'")
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("container_id").alias("goroutines"), F.min("start_ns").alias("first_start"))


# ------------------------------------------------------------ tables, search, text
@query(
    f"""WITH {_GOR} SELECT g_id, coalesce(func, '') AS func, coalesce(end_ns, eff_end + 1) - coalesce(start_ns, -1) AS sort_ns,
  CASE WHEN start_ns IS NULL AND end_ns IS NULL THEN eff_end WHEN start_ns IS NULL THEN end_ns WHEN end_ns IS NULL THEN eff_end - start_ns ELSE end_ns - start_ns END AS shown_ns, start_ns IS NULL OR end_ns IS NULL AS approx
FROM gor ORDER BY sort_ns DESC, g_id"""
)
def goroutine_sorted(spark, sf_dir):
    g = tables.goroutines(spark, sf_dir)
    s, e = F.col("start_ns"), F.col("end_ns")
    shown = F.when(s.isNull() & e.isNull(), F.col("eff_end")).when(s.isNull(), e).when(e.isNull(), F.col("eff_end") - s).otherwise(e - s)
    return g.select(
        "g_id", F.coalesce("func", F.lit("")).alias("func"), (F.coalesce(e, F.col("eff_end") + 1) - F.coalesce(s, F.lit(-1))).alias("sort_ns"), shown.alias("shown_ns"), (s.isNull() | e.isNull()).alias("approx")
    ).orderBy(F.desc_nulls_last("sort_ns"), "g_id")


@query(f"WITH {_SPANS} SELECT span_id, state, end_ns - start_ns AS duration_ns FROM s WHERE end_ns >= start_ns ORDER BY duration_ns DESC, span_id LIMIT 100")
def longest_spans(spark, sf_dir):
    """Top-k report: the 100 longest spans."""
    s = tables.spans(spark, sf_dir, "state", "start_ns", "end_ns").where("end_ns >= start_ns")
    return s.select("span_id", "state", stats.duration().alias("duration_ns")).orderBy(F.desc("duration_ns"), "span_id").limit(100)


@query("SELECT event_id, ts, kind, coalesce(g, -1) AS g FROM trace_events ORDER BY ts, event_id")
def events_sorted(spark, sf_dir):
    return table(spark, sf_dir, "trace_events").select("event_id", "ts", "kind", F.coalesce("g", F.lit(-1)).alias("g")).orderBy("ts", "event_id")


@query(f"WITH {_GOR} SELECT g_id, func FROM gor WHERE contains(lower(coalesce(func, '')), 'pump') AND contains(lower(coalesce(func, '')), 'loop')")
def search(spark, sf_dir):
    g = tables.goroutines(spark, sf_dir)
    return g.where(text.timeline_matches("g Pump loop", F.lit("G"), F.col("g_id"), F.coalesce("func", F.lit("")))).select("g_id", "func")


@query("SELECT code, name FROM state_dim WHERE (contains(lower(name), 'blocked') OR contains(lower(coalesce(label, '')), 'blocked') OR contains(lower(ident), 'blocked')) AND (contains(lower(name), 'sync') OR contains(lower(coalesce(label, '')), 'sync') OR contains(lower(ident), 'sync'))")
def command_search(spark, sf_dir):
    d = table(spark, sf_dir, "state_dim")
    return d.where(text.command_matches("Blocked sync", F.col("name"), F.col("label"), F.lit(""), F.array("ident"))).select("code", "name")


@query(
    f"""WITH {_SPANS}, d AS (SELECT span_id, end_ns - start_ns AS d FROM s WHERE end_ns >= start_ns), r AS (
  SELECT span_id, d, CAST(CASE WHEN d < 1000000 THEN d WHEN d < 1000000000 THEN (d + 500) // 1000 * 1000 ELSE (d + 500000) // 1000000 * 1000000 END AS BIGINT) AS rounded_ns FROM d)
SELECT span_id, rounded_ns, CASE WHEN rounded_ns = 0 THEN '0.000  s' WHEN rounded_ns < 1000000 THEN printf('%d.%03d µs', rounded_ns // 1000, rounded_ns % 1000) WHEN rounded_ns < 1000000000 THEN printf('%d.%03d ms', rounded_ns // 1000000, rounded_ns // 1000 % 1000)
  ELSE printf('%d.%03d  s', rounded_ns // 1000000000, rounded_ns // 1000000 % 1000) END AS shown, printf('%d.%09d', d // 1000000000, d % 1000000000) AS exact FROM r"""
)
def display_text(spark, sf_dir):
    d = tables.spans(spark, sf_dir, "start_ns", "end_ns").where("end_ns >= start_ns").select("span_id", stats.duration().alias("d"))
    c = F.col("d")
    return d.select("span_id", text.round_duration(c).alias("rounded_ns"), text.duration_table(c).alias("shown"), text.duration_exact(c).alias("exact"))


@query(f"WITH {_GOR} SELECT g_id, CASE WHEN coalesce(func, '') = '' THEN 'goroutine ' || g_id ELSE 'goroutine ' || g_id || ': ' || func END AS label, regexp_extract(func, '[^.]*$', 0) AS short FROM gor")
def goroutine_labels(spark, sf_dir):
    g = tables.goroutines(spark, sf_dir)
    return g.select("g_id", text.goroutine_label(F.col("g_id"), F.col("func")).alias("label"), text.short_function(F.col("func")).alias("short"))


@query(f"WITH {_NAMED} SELECT regexp_replace(lower(state), '[^a-z0-9]', '', 'g') AS state_key, count(*) AS n FROM n WHERE state IS NOT NULL GROUP BY 1")
def states_by_key(spark, sf_dir):
    return _named(spark, sf_dir).where("state is not null").groupBy(state_key(F.col("state")).alias("state_key")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------ summaries and views
@query(
    f"""WITH {_SPANS}, {_GOR}, x AS (SELECT s.container_id, s.end_ns - s.start_ns AS d, coalesce(gor.func IN {_GC_FUNCS}, false) AS gc FROM s LEFT JOIN trace_events e ON s.start_event = e.event_id LEFT JOIN gor ON gor.g_id = e.trans.res_id WHERE s.container = 'P' AND s.end_ns >= s.start_ns),
t AS (SELECT max(ts) - min(ts) AS total FROM trace_events)
SELECT container_id, CAST(coalesce(sum(CASE WHEN NOT gc THEN d END), 0) AS BIGINT) AS user_ns, CAST(coalesce(sum(CASE WHEN gc THEN d END), 0) AS BIGINT) AS gc_ns, CAST(total - sum(d) AS BIGINT) AS idle_ns FROM x, t GROUP BY container_id, total"""
)
def proc_summary(spark, sf_dir):
    """Time of each processor in user code and in the collector, and the rest of the trace."""
    s = tables.spans(spark, sf_dir, "container", "container_id", "start_event", "start_ns", "end_ns").where("container = 'P' and end_ns >= start_ns")
    events = table(spark, sf_dir, "trace_events")
    e = events.select(F.col("event_id").alias("start_event"), F.col("trans.res_id").alias("g_id"))
    g = tables.goroutines(spark, sf_dir).select("g_id", F.col("func").isin("runtime.bgscavenge", "runtime.bgsweep", "runtime.gcBgMarkWorker").alias("gc"))
    x = s.join(e, "start_event", "left").join(g, "g_id", "left").withColumn("gc", F.coalesce("gc", F.lit(False))).withColumn("d", stats.duration())
    total = events.agg(F.max("ts") - F.min("ts")).scalar()
    z = lambda c: F.coalesce(F.sum(F.when(c, F.col("d"))), F.lit(0))
    one = x.groupBy("container_id").agg(z(~F.col("gc")).alias("user_ns"), z(F.col("gc")).alias("gc_ns"), F.sum("d").alias("_d"))
    return one.select("container_id", "user_ns", "gc_ns", (total - F.col("_d")).alias("idle_ns"))


@query(
    f"""WITH {_LOG}, x AS (SELECT g, ts // 86400000000000 AS day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(kind) AS a, max(kind) AS b FROM lg GROUP BY 1, 2)
SELECT g, day, n, first_ts - 1 AS lo, last_ts + 1 AS hi, CASE WHEN a = b THEN a ELSE 'events' END AS label FROM x"""
)
def event_groups(spark, sf_dir):
    """Events per goroutine and day: number, zoom range, and their common kind or 'events'."""
    e = tables.log(spark, sf_dir)
    x = e.groupBy("g", F.expr("ts div 86400000000000").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
    return x.select("g", "day", "n", (F.col("a") - 1).alias("lo"), (F.col("b") + 1).alias("hi"), F.when(F.col("k1") == F.col("k2"), F.col("k1")).otherwise("events").alias("label"))


@query(
    """SELECT l_orderkey AS task_id, l_linenumber AS region, coalesce(o_orderpriority, 'task ' || l_orderkey) AS task_name, c_name AS created_by FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey"""
)
def region_tasks(spark, sf_dir):
    """Regions with their task's name, or its id for a stub, and who created the task."""
    i, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = i.join(o, i.l_orderkey == o.o_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left")
    name = F.coalesce("o_orderpriority", F.concat(F.lit("task "), F.col("l_orderkey")))
    return j.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("region"), name.alias("task_name"), F.col("c_name").alias("created_by"))


@query("SELECT o_orderkey AS task_id, coalesce(o_orderpriority, '') AS name, epoch_us(o_orderdate) * 1000 AS start_ns FROM orders ORDER BY name, start_ns DESC, task_id")
def task_sorted(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderkey").alias("task_id"), F.coalesce("o_orderpriority", F.lit("")).alias("name"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("start_ns"))
    return t.orderBy("name", F.desc("start_ns"), "task_id")


@query(f"WITH {_NAMED}, st AS ({_stat_sql('state', 'n')}) SELECT * FROM st ORDER BY total_ns DESC, state")
def stats_sorted(spark, sf_dir):
    return _rounded(stats.compute_statistics(_named(spark, sf_dir, "start_ns", "end_ns"), ["state"])).orderBy(F.desc("total_ns"), "state")


@query(f"WITH {_M}, a AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1) SELECT series_id, lo, min(CASE WHEN value = lo THEN ts END) AS lo_ts, hi, min(CASE WHEN value = hi THEN ts END) AS hi_ts FROM m JOIN a USING (series_id) GROUP BY series_id, lo, hi")
def arg_extremes(spark, sf_dir):
    """Lowest and highest value of each series with the first time at which it was read."""
    m = _points(spark, sf_dir)
    lo, hi = F.min(F.struct("value", "ts")).alias("a"), F.max(F.struct("value", (-F.col("ts")).alias("t"))).alias("b")
    return m.groupBy("series_id").agg(lo, hi).select("series_id", F.col("a.value").alias("lo"), F.col("a.ts").alias("lo_ts"), F.col("b.value").alias("hi"), (-F.col("b.t")).alias("hi_ts"))


@query(
    """SELECT DISTINCT series_id, step_ns, CAST(floor(log2(step_ns / 1000.0)) AS BIGINT) AS level, CAST(pow(10.0, ceil(log10(step_ns * 20))) AS BIGINT) AS tick_ns, format('{:,}', step_ns) || ' ns' AS shown FROM plot_series"""
)
def axis(spark, sf_dir):
    """Zoom level, tick interval and label of each series' step."""
    s = table(spark, sf_dir, "plot_series").select("series_id", "step_ns").distinct()
    c = F.col("step_ns")
    return s.select("series_id", "step_ns", text.zoom_level(c, 1000).alias("level"), text.tick_interval(c, 20).alias("tick_ns"), text.timestamp_text(c).alias("shown"))


@query(
    """WITH f AS (SELECT DISTINCT func, regexp_extract(func, '^((?:.*/)?[^./]*)', 1) AS package FROM (SELECT unnest(funcs) AS func FROM stacks))
SELECT CASE WHEN package = 'runtime' THEN 'runtime' WHEN package = 'main' THEN 'main' WHEN NOT contains(split_part(package, '/', 1), '.') THEN 'stdlib' ELSE 'third-party' END AS class, count(*) AS n FROM f GROUP BY 1"""
)
def package_classes(spark, sf_dir):
    f = table(spark, sf_dir, "stacks").select(F.explode("funcs").alias("func")).distinct()
    return f.groupBy(text.package_class(F.col("func")).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {_GOR}, x AS (SELECT g_id, eff_end - eff_start AS d FROM gor) SELECT g_id, d AS duration_ns FROM x WHERE d >= 1000000 AND d <= 100000000000000")
def goroutines_in_range(spark, sf_dir):
    """Goroutines whose duration lies in a range picked in a histogram, both ends included."""
    g = tables.goroutines(spark, sf_dir).select("g_id", (F.col("eff_end") - F.col("eff_start")).alias("duration_ns"))
    return g.where("duration_ns >= 1000000 and duration_ns <= 100000000000000")
