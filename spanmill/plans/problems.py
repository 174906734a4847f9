"""Queries of the general problems (2, 3, 5, 6) over the trace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import with_state_code
from ..operators import balanced, coverage, grid, hierarchy
from ..session import table
from ..streaming import stateful


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.gaps(table(spark, sf_dir, "spans"))


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.periods(table(spark, sf_dir, "spans"))


def p2_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found from a stream of spans: interval maps in keyed state, changes appended, stretches joined."""
    return stateful.streamed_gaps(spark, f"{sf_dir}/spans.parquet")


def p3_goroutine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "spans").where("container = 'G' and track = 'state'")
    coded = with_state_code(spans.select("container_id", "seq", "span_id", "start_ns", "end_ns", "state"), table(spark, sf_dir, "state_dim"))
    return balanced.ordered_summary(coded, "container_id", "seq", "span_id", "start_ns", "end_ns", "state_code")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.endless_nodes(table(spark, sf_dir, "goroutines"))


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "goroutines"))


def p5_hierarchy_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_hierarchy with lists ranked in parallel however short they are."""
    return hierarchy.hierarchy(table(spark, sf_dir, "goroutines"), local_rows=1000)


def p6_grid_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of the grid that had readings: as they were."""
    g = p6_grid(spark, sf_dir).where("not filled")
    return g.select("series_id", "slot", F.round("value", 3).alias("value"), "n_readings")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every goroutine whose id is divisible by 50, the stated query set, among all."""
    t = hierarchy.hierarchy(table(spark, sf_dir, "goroutines"))
    return hierarchy.descendants(t, t.where("g_id % 50 = 0").select("g_id"))


def p5_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every goroutine whose id is divisible by 50, among all."""
    t = hierarchy.hierarchy(table(spark, sf_dir, "goroutines"))
    return hierarchy.ancestors(t, t.where("g_id % 50 = 0").select("g_id"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hierarchy.paths(table(spark, sf_dir, "goroutines"))
    return out.select("g_id", "root", "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = grid.regular_grid(table(spark, sf_dir, "metrics"), table(spark, sf_dir, "plot_series"))
    return filled.where("filled").select("series_id", "slot")


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_grid(table(spark, sf_dir, "metrics"), table(spark, sf_dir, "plot_series"))


def p6_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = grid.observed_slots(table(spark, sf_dir, "metrics"), table(spark, sf_dir, "plot_series"))
    return slots.select("series_id", "slot", F.round("y", 3).alias("value"), F.col("n").alias("n_readings"))


QUERIES = {f.__name__: f for f in (p2_found, p2_periods, p2_streamed, p3_goroutine_summary, p5_found, p5_hierarchy, p5_hierarchy_ranked, p5_descendants, p5_ancestors, p5_paths, p6_found, p6_grid, p6_grid_observed, p6_observed)}

_COVER = """
WITH s AS (
  SELECT DISTINCT container, container_id, start_ns, coalesce(end_ns, 9223372036854775807) AS e
  FROM spans WHERE end_ns IS NULL OR end_ns > start_ns
), o AS (
  SELECT *, max(e) OVER (PARTITION BY container, container_id ORDER BY start_ns, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s
)"""

_CODES = """names AS (
  SELECT code, unnest([ident, name, name_cap, label]) AS n FROM state_dim
), nm AS (
  SELECT min(code) AS code, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS k FROM names WHERE n IS NOT NULL GROUP BY 2
)"""

_LINKS = """links AS (
  SELECT g.g_id, k.g_id AS parent FROM (
    SELECT g_id, min(CASE WHEN parent NOT IN (0, -1) THEN parent END) AS parent FROM goroutines WHERE g_id IS NOT NULL GROUP BY g_id
  ) g LEFT JOIN (SELECT DISTINCT g_id FROM goroutines) k ON g.parent = k.g_id
), tree AS (
  SELECT g_id, g_id AS root, CAST(0 AS BIGINT) AS depth, CAST(g_id AS VARCHAR) AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.g_id, t.root, t.depth + 1, t.path || '/' || l.g_id FROM tree t JOIN links l ON l.parent = t.g_id
)"""

_SLOTS = """obs AS (
  SELECT m.series_id, min(s.step_ns) AS step_ns, CAST(floor(m.ts / s.step_ns) AS BIGINT) AS slot
  FROM (SELECT DISTINCT series_id, ts FROM metrics WHERE reading IS NOT NULL) m
  JOIN (SELECT DISTINCT series_id, step_ns FROM plot_series) s USING (series_id) GROUP BY 1, 3
), nxt AS (SELECT series_id, slot, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS n FROM obs)"""

ORACLE = {
    "p2_found": _COVER + " SELECT container, container_id, m AS gap_start, start_ns AS gap_end FROM o WHERE start_ns > m",
    "p2_streamed": _COVER + " SELECT container, container_id, m AS gap_start, start_ns AS gap_end FROM o WHERE start_ns > m",
    "p2_periods": _COVER
    + """, r AS (
  SELECT *, sum(CASE WHEN m IS NULL OR start_ns > m THEN 1 ELSE 0 END) OVER (PARTITION BY container, container_id ORDER BY start_ns, e) AS island FROM o
) SELECT container, container_id, min(start_ns) AS period_start, nullif(max(e), 9223372036854775807) AS period_end
FROM r GROUP BY container, container_id, island""",
    "p3_goroutine_summary": "WITH "
    + _CODES
    + """, s AS (
  SELECT DISTINCT container_id, seq, span_id, start_ns, end_ns, state FROM spans WHERE container = 'G' AND track = 'state'
), c AS (
  SELECT s.*, coalesce(code, -1) AS code FROM s LEFT JOIN nm ON regexp_replace(lower(s.state), '[^a-z0-9]', '', 'g') = k
), l AS (
  SELECT *, lag(code) OVER w AS pc, lag(end_ns) OVER w AS pe FROM c WINDOW w AS (PARTITION BY container_id ORDER BY seq, span_id)
) SELECT container_id, count(*) AS n_spans, CAST(sum(CASE WHEN end_ns >= start_ns THEN end_ns - start_ns END) AS BIGINT) AS total_ns,
  min(start_ns) AS first_start_ns, max(end_ns) AS last_end_ns,
  CAST(sum(CASE WHEN pc <> code THEN 1 ELSE 0 END) AS BIGINT) AS n_changes,
  max(CASE WHEN start_ns > pe THEN start_ns - pe END) AS longest_wait_ns
FROM l GROUP BY container_id""",
    "p5_found": "WITH RECURSIVE "
    + _LINKS
    + """, endless AS (SELECT * FROM links WHERE g_id NOT IN (SELECT g_id FROM tree)
), walk AS (
  SELECT g_id, parent AS pos FROM endless
  UNION
  SELECT w.g_id, e.parent FROM walk w JOIN endless e ON e.g_id = w.pos
), on_cycle AS (SELECT DISTINCT g_id FROM walk WHERE g_id = pos)
SELECT w.g_id, min(w.pos) AS cycle_g_id FROM walk w WHERE w.pos IN (SELECT g_id FROM on_cycle) GROUP BY w.g_id""",
    "p5_hierarchy": "WITH RECURSIVE "
    + _LINKS
    + """, up AS (
  SELECT t.g_id, t.g_id AS anc, l.parent FROM tree t JOIN links l USING (g_id)
  UNION ALL
  SELECT u.g_id, u.parent, l.parent FROM up u JOIN links l ON l.g_id = u.parent
), size AS (SELECT anc AS g_id, CAST(count(*) - 1 AS BIGINT) AS nd FROM up GROUP BY anc
), t2 AS (SELECT t.g_id, t.root, t.depth, s.nd, l.parent FROM tree t JOIN size s USING (g_id) JOIN links l USING (g_id)
), off AS (SELECT *, coalesce(sum(2 * nd + 2) OVER (PARTITION BY parent ORDER BY g_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t2 WHERE parent IS NOT NULL
), pos AS (
  SELECT u.g_id, CAST(sum(o.before + 1) AS BIGINT) AS entry FROM up u JOIN off o ON o.g_id = u.anc GROUP BY u.g_id
) SELECT t2.g_id, root, depth, coalesce(entry, 0) AS entry, coalesce(entry, 0) + 2 * nd + 2 AS exit, nd AS n_descendants
FROM t2 LEFT JOIN pos USING (g_id)""",
    "p5_descendants": "WITH RECURSIVE "
    + _LINKS
    + """, d AS (
  SELECT t.g_id AS g_id, t.g_id AS pos, CAST(0 AS BIGINT) AS distance FROM tree t WHERE g_id % 50 = 0
  UNION ALL
  SELECT d.g_id, l.g_id, d.distance + 1 FROM d JOIN links l ON l.parent = d.pos
) SELECT g_id, pos AS descendant, distance FROM d WHERE distance > 0""",
    "p5_ancestors": "WITH RECURSIVE "
    + _LINKS
    + """, u AS (
  SELECT t.g_id AS g_id, t.g_id AS pos, CAST(0 AS BIGINT) AS distance FROM tree t WHERE g_id % 50 = 0
  UNION ALL
  SELECT u.g_id, l.parent, u.distance + 1 FROM u JOIN links l ON l.g_id = u.pos WHERE l.parent IS NOT NULL
) SELECT g_id, pos AS ancestor, distance FROM u WHERE distance > 0""",
    "p5_paths": "WITH RECURSIVE " + _LINKS + " SELECT g_id, root, depth, path FROM tree",
    "p6_observed": """
SELECT m.series_id, CAST(floor(m.ts / s.step_ns) AS BIGINT) AS slot, round(avg(CAST(reading AS DOUBLE)), 3) AS value, count(*) AS n_readings
FROM (SELECT DISTINCT series_id, metric_name, ts, reading FROM metrics WHERE reading IS NOT NULL AND ts IS NOT NULL) m
JOIN (SELECT DISTINCT series_id, step_ns FROM plot_series WHERE step_ns > 0) s USING (series_id) GROUP BY 1, 2""",
    "p6_found": "WITH " + _SLOTS + " SELECT series_id, unnest(range(slot + 1, n)) AS slot FROM nxt WHERE n > slot + 1",
}
ORACLE["p5_hierarchy_ranked"] = ORACLE["p5_hierarchy"]
ORACLE["p6_grid_observed"] = ORACLE["p6_observed"]
