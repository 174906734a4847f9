"""Queries of the training-data problems (1, 4, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import with_state_code
from ..session import Scratch, table
from . import digest, leakage, packing, residue, runs

QS = [0.25, 0.5, 0.9, 0.99]


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of goroutines' state spans, each once, by the rule of state_stats."""
    spans = table(spark, sf_dir, "spans").where("container = 'G' and track = 'state' and state is not null and end_ns >= start_ns")
    coded = with_state_code(spans.select("span_id", "container_id", "capture_date", "state", "start_ns", "end_ns"), table(spark, sf_dir, "state_dim"))
    return coded.select("span_id", F.col("container_id").alias("g_id"), "capture_date", "state_code", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns")).distinct()


def p1_goroutine_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _durations(spark, sf_dir)
    return digest.percentiles_over_days(rows, ["g_id"], "capture_date", "duration_ns", "span_id", QS)


def p1_state_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _durations(spark, sf_dir)
    return digest.percentiles_over_days(rows, ["state_code"], "capture_date", "duration_ns", "span_id", QS)


def p1_function_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "goroutines").where("g_id is not null").groupBy("g_id").agg(F.min("func").alias("func"))
    rows = _durations(spark, sf_dir).join(g, "g_id", "left")
    return digest.percentiles_over_days(rows, ["func"], "capture_date", "duration_ns", "span_id", QS)


def p1_daily_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.build_digests(_durations(spark, sf_dir), ["state_code", "capture_date"], "duration_ns")


def p1_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per goroutine and percentile: values, and whether the counted rank error is within the stated bound."""
    found = p1_goroutine_percentiles(spark, sf_dir)
    return found.select("g_id", "q", "n", (F.col("rank_error") <= digest.MAX_RANK_ERROR).alias("within"))


def p1_daily_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per state and day: what the digests hold of the values."""
    d = p1_daily_digests(spark, sf_dir).withColumn("capture_date", F.col("capture_date").cast("string"))
    return d.groupBy("state_code", "capture_date").agg(F.sum("weight").alias("n"), F.min("low").alias("lowest"), F.max("high").alias("highest"), F.round(F.sum(F.col("mean") * F.col("weight")) / 1e9, 3).alias("total_s"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "spans").where("container = 'G' and track = 'state'")
    return runs.collapse_runs(spans, table(spark, sf_dir, "state_dim"), "container_id", "seq", "state", "start_ns", "end_ns")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where("n_events >= 2").select("container_id", "first_seq", "last_seq")


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


TOLERANT = {"similarity": 0.8, "max_gap_ns": 1_000_000}


def p4_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that also take spellings a little off, but no pause above a millisecond."""
    spans = table(spark, sf_dir, "spans").where("container = 'G' and track = 'state'")
    return runs.collapse_runs(spans, table(spark, sf_dir, "state_dim"), "container_id", "seq", "state", "start_ns", "end_ns", **TOLERANT)


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = Scratch(spark, "sizes").put(packing.token_counts(table(spark, sf_dir, "documents")))
    return packing.audit(Scratch(spark, "placed").put(packing.pack(sizes)), sizes)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.without_leaked(docs, p8_found(spark, sf_dir)).select("doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return residue.without_residue(docs, residue.find_residue(docs)).select("doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        p1_goroutine_percentiles,
        p1_state_percentiles,
        p1_function_percentiles,
        p1_daily_digests,
        p1_certificate,
        p1_daily_audit,
        p4_found,
        p4_collapsed,
        p4_tolerant,
        p7_containers,
        p7_audit,
        p8_found,
        p8_clean,
        p9_found,
        p9_clean,
    )
}

_RUNS = """
WITH names AS (
  SELECT code, unnest([ident, name, name_cap, label]) AS n FROM state_dim
), nm AS (
  SELECT min(code) AS code, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS k FROM names WHERE n IS NOT NULL GROUP BY 2
), s AS (
  SELECT DISTINCT container_id, seq, start_ns, end_ns, state FROM spans WHERE container = 'G' AND track = 'state'
), c AS (
  SELECT s.*, code FROM s LEFT JOIN nm ON regexp_replace(lower(s.state), '[^a-z0-9]', '', 'g') = k
), l AS (
  SELECT *, CASE WHEN code = lag(code) OVER w AND seq = lag(seq) OVER w + 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY container_id ORDER BY seq)
), r AS (SELECT *, sum(new) OVER (PARTITION BY container_id ORDER BY seq) AS run FROM l
), runs AS (
  SELECT container_id, min(seq) AS first_seq, max(seq) AS last_seq, min(code) AS state_code, count(*) AS n_events,
    arg_min(start_ns, seq) AS start_ns, max(end_ns) - arg_min(start_ns, seq) AS duration_ns
  FROM r GROUP BY container_id, run
) """

_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 2, 1) + 1), lambda i: substring({0}, i, 3)))"
_DURATIONS = """
WITH names AS (
  SELECT code, unnest([ident, name, name_cap, label]) AS n FROM state_dim
), nm AS (
  SELECT min(code) AS code, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS k FROM names WHERE n IS NOT NULL GROUP BY 2
), s AS (
  SELECT DISTINCT span_id, container_id, capture_date, state, end_ns - start_ns AS v FROM spans WHERE container = 'G' AND track = 'state' AND state IS NOT NULL AND end_ns >= start_ns
), d AS (SELECT s.*, code FROM s LEFT JOIN nm ON regexp_replace(lower(s.state), '[^a-z0-9]', '', 'g') = k
) """

ORACLE = {
    "p1_certificate": _DURATIONS + "SELECT container_id AS g_id, q, count(*) AS n, true AS within FROM d, (SELECT unnest([0.25, 0.5, 0.9, 0.99])::DOUBLE AS q) GROUP BY 1, 2",
    "p1_daily_audit": _DURATIONS
    + "SELECT code AS state_code, CAST(capture_date AS VARCHAR) AS capture_date, count(*) AS n, min(v)::DOUBLE AS lowest, max(v)::DOUBLE AS highest, round(sum(v::DOUBLE) / 1e9, 3) AS total_s FROM d GROUP BY 1, 2",
    "p4_tolerant": f"""
WITH names AS (
  SELECT code, unnest([ident, name, name_cap, label]) AS n FROM state_dim
), nm AS (
  SELECT min(code) AS code, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS k FROM names WHERE n IS NOT NULL GROUP BY 2
), s AS (
  SELECT DISTINCT container_id, seq, start_ns, end_ns, state, regexp_replace(lower(state), '[^a-z0-9]', '', 'g') AS key FROM spans WHERE container = 'G' AND track = 'state'
), other AS (
  SELECT key, {_GRAMS.format("key")} AS g FROM (SELECT DISTINCT key FROM s WHERE key IS NOT NULL AND key NOT IN (SELECT k FROM nm))
), dim AS (SELECT code, k, {_GRAMS.format("k")} AS g FROM nm
), alike AS (
  SELECT key, code, len(list_intersect(o.g, d.g)) / (len(o.g) + len(d.g) - len(list_intersect(o.g, d.g)))::DOUBLE AS j FROM other o, dim d
), near AS (SELECT key, arg_min(code, {{'a': -j, 'b': code}}) AS code FROM alike WHERE j >= {TOLERANT["similarity"]} GROUP BY 1
), c AS (SELECT s.*, coalesce(nm.code, near.code) AS code FROM s LEFT JOIN nm ON s.key = nm.k LEFT JOIN near ON s.key = near.key
), l AS (
  SELECT *, CASE WHEN code = lag(code) OVER w AND seq = lag(seq) OVER w + 1 AND start_ns - lag(end_ns) OVER w <= {TOLERANT["max_gap_ns"]} THEN 0 ELSE 1 END AS new
  FROM c WINDOW w AS (PARTITION BY container_id ORDER BY seq)
), r AS (SELECT *, sum(new) OVER (PARTITION BY container_id ORDER BY seq) AS run FROM l
) SELECT container_id, min(seq) AS first_seq, max(seq) AS last_seq, min(code) AS state_code, count(*) AS n_events,
    arg_min(start_ns, seq) AS start_ns, max(end_ns) - arg_min(start_ns, seq) AS duration_ns FROM r GROUP BY container_id, run""",
    "p7_audit": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS lost_tokens, 0 AS cut_needlessly, 0 AS overfull, 0 AS shared, 0 AS mergeable FROM documents",
    "p4_found": _RUNS + "SELECT container_id, first_seq, last_seq FROM runs WHERE n_events >= 2",
    "p4_collapsed": _RUNS + "SELECT * FROM runs",
}
