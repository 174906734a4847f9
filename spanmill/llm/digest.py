"""Percentiles of very large numeric columns by merging centroid digests (problem 1).

A digest is a set of centroids (mean, weight) over sorted values. A size
function of the quantile keeps centroids small towards both ends. Digests of
partitions merge into digests of days, those into one of all days: put the
centroids together, sort, cluster again. A second pass over the values counts
how many lie below each estimate and so certifies its rank error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sweep import column, starts_of
from ..session import Scratch, is_empty

#: Compression: a digest of any number of values has at most delta / 2 + 1 centroids.
DELTA = 400
#: Rows or centroids that are clustered at once in a task.
CHUNK_ROWS = 200_000
#: Digests of so many tasks are merged first, then what comes of them.
FAN = 128
#: In the counting pass no task gets more than about 1/HEAVY of all rows of a key: a key with more is salted, and fewer than HEAVY keys can have more.
HEAVY = 4096
#: Keys with a larger rank error are done again with a finer digest.
MAX_RANK_ERROR = 0.01

_CENTROID = "mean double, weight bigint, low double, high double"


def _cluster_of(q: np.ndarray, delta: float) -> np.ndarray:
    return np.floor(delta / (2 * np.pi) * (np.arcsin(np.clip(2 * q - 1, -1, 1)) + np.pi / 2)).astype(np.int64)


def _cluster_column(q: Column, delta: float) -> Column:
    return F.floor(F.lit(delta / (2 * np.pi)) * (F.asin(F.least(F.greatest(2 * q - 1, F.lit(-1.0)), F.lit(1.0))) + np.pi / 2))


def _partial(keys: list[str], types: dict, delta: float):
    """Digests of the rows of one task: each chunk is merged into what the task has so far."""
    names = [*keys, "mean", "weight", "low", "high"]

    def digest(t: pa.Table) -> pa.Table:
        # whole-number codes for the key columns, in any order
        codes = np.zeros(len(t), dtype=np.int64)
        for k in keys:
            c = t[k].combine_chunks().dictionary_encode()
            ix = c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = codes * (len(c.dictionary) + 1) + ix
            _, codes = np.unique(codes, return_inverse=True)
        mean, weight, low, high = (t[c].to_numpy() for c in names[-4:])
        order = np.lexsort((high, low, mean, codes))
        codes, mean, weight, low, high = codes[order], mean[order], weight[order], low[order], high[order]
        at = starts_of(codes)
        n = np.diff(np.append(at, len(mean)))
        upto = np.cumsum(weight)
        before = np.repeat(np.append(0, upto)[at], n)
        size = np.repeat(np.add.reduceat(weight, at), n)
        cut = starts_of(codes, _cluster_of((upto - before - weight / 2) / size, delta))
        total = np.add.reduceat(weight, cut)
        rows = t.select(keys).take(pa.array(order[cut]))
        cols = [np.add.reduceat(mean * weight, cut) / total, total, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)]
        for c, v in zip(names[-4:], cols):
            rows = rows.append_column(c, pa.array(v))
        return rows

    def single(b: pa.RecordBatch) -> pa.Table:
        t, v = pa.Table.from_batches([b]), b.column(b.schema.get_field_index("_value"))
        t = t.select(keys)
        for c, x in zip(names[-4:], (v, pa.array(np.ones(len(v), dtype=np.int64)), v, v)):
            t = t.append_column(c, x)
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(single(b))
                n += b.num_rows
            if n >= CHUNK_ROWS:
                done = digest(pa.concat_tables(held))
                held, n = [done], len(done)
                # so many keys that their centroids alone are half a chunk: these go on as they are
                if n > CHUNK_ROWS // 2:
                    yield from done.combine_chunks().to_batches()
                    held, n = [], 0
        if n:
            yield from digest(pa.concat_tables(held)).combine_chunks().to_batches()

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + _CENTROID
    return run, schema


def merge_digests(centroids: DataFrame, keys: list[str], delta: float = DELTA) -> DataFrame:
    """One digest per key from any number of digests: sorted, clustered again.

    Window and grouping share one exchange. A key has at most delta / 2 + 1
    centroids for each digest that is merged; `build_digests` merges those of
    FAN tasks at a time, so that a key with rows in every task stays small here.
    """
    every = Window.partitionBy(*keys)
    upto = every.orderBy("mean", "low", "high", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = centroids.select("*", ((F.sum("weight").over(upto) - F.col("weight") / 2) / F.sum("weight").over(every)).alias("_q"))
    return placed.groupBy(*keys, _cluster_column(F.col("_q"), delta).alias("_c")).agg(
        (F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high")
    ).drop("_c")


def build_digests(df: DataFrame, keys: list[str], value: str, delta: float = DELTA) -> DataFrame:
    """Digest rows (keys, mean, weight, low, high) of a numeric column per key.

    Rows are clustered where they lie, before any exchange. Null values are
    left out; null keys are a key. Empty tables give no rows.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_value"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    run, schema = _partial(keys, types, delta)
    parts = rows.mapInArrow(run, schema).withColumn("_group", F.expr(f"spark_partition_id() div {FAN}"))
    return merge_digests(merge_digests(parts, [*keys, "_group"], delta).drop("_group"), keys, delta)


def quantiles(digests: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, n, q, estimate): interpolated between the middles of centroids.

    Where every centroid is one value the median is the middle value, or the
    mean of both middles.
    """
    every = Window.partitionBy(*keys)
    w = every.orderBy("mean", "low", "high", "weight")
    cum = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = digests.select("*", (cum - F.col("weight") / 2).alias("_mid"), F.sum("weight").over(every).alias("n"), F.max("high").over(every).alias("_max"), F.min("low").over(every).alias("_min"))
    t = t.select("*", F.lead("_mid").over(w).alias("_mid2"), F.lead("mean").over(w).alias("_mean2"), F.lag("_mid").over(w).alias("_mid0"))
    t = t.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_t", F.col("q") * F.col("n"))
    inside = F.when(F.col("_mid2").isNotNull(), F.col("_t") < F.col("_mid2")).otherwise(True) & F.when(F.col("_mid0").isNotNull(), F.col("_t") >= F.col("_mid")).otherwise(True)
    between = F.col("mean") + (F.col("_mean2") - F.col("mean")) * (F.col("_t") - F.col("_mid")) / (F.col("_mid2") - F.col("_mid"))
    low = F.when(F.col("weight") == 1, F.col("mean")).otherwise(F.col("_min") + (F.col("mean") - F.col("_min")) * F.col("_t") / F.col("_mid"))
    high = F.when(F.col("weight") == 1, F.col("mean")).otherwise(
        F.col("mean") + (F.col("_max") - F.col("mean")) * F.least(F.lit(1.0), (F.col("_t") - F.col("_mid")) / (F.col("n") - F.col("_mid")))
    )
    estimate = F.when(F.col("_t") < F.col("_mid"), low).when(F.col("_mid2").isNull(), high).otherwise(between)
    return t.where(inside).select(*keys, "n", "q", estimate.alias("estimate"))


def certified(df: DataFrame, keys: list[str], value: str, row_id: str, estimates: DataFrame) -> DataFrame:
    """Estimates with their rank error, from a second pass that counts.

    (keys, n, q, estimate, n_below, n_upto, rank_error): how many values lie
    below the estimate and up to it; rank_error is how far q * n is from that
    stretch, as a share of n (half a row is allowed for, as a quantile may
    stand between two rows). Keys with more than 1/HEAVY of all rows are cut
    into pieces of about that size by a hash of the row id.
    """
    per_key = estimates.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("q", "estimate"))).alias("_e"))
    total = per_key.agg(F.sum("n")).first()[0] or 0
    per_key = per_key.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col("n") * HEAVY / F.lit(max(1, total)))).cast("bigint"))
    # At most HEAVY - 1 rows, because their shares sum to 1 or less.
    few = F.broadcast(per_key.where("_salts > 1").select(*keys, F.col("_salts").alias("_s")))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_value"), F.xxhash64(row_id).alias("_h"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    rows = rows.join(few, same(rows, few), "left").select(*[rows[k] for k in keys], "_value", F.pmod("_h", F.coalesce("_s", F.lit(1))).alias("_salt"))
    spread = per_key.select(*keys, "n", "_e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)).alias("_salt"))
    joined = rows.join(spread, [*same(rows, spread), rows["_salt"] == spread["_salt"]])
    m = estimates.select("q").distinct().count() or 1
    counts = [F.sum((F.col("_value") < F.col("_e")[i]["estimate"]).cast("bigint")).alias(f"_b{i}") for i in range(m)]
    counts += [F.sum((F.col("_value") <= F.col("_e")[i]["estimate"]).cast("bigint")).alias(f"_u{i}") for i in range(m)]
    counted = joined.select(*[rows[k] for k in keys], "_value", "_e").groupBy(*keys).agg(*counts)
    out = per_key.join(counted, [per_key[k].eqNullSafe(counted[k]) for k in keys])
    each = F.array(*[F.struct(F.col("_e")[i]["q"].alias("q"), F.col("_e")[i]["estimate"].alias("estimate"), F.col(f"_b{i}").alias("n_below"), F.col(f"_u{i}").alias("n_upto")) for i in range(m)])
    out = out.select(*[per_key[k] for k in keys], "n", F.inline(each))
    t = F.col("q") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("n_below") - t - 0.5, t - F.col("n_upto") - 0.5) / F.col("n")
    return out.withColumn("rank_error", error)


def percentiles_over_days(
    df: DataFrame, keys: list[str], day: str, value: str, row_id: str, qs: list[float], delta: float = DELTA, max_rank_error: float = MAX_RANK_ERROR
) -> DataFrame:
    """Certified percentiles over all days, merged from one digest per key and day.

    `df` must have each row once. It is written once and read for both passes.
    Keys of which a percentile's certified rank error is above max_rank_error
    are done again with a digest four times as fine, until none is left: the
    bound holds for every row of the result.
    """
    scratch = Scratch(df.sparkSession, "digest")
    rows = scratch.put(df.select(*keys, day, value, row_id))
    out = None
    while True:
        daily = build_digests(rows, [*keys, day], value, delta)
        estimates = scratch.put(quantiles(merge_digests(daily, keys, delta), keys, qs))
        now = scratch.put(certified(rows, keys, value, row_id, estimates))
        bad = now.where(F.col("rank_error") > max_rank_error).select(*keys).distinct()
        if is_empty(bad):
            return now if out is None else out.unionByName(now)
        bad = scratch.put(bad)
        among = lambda a: [a[k].eqNullSafe(bad[k]) for k in keys]
        fine = now.join(bad, among(now), "left_anti")
        out = fine if out is None else out.unionByName(fine)
        rows = scratch.put(rows.join(bad, among(rows), "left_semi"))
        delta *= 4
