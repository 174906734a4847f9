"""Statistics of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .sweep import balanced_prefix



def duration() -> Column:
    return F.col("end_ns") - F.col("start_ns")


def exact_median(df: DataFrame, keys: list[str], value: str, row_id: str, sizes: DataFrame | None = None) -> DataFrame:
    """(keys, median): the middle value, or the mean of both middles.

    Ranks come from a balanced sweep over (keys, value), so neither one key nor
    one value is a long task; percentile() would gather a key's values in one
    buffer. `sizes` may give the rows per key as _n, if they are known.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, row_id).withColumn("_one", F.lit(1).cast("bigint"))
    scratch = Scratch(df.sparkSession, "median")
    ranked = balanced_prefix(rows, keys, [value, row_id], "_one", scratch)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")) if sizes is None else sizes
    same = [ranked[k].eqNullSafe(sizes[k]) for k in keys]
    middle = ranked.join(sizes, same).where("run = (_n + 1) div 2 or run = (_n + 2) div 2")
    return middle.groupBy(*[ranked[k] for k in keys]).agg(F.avg(F.col(value).cast("double")).alias("median_ns"))


def compute_statistics(spans: DataFrame, keys: list[str], row_id: str = "span_id") -> DataFrame:
    """Per key: cnt, min_ns, max_ns, total_ns, average_ns, median_ns of durations.

    Rows must be distinct. Spans without an end, or that end before they
    start, are left out. Null keys are a key.
    """
    # written once: the statistics, the sampling of split points and the ranking all read it
    rows = Scratch(spans.sparkSession, "statistics").put(spans.where("end_ns >= start_ns").select(*keys, row_id, duration().alias("_d")))
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("cnt"), F.min("_d").alias("min_ns"), F.max("_d").alias("max_ns"), F.sum("_d").alias("total_ns"), F.avg(F.col("_d").cast("double")).alias("average_ns")
    )
    med = exact_median(rows, keys, "_d", row_id, agg.select(*keys, F.col("cnt").alias("_n")))
    out = agg.join(med, [agg[k].eqNullSafe(med[k]) for k in keys])
    return out.select(*[agg[k] for k in keys], "cnt", "min_ns", "max_ns", "total_ns", "average_ns", "median_ns")


def min_after_zero(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Compatible minimum: the smallest duration after the last zero-length span, 0 if that is the last."""
    rows = spans.where("end_ns >= start_ns").select(*keys, order, duration().alias("_d"))
    last = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(F.when(F.col("_d") == 0, F.col(order))).alias("_z"))
    after = rows.join(last, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return after.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_z").isNull() | (F.col(order) > F.col("_z")), F.col("_d"))), F.lit(0)).alias("compat_min_ns"))


def roll_ups() -> list[Column]:
    """Sums of the four classes of states over rows joined with state_dim."""
    d = F.when(F.col("end_ns") >= F.col("start_ns"), duration())
    return [F.coalesce(F.sum(F.when(F.col(c), d)), F.lit(0)).cast("bigint").alias(f"{c}_ns") for c in ("blocked", "running", "inactive", "gc_assist")]


def set_summary(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number, summed duration, first start, end of the last by start, common state or 'mixed'."""
    last = F.struct("start_ns", "span_id")
    return spans.groupBy(*keys).agg(
        F.count("*").alias("n_spans"),
        F.sum(F.when(F.col("end_ns") >= F.col("start_ns"), duration())).alias("total_ns"),
        F.min("start_ns").alias("first_start"),
        F.max_by("end_ns", last).alias("last_end"),
        F.when(F.min("state") == F.max("state"), F.min("state")).otherwise("mixed").alias("state"),
    )


def heat(busy: DataFrame, y_size: int) -> DataFrame:
    """(x, y, n): how many processors lie in each band of utilization in each bucket.

    The last band is closed and takes all above. Only cells that occur.
    """
    top = -(-100 // y_size) - 1
    band = F.least(F.floor(F.col("pct") / y_size), F.lit(top)).cast("bigint")
    return busy.groupBy(F.col("bucket").alias("x"), band.alias("y")).agg(F.count("*").alias("n"))


def heat_saturation(cells: DataFrame, total_cells: int | Column) -> DataFrame:
    """Cells with linear and ranked saturation (0-255; at least 1 where anything is).

    Ranks are over distinct counts, of which there are at most as many as
    processors, and include the empty cells' 0 where there are any.
    """
    distinct = cells.select("n").distinct()
    # one task, but of at most as many rows as there are processors
    rank = distinct.select("n", F.dense_rank().over(Window.orderBy("n")).alias("r"))
    k, top = distinct.agg(F.count("*")).scalar(), distinct.agg(F.max("n")).scalar()
    grid = total_cells if isinstance(total_cells, Column) else F.lit(total_cells)
    count = cells.agg(F.count("*")).scalar()
    out = cells.join(rank, "n").select("*", k.alias("k"), top.alias("top"), (grid > count).cast("bigint").alias("e"))
    return out.select("x", "y", "n", F.greatest(F.lit(1), F.expr("255 * n div top")).cast("bigint").alias("linear"), F.greatest(F.lit(1), F.expr("255 * (r + e) div (k + e)")).cast("bigint").alias("ranked"))


def with_bounds(cells: DataFrame, width: int, y_size: int) -> DataFrame:
    """Heat cells with the bounds of their bucket and band, [start, end); the last band takes its end too."""
    return cells.withColumns({"x_start": F.col("x") * width, "x_end": (F.col("x") + 1) * width, "y_start": F.col("y") * y_size, "y_end": (F.col("y") + 1) * y_size})


def in_range(value: Column, lo: int, hi: int) -> Column:
    """Whether a value lies in a range picked in a histogram: both ends included, hi 0 is open."""
    return (value >= lo) & (value <= hi) if hi else value >= lo


def six_decimals(x: Column) -> Column:
    """A number of 0 or more with six decimals, from its exact value (Java's own format fills up with zeros)."""
    whole = F.floor(x).cast("bigint")
    part = F.bround((x - whole) * 1e6).cast("bigint")
    return F.format_string("%d.%06d", whole + (part >= 1_000_000).cast("bigint"), F.pmod(part, F.lit(1_000_000)))


def statistics_rows(statistics: DataFrame, state_dim: DataFrame) -> DataFrame:
    """Rows of the statistics file: every named state in its order, zeros where nothing was seen, floats with six decimals."""
    j = state_dim.join(statistics, F.col("name") == F.col("state"), "left").orderBy("code")
    z = lambda c, a: F.coalesce(c, F.lit(0)).alias(a)
    f = lambda c, a: six_decimals(F.coalesce(c, F.lit(0.0)).cast("double")).alias(a)
    return j.select(F.col("name_cap").alias("State"), z("cnt", "Count"), z("min_ns", "Min"), z("max_ns", "Max"), z("total_ns", "Total"), f("average_ns", "Average"), f("median_ns", "Median"))
