"""Stacks: patterns, flame graphs, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OFF_CPU, PATTERNS, TAG_ORDER, TAGS
from ..session import Scratch
from . import bins, intervals


def apply_patterns(spans: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Adds new_state, new_at and new_tags by the stack patterns of a span's state.

    `spans` has state and funcs (leaf first). Patterns apply in order: the last
    offset and the last state win, tags add up. A pattern whose offset lies
    beyond the stack is skipped as a whole. Everything is one projection: the
    patterns are a fixed list, so no join is needed.
    """
    n = F.size("funcs")
    state, at = F.col("state"), F.lit(0)
    tagged: dict[str, Column] = {}
    for of, absolute, anywhere, to, offset, tag in patterns:
        hit = (F.col("state") == of) & F.col("funcs").isNotNull()
        for i, fn in enumerate(absolute):
            hit &= (n > i) if fn == "" else ((n > i) & (F.get("funcs", F.lit(i)) == fn))
        for fn in anywhere:
            hit &= F.array_contains("funcs", fn)
        if offset:
            hit &= n > offset
            at = F.when(hit, offset).otherwise(at)
        if to:
            state = F.when(hit, to).otherwise(state)
        if tag:
            tagged[tag] = tagged[tag] | hit if tag in tagged else hit
    tags = reduce(Column.bitwiseOR, [F.when(hit, TAGS[tag]).otherwise(0) for tag, hit in tagged.items()], F.lit(0))
    return spans.withColumns({"new_state": state, "new_at": at, "new_tags": tags})


def skip_runtime(at: Column) -> Column:
    """Offset of the first frame at or after `at` outside the runtime; the outermost frame at most."""
    n = F.size("funcs")
    first = F.array_min(F.filter(F.transform("funcs", lambda f, i: F.when((i >= at) & ~F.startswith(f, F.lit("runtime.")), i)), lambda i: i.isNotNull()))
    return F.when(F.col("funcs").isNull() | (n == 0), at).otherwise(F.least(F.coalesce(first, n - 1), F.greatest(n - 1, F.lit(0)), F.lit(255)))


def tag_names(tags: Column) -> Column:
    """Names of set tags in their fixed order, joined by a comma."""
    named = F.array(*[F.when(tags.bitwiseAND(F.lit(TAGS[t])) != 0, t) for t in TAG_ORDER])
    return F.array_join(F.filter(named, lambda t: t.isNotNull()), ", ")


def flame(samples: DataFrame, root: Column, weight: Column, funcs: str = "funcs") -> DataFrame:
    """(path, depth, duration): sum of the weights below each path of root and frames, outermost first.

    Whole paths are summed before prefixes are made, so the explosion by depth
    works on distinct stacks, not on samples.
    """
    whole = samples.select(F.concat(F.array(root), F.reverse(funcs)).alias("path"), weight.alias("w")).where("path is not null")
    whole = whole.groupBy("path").agg(F.sum("w").alias("w"))
    at = whole.select("path", "w", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    return at.groupBy(F.slice("path", F.lit(1), F.col("depth")).alias("path"), "depth").agg(F.sum("w").alias("duration"))


def _duration() -> Column:
    """Time between start_ns and end_ns, which may lie further apart than a BIGINT reaches."""
    return F.col("end_ns").cast("decimal(20,0)") - F.col("start_ns").cast("decimal(20,0)")


def narrowed(df: DataFrame, column: str, label: str) -> DataFrame:
    """`column` as BIGINT if every value fits, else as DECIMAL(38,0) in all rows; written to find out."""
    out = Scratch(df.sparkSession, label).put(df.withColumn(column, F.col(column).cast("decimal(38,0)")))
    fits = out.where(f"{column} not between {-(2**63)} and {2**63 - 1}").isEmpty()
    return out.withColumn(column, F.col(column).cast("bigint")) if fits else out


def on_cpu(events: DataFrame) -> DataFrame:
    """(g, p, stack_id, root, w): CPU samples under 'Running', each of the mean processor time per sample."""
    samples = events.where("kind = 'StackSample'")
    time = intervals.processor_spans(events).agg(F.sum(_duration()).cast("double")).scalar()
    mean = F.round(F.try_divide(time, samples.agg(F.count("*")).scalar()))
    # a double beyond BIGINT is a multiple of 2048; cast to a decimal at once it would lose its last digits
    weight = F.when(F.abs(mean) < 2.0**63, mean.cast("bigint").cast("decimal(31,0)")).otherwise((mean / 2048).cast("bigint").cast("decimal(20,0)") * F.lit(2048))
    return samples.select("g", "p", "stack_id", F.lit("Running").alias("root"), weight.alias("w"))


def off_cpu(events: DataFrame, stacks: DataFrame) -> DataFrame:
    """(g, stack_id, root, w): durations of blocked spans under the root of their state, patterns applied."""
    # no other state gets a root, by patterns or without
    spans = intervals.spans_with_stack(events, sorted({*OFF_CPU, *(p[0] for p in PATTERNS)})).select("g", "stack_id", "state", _duration().alias("w"))
    named = apply_patterns(spans.join(stacks, "stack_id"))
    roots = F.create_map(*[F.lit(x) for kv in OFF_CPU.items() for x in kv])
    return named.select("g", "stack_id", roots[F.col("new_state")].alias("root"), "w").where("root is not null")


def weighted_flame(parts: DataFrame, stacks: DataFrame) -> DataFrame:
    """The flame graph of (stack_id, root, w); stacks without frames count nowhere.

    Sums are exact: duration is BIGINT if that of every path fits, else
    DECIMAL(38,0) in all rows. The graph is written to find out.
    """
    one = parts.groupBy("stack_id", "root").agg(F.sum(F.col("w").cast("decimal(31,0)")).alias("w"))
    return narrowed(flame(one.join(stacks.where("size(funcs) > 0"), "stack_id"), F.col("root"), F.col("w")), "duration", "flame")


def flame_metrics(tree: DataFrame) -> DataFrame:
    """Adds self time, number of children and share of the parent.

    self is DECIMAL(38,0): where time runs backwards between events, durations
    that fit a BIGINT each need not do so as they are summed.
    """
    wide = F.col("duration").cast("decimal(38,0)")
    up = tree.where("depth > 1").select(F.slice("path", F.lit(1), F.col("depth") - 1).alias("path"), wide.alias("d"))
    kids = up.groupBy("path").agg(F.sum("d").alias("below"), F.count("*").alias("n_children"))
    parents = tree.select(F.col("path").alias("up"), F.col("duration").alias("parent_duration"))
    out = tree.join(kids, "path", "left").withColumn("up", F.when(F.col("depth") > 1, F.slice("path", F.lit(1), F.col("depth") - 1)))
    out = out.join(parents, "up", "left")
    return out.select("path", "depth", "duration", (wide - F.coalesce("below", F.lit(0))).cast("decimal(38,0)").alias("self"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.try_divide(F.col("duration").cast("double") * 100, "parent_duration").alias("pct_parent"))


def flame_shares(tree: DataFrame) -> DataFrame:
    """Adds pct_top, the share of a path in its top root, and pct_visible, that in all roots together."""
    tops = tree.where("depth = 1").select(F.col("path")[0].alias("_top"), F.col("duration").alias("_t"))
    # roots that fit a BIGINT each may not do so together
    every = tree.where("depth = 1").agg(F.sum(F.col("duration").cast("decimal(38,0)"))).scalar()
    share = lambda whole: F.try_divide(F.col("duration").cast("double") * 100, whole.cast("double"))
    out = tree.join(tops, F.col("path")[0] == F.col("_top")).select("*", every.alias("_all"))
    return out.select("path", "depth", "duration", share(F.col("_t")).alias("pct_top"), share(F.col("_all")).alias("pct_visible"))


def stack_text(funcs: Column, limit: int) -> Column:
    """Frames in lines; the middle of a stack longer than `limit` is hidden."""
    limit = max(limit, 2)
    top, bottom = limit - limit // 2, limit // 2
    n = F.size(funcs)
    hidden = F.concat(F.lit("["), (n - limit).cast("string"), F.lit(" frames hidden]"))
    short = F.concat(F.slice(funcs, 1, top), F.array(hidden), F.slice(funcs, -bottom, bottom))
    return F.array_join(F.when(n > limit, short).otherwise(funcs), "\n")


def stack_tracks(events: DataFrame, stacks: DataFrame, level: int | None = None) -> DataFrame:
    """(g, level, func, state, start_ns, end_ns, n_samples): stack tracks, levels from the outermost kept frame.

    Entries of a level that touch and agree in function and state are one row;
    n_samples is how many CPU samples it stands for.
    """
    e = intervals.stack_entries(events, stacks)
    n = F.size("funcs")
    at = e.select("g", "event_id", "start_ns", "end_ns", "state", n.alias("_n"), F.posexplode("funcs").alias("_i", "func"))
    rows = at.select("g", (F.col("_n") - F.col("_i") - 1).cast("bigint").alias("level"), "event_id", "start_ns", "end_ns", "state", "func")
    if level is not None:
        rows = rows.where(F.col("level") == level)
    runs = bins.contiguous_runs(rows, ["g", "level"], ["event_id"], "start_ns", "end_ns", ["func", "state"])
    return runs.select("g", "level", "func", "state", "start_ns", "end_ns", F.when(F.col("state") == "CPU sample", F.col("n")).otherwise(0).cast("bigint").alias("n_samples"))
