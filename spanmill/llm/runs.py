"""Runs of like consecutive events collapsed into one (problem 4).

A state machine walks each entity's events in order and compares every event
with the anchor of the run at hand. Rows are range partitioned by entity and
order, so an entity with a third of all events is walked by many tasks; the
first and last run of a task are joined with their neighbours afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import state_key, state_names, with_state_code
from ..operators.sweep import PID, column, range_sweep, starts_of
from ..session import Scratch

_NONE = -(2**63)
_COLS = ["first_seq", "last_seq", "code", "n_events", "first_start", "last_start", "last_end", "max_end"]


def with_codes(df: DataFrame, state_dim: DataFrame, label: str, similarity: float = 1.0) -> DataFrame:
    """Adds `_code`, the row of state_dim that a label denotes, null for none.

    Spellings that agree in letters and digits are the same. With a similarity
    below 1 any other spelling goes to the accepted name whose character
    trigrams are most alike (Jaccard), if they are alike enough; that is worked
    out once a spelling, in a table that is written, so that Spark knows its
    size when it plans the join.
    """
    exact = with_state_code(df, state_dim, label)
    if similarity >= 1:
        return exact.withColumn("_code", F.col("state_code").cast("bigint")).drop("state_code")
    names = state_names(state_dim)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    other = exact.where(F.col(label).isNotNull() & F.col("state_code").isNull()).select(F.col(label).alias("_other"), state_key(F.col(label)).alias("_k")).distinct()
    other = other.select("_other", F.explode(grams(F.col("_k"))).alias("g"), F.size(grams(F.col("_k"))).alias("na"))
    dim = names.select("name_key", "state_code", F.explode(grams(F.col("name_key"))).alias("g"), F.size(grams(F.col("name_key"))).alias("nb"))
    shared = other.join(dim, "g").groupBy("_other", "name_key", "state_code", "na", "nb").agg(F.count("*").alias("m"))
    score = F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))
    best = shared.where(score >= similarity).groupBy("_other").agg(F.min_by("state_code", F.struct(-score, "state_code")).alias("_near"))
    best = Scratch(df.sparkSession, "spellings").put(best)
    return exact.join(best, exact[label] == best["_other"], "left").withColumn("_code", F.coalesce("state_code", "_near").cast("bigint")).drop("state_code", "_other", "_near")


def _machine(entity: str, max_gap: int | None):
    def run(batches: Iterator[pa.RecordBatch], pid: int) -> Iterator[pa.RecordBatch]:
        held = None  # the run at hand: entity and _COLS
        seen = None  # last event, to tell repeats
        count = 0

        def emit(ent, st, edge) -> pa.RecordBatch:
            cols = [pa.array(ent), pa.array(np.full(len(ent), pid, dtype=np.int32))]
            cols += [pa.array(st[c], mask=st[c] == _NONE) for c in _COLS] + [pa.array(edge)]
            return pa.RecordBatch.from_arrays(cols, names=[entity, PID, *_COLS, "edge"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            k, seq, code = column(batch, entity), column(batch, "_seq"), column(batch, "_code", _NONE)
            s, e = column(batch, "_start", _NONE), column(batch, "_end", _NONE)
            keep = np.zeros(len(k), dtype=bool)
            keep[starts_of(k, seq)] = True
            if seen == (k[0], seq[0]):
                keep[0] = False
            seen = (k[-1], seq[-1])
            if not keep.any():
                continue
            k, seq, code, s, e = k[keep], seq[keep], code[keep], s[keep], e[keep]
            n = len(k)
            new = np.ones(n, dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (seq[1:] != seq[:-1] + 1) | (code[1:] != code[:-1]) | (code[1:] == _NONE)
            if max_gap is not None:
                new[1:] |= (s[1:] == _NONE) | (e[:-1] == _NONE) | (s[1:] - e[:-1] > max_gap)
            if held is not None:
                a = held[1]
                new[0] = not (held[0] == k[0] and seq[0] == a["last_seq"] + 1 and code[0] == a["code"] != _NONE)
                if max_gap is not None and not new[0]:
                    new[0] = s[0] == _NONE or a["last_end"] == _NONE or s[0] - a["last_end"] > max_gap
            at = np.flatnonzero(new)
            if held is not None and not new[0]:
                at = np.append(0, at)
            last = np.append(at[1:], n) - 1
            st = {
                "first_seq": seq[at], "last_seq": seq[last], "code": code[at], "n_events": last - at + 1,
                "first_start": s[at], "last_start": s[last], "last_end": e[last], "max_end": np.maximum.reduceat(e, at),
            }
            ent = k[at]
            if held is not None:
                if not new[0]:
                    a = held[1]
                    st["first_seq"][0], st["first_start"][0] = a["first_seq"], a["first_start"]
                    st["n_events"][0] += a["n_events"]
                    st["max_end"][0] = max(st["max_end"][0], a["max_end"])
                else:
                    ent = np.append(held[0], ent)
                    st = {c: np.append(held[1][c], v) for c, v in st.items()}
            if len(ent) > 1:
                edge = np.zeros(len(ent) - 1, dtype=bool)
                edge[0] = count == 0
                count += len(edge)
                yield emit(ent[:-1], {c: v[:-1] for c, v in st.items()}, edge)
            held = (int(ent[-1]), {c: int(v[-1]) for c, v in st.items()})
        if held is not None:
            yield emit(np.array([held[0]]), {c: np.array([v]) for c, v in held[1].items()}, np.array([True]))

    return run


def collapse_runs(
    df: DataFrame, state_dim: DataFrame, entity: str, order: str, label: str, start: str, end: str, max_gap_ns: int | None = None, similarity: float = 1.0
) -> DataFrame:
    """One row per run: entity, first_seq, last_seq, code, n_events, start_ns, duration_ns.

    A run is a maximal stretch of events whose whole-number orders follow each
    other without a hole, whose labels denote one row of state_dim (see
    `with_codes`) and, if max_gap_ns is given, of which each starts at most
    that long after the end of the one before. An event whose label is null or
    has no code is a run of its own with a null code. duration_ns goes from the
    first start to the latest end, null where no end is known. Events that
    agree in entity and order are repeats and count once; those with a null
    entity or order are left out. Empty tables give no rows.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(order).isNotNull()).select(
        F.col(entity).cast("bigint").alias(entity),
        F.col(order).cast("bigint").alias("_seq"),
        F.col(start).cast("bigint").alias("_start"),
        F.col(end).cast("bigint").alias("_end"),
        F.col(label).alias("_label"),
    )
    rows = with_codes(rows, state_dim, "_label", similarity).drop("_label")
    schema = f"{entity} bigint, {PID} int, " + ", ".join(f"{c} bigint" for c in _COLS) + ", edge boolean"
    found = Scratch(df.sparkSession, "runs").put(range_sweep(rows, [entity], ["_seq"], _machine(entity, max_gap_ns), schema))
    # Two runs a task at most, whatever the data.
    edge = found.where("edge")
    w = Window.partitionBy(entity).orderBy("first_seq")
    joins = (F.col("first_seq") == F.lag("last_seq").over(w) + 1) & (F.col("code") == F.lag("code").over(w))
    if max_gap_ns is not None:
        joins &= F.col("first_start") - F.lag("last_end").over(w) <= max_gap_ns
    edge = edge.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    edge = edge.groupBy(entity, "_run").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.min("code").alias("code"), F.sum("n_events").alias("n_events"),
        F.min_by("first_start", "first_seq").alias("first_start"), F.max("max_end").alias("max_end"),
    ).drop("_run")
    whole = found.where("not edge").select(*edge.columns).unionByName(edge)
    return whole.select(
        entity, "first_seq", "last_seq", F.col("code").cast("int").alias("state_code"), "n_events", F.col("first_start").alias("start_ns"), (F.col("max_end") - F.col("first_start")).alias("duration_ns")
    )
