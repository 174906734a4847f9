"""Per-key results where a few keys hold most rows (problem 3).

Rows are range partitioned on (key, order), so a heavy key is cut into pieces
of even size. Every task reduces its pieces to one partial state per key; the
states of a key, at most one a task, are then stitched in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sweep import PID, column, range_sweep, starts_of

_NONE = -(2**63)
_STATE = ["n", "total", "timed", "first_start", "last_end", "changes", "wait", "first_label", "last_label", "head_start", "open_end"]


def _reduce(key: str):
    """Partial states of the sorted rows of one task."""

    def run(batches: Iterator[pa.RecordBatch], pid: int) -> Iterator[pa.RecordBatch]:
        held = None  # the state of the key at hand, whose rows may go on
        seen = None  # the last row's key and order, to tell repeats

        def emit(keys: np.ndarray, st: dict) -> pa.RecordBatch:
            cols = [pa.array(keys), pa.array(np.full(len(keys), pid, dtype=np.int32))]
            cols += [pa.array(st[c], mask=st[c] == _NONE) for c in _STATE]
            return pa.RecordBatch.from_arrays(cols, names=[key, PID, *_STATE])

        def join(a: dict, b: dict) -> dict:
            """The state of piece a followed by piece b."""
            out = {c: a[c] + b[c] for c in ("n", "total", "timed", "changes")}
            low = [x for x in (a["first_start"], b["first_start"]) if x != _NONE]
            out["first_start"] = min(low, default=_NONE)
            out["last_end"] = max(a["last_end"], b["last_end"])
            out["changes"] += int(a["last_label"] != b["first_label"])
            out["wait"] = max(a["wait"], b["wait"])
            out |= {"first_label": a["first_label"], "head_start": a["head_start"], "last_label": b["last_label"], "open_end": b["open_end"]}
            return out

        for batch in batches:
            if batch.num_rows == 0:
                continue
            k, seq, rid = column(batch, key), column(batch, "_seq", _NONE), column(batch, "_id", _NONE)
            s, e, lab = column(batch, "_start", _NONE), column(batch, "_end", _NONE), column(batch, "_label", _NONE + 1)
            new = np.zeros(len(k), dtype=bool)
            new[starts_of(k, seq, rid)] = True
            if seen == (k[0], seq[0], rid[0]):
                new[0] = False
            seen = (k[-1], seq[-1], rid[-1])
            if not new.any():
                continue
            k, s, e, lab = k[new], s[new], e[new], lab[new]
            at = starts_of(k)
            last = np.append(at[1:], len(k)) - 1
            ok = (s != _NONE) & (e != _NONE) & (e >= s)
            inner = np.ones(len(k), dtype=bool)
            inner[at] = False
            prev_e, prev_l = np.roll(e, 1), np.roll(lab, 1)
            waits = np.where(inner & (s != _NONE) & (prev_e != _NONE) & (s > prev_e), s - prev_e, _NONE)
            st = {
                "n": np.diff(np.append(at, len(k))),
                "total": np.add.reduceat(np.where(ok, e - s, 0), at),
                "timed": np.add.reduceat(ok.astype(np.int64), at),
                "first_start": np.minimum.reduceat(np.where(s == _NONE, 2**63 - 1, s), at),
                "last_end": np.maximum.reduceat(e, at),
                "changes": np.add.reduceat((inner & (lab != prev_l)).astype(np.int64), at),
                "wait": np.maximum.reduceat(waits, at),
                "first_label": lab[at],
                "last_label": lab[last],
                "head_start": s[at],
                "open_end": e[last],
            }
            st["first_start"][st["first_start"] == 2**63 - 1] = _NONE
            keys = k[at]
            if held is not None:
                if held[0] == keys[0]:
                    b = {c: int(st[c][0]) for c in _STATE}
                    a = held[1]
                    if a["open_end"] != _NONE and s[0] != _NONE and s[0] > a["open_end"]:
                        b["wait"] = max(b["wait"], int(s[0]) - a["open_end"])
                    for c, v in join(a, b).items():
                        st[c][0] = v
                else:
                    yield emit(np.array([held[0]]), {c: np.array([v]) for c, v in held[1].items()})
            if len(keys) > 1:
                yield emit(keys[:-1], {c: st[c][:-1] for c in _STATE})
            held = (int(keys[-1]), {c: int(st[c][-1]) for c in _STATE})
        if held is not None:
            yield emit(np.array([held[0]]), {c: np.array([v]) for c, v in held[1].items()})

    return run


def ordered_summary(df: DataFrame, key: str, order: str, row_id: str, start: str, end: str, label: str) -> DataFrame:
    """One row per key of what its rows show in their order.

    n_spans; total_ns of the rows with an end not before their start;
    first_start_ns; last_end_ns; n_changes, how often the (whole-number) label
    differs from that of the row before; longest_wait_ns, the longest time from
    a row's end to the start of the next row, null if there is none.

    Rows that agree in key, order and row_id count once. Rows with a null key
    are ignored; a null label is a label of its own; null starts and ends take
    no part in times. An empty table gives no rows.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias(key),
        F.col(order).cast("bigint").alias("_seq"),
        F.col(row_id).cast("bigint").alias("_id"),
        F.col(start).cast("bigint").alias("_start"),
        F.col(end).cast("bigint").alias("_end"),
        F.col(label).cast("bigint").alias("_label"),
    )
    schema = f"{key} bigint, {PID} int, " + ", ".join(f"{c} bigint" for c in _STATE)
    pieces = range_sweep(rows, [key], ["_seq", "_id"], _reduce(key), schema)
    w = Window.partitionBy(key).orderBy(PID)
    before_label, before_end = F.lag("last_label").over(w), F.lag("open_end").over(w)
    joined = pieces.select(
        "*",
        (before_label != F.col("first_label")).cast("bigint").alias("_turn"),
        F.when(F.col("head_start") > before_end, F.col("head_start") - before_end).alias("_wait"),
    )
    return joined.groupBy(key).agg(
        F.sum("n").alias("n_spans"),
        F.when(F.sum("timed") > 0, F.sum("total")).alias("total_ns"),
        F.min("first_start").alias("first_start_ns"),
        F.max("last_end").alias("last_end_ns"),
        (F.sum("changes") + F.coalesce(F.sum("_turn"), F.lit(0))).alias("n_changes"),
        F.max(F.greatest("wait", "_wait")).alias("longest_wait_ns"),
    )
