import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from spanmill.operators.coverage import FOREVER, IntervalMap, gaps, periods

SCHEMA = "container string, container_id bigint, start_ns bigint, end_ns bigint, state string, gap_start string, _start string"


def brute(rows):
    out = {}
    for c, i, s, e in {r[:4] for r in rows}:
        if c is None or i is None or s is None or (e is not None and e <= s):
            continue
        out.setdefault((c, i), []).append((s, FOREVER if e is None else e))
    g, p = set(), set()
    for (c, i), v in out.items():
        v.sort()
        lo, hi = v[0]
        for s, e in v[1:]:
            if s > hi:
                g.add((c, i, hi, s))
                p.add((c, i, lo, hi))
                lo = s
            hi = max(hi, e)
        p.add((c, i, lo, None if hi == FOREVER else hi))
    return g, p


def test_gaps_and_periods_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        s = rng.randrange(0, 6000)
        e = rng.choice([None] * (rng.random() < 0.002) + [s + rng.choice([1, 3, 9, -2, 0, 40])])
        rows.append((rng.choice(["G", "P", None] if rng.random() < 0.02 else ["G", "P"]), rng.choice([1, 1, 1, 2, 3, None]), s if rng.random() < 0.98 else None, e, None, "x", "y"))
    rows += rows[:100]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    g, p = brute(rows)
    assert {tuple(r) for r in gaps(df).collect()} == g and gaps(df).count() == len(g)
    assert {tuple(r) for r in periods(df).collect()} == p


def test_edge_cases(spark):
    assert gaps(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("G", 1, 0, 5), ("G", 1, 5, 7), ("G", 1, 9, None), ("G", 1, 20, 30), ("G", 2, 4, 4), ("G", 3, 1, 2)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert [tuple(r) for r in gaps(df).collect()] == [("G", 1, 7, 9)]
    assert {tuple(r) for r in periods(df).collect()} == {("G", 1, 0, 7), ("G", 1, 9, None), ("G", 3, 1, 2)}


@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(-2, 9)), max_size=8), max_size=6))
def test_interval_map_is_the_union(batches):
    m, covered = IntervalMap(), set()
    for b in batches:
        m.insert([s for s, _ in b], [s + n for s, n in b])
        for s, n in b:
            covered |= set(range(s, s + n))
    assert (m.starts < m.ends).all() and (m.ends[:-1] < m.starts[1:]).all()
    assert {x for s, e in zip(m.starts, m.ends) for x in range(s, e)} == covered
    assert len(m.gaps()[0]) == max(0, len(m.starts) - 1)


def test_settle_keeps_the_gaps():
    m = IntervalMap([0, 10, 20], [5, 12, 25])
    a, b = m.settle(15)
    assert (a.tolist(), b.tolist()) == ([5], [10]) and m.starts.tolist() == [10, 20]
    assert np.array_equal(IntervalMap().settle(3)[0], [])
