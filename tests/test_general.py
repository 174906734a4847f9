import numpy as np
import pytest

from spanmill.operators import balanced, bins, grid, hierarchy, intervals


def test_ordered_summary_cases(spark):
    schema = "k bigint, seq bigint, id bigint, s bigint, e bigint, lab int, n string"
    rows = [(1, 0, 1, 0, 5, 1, "x"), (1, 0, 1, 0, 5, 1, "y"), (1, 1, 2, 9, 12, 1, None), (1, 2, 3, 12, None, None, None), (1, 3, 4, 20, 19, 2, None), (2, 0, 5, None, None, 1, None), (None, 0, 6, 1, 2, 1, None)]
    out = {r[0]: tuple(r)[1:] for r in balanced.ordered_summary(spark.createDataFrame(rows, schema), "k", "seq", "id", "s", "e", "lab").collect()}
    assert out == {1: (4, 8, 0, 19, 2, 4), 2: (1, None, None, None, 0, None)}
    assert balanced.ordered_summary(spark.createDataFrame([], schema), "k", "seq", "id", "s", "e", "lab").count() == 0


def brute_tree(par):
    ends, depth = {}, {}
    for x in par:
        seen = []
        y = x
        while y is not None and y not in seen:
            seen.append(y)
            y = par[y]
        if y is None:
            depth[x] = list(reversed(seen))
        else:
            ends[x] = min(seen[seen.index(y) :])
    return ends, depth


def test_hierarchy_against_brute_force(spark):
    rng = np.random.default_rng(2)
    par = {i: (None if rng.random() < 0.05 else int(rng.integers(max(1, i - 4), i))) if i > 1 else None for i in range(1, 161)}
    par |= {500: 501, 501: 502, 502: 500, 503: 502, 504: 503, 600: 600}
    rows = [(k, v if v is not None else [None, 0, -1, 9999][k % 4], "n") for k, v in par.items()]
    df = spark.createDataFrame([*rows, *rows[:20], (None, 3, "n")], "g_id bigint, parent bigint, node string")
    ends, depth = brute_tree(par)
    assert {r[0]: r[1] for r in hierarchy.endless_nodes(df).collect()} == ends
    assert {r.g_id: r.path for r in hierarchy.paths(df).collect()} == depth
    h = {r.g_id: r for r in hierarchy.hierarchy(df, local_rows=40).collect()}
    assert set(h) == set(depth)
    for x, p in depth.items():
        assert (h[x].root, h[x].depth) == (p[0], len(p) - 1)
        below = {y for y, q in depth.items() if x in q[:-1]}
        assert h[x].n_descendants == len(below)
        assert {y for y, r in h.items() if r.root == h[x].root and h[x].entry < r.entry < h[x].exit} == below
    tree = spark.createDataFrame(hierarchy.hierarchy(df).toPandas())
    # several levels of splitters
    assert sorted(map(tuple, hierarchy.hierarchy(df, local_rows=18).collect())) == sorted(map(tuple, tree.collect()))
    some = spark.createDataFrame([(x,) for x in (*list(depth)[::3], 77777, None)], "g_id bigint")
    want = {(x, y, len(depth[y]) - len(depth[x])) for x in list(depth)[::3] for y, q in depth.items() if x in q[:-1]}
    assert sorted(tuple(r) for r in hierarchy.descendants(tree, some).collect()) == sorted(want)
    want = {(y, x, len(depth[y]) - len(depth[x])) for y in list(depth)[::3] for x in depth[y][:-1]}
    assert sorted(tuple(r) for r in hierarchy.ancestors(tree, some).collect()) == sorted(want)


def test_more_trees_than_are_ranked_at_once(spark):
    """Many short lists beside a long one: every level must get shorter."""
    rows = [(i, i - 1 if 1 < i <= 120 else None) for i in range(1, 200)] + [(i, i - 100) for i in range(300, 340)]
    df = spark.createDataFrame(rows, "g_id bigint, parent bigint")
    want = sorted(map(tuple, hierarchy.hierarchy(df).collect()))
    assert len(want) == 239 and sorted(map(tuple, hierarchy.hierarchy(df, local_rows=8).collect())) == want


def test_hierarchy_of_nothing(spark):
    df = spark.createDataFrame([], "g_id bigint, parent bigint")
    assert hierarchy.endless_nodes(df).count() == 0 and hierarchy.hierarchy(df, local_rows=40).count() == 0 and hierarchy.paths(df).count() == 0


METRICS = "series_id bigint, metric_name string, ts bigint, reading bigint, lo string"
SERIES = "series_id bigint, step_ns bigint, y string"


def test_grid_follows_a_seasonal_series(spark):
    hour, day = 3_600_000_000_000, 86_400_000_000_000
    t = np.arange(0, 6 * day, hour)
    y = 1000 + 20 * t / day + 300 * np.sin(2 * np.pi * t / day)
    keep = (np.arange(len(t)) < 60) | (np.arange(len(t)) > 75)
    rows = [(1, "m", int(a) + 5, int(round(b)), "z") for a, b in zip(t[keep], y[keep])]
    g = grid.regular_grid(spark.createDataFrame(rows, METRICS), spark.createDataFrame([(1, hour, None)], SERIES)).toPandas().sort_values("slot")
    assert g.slot.tolist() == list(range(len(t)))
    assert set(g[g.filled].slot) == set(np.flatnonzero(~keep))
    assert np.abs(g[g.filled].value.to_numpy() - y[~keep]).max() < 15


def test_grid_cases(spark):
    rows = [(1, "m", -5, 4, None), (1, "m", -5, 4, "again"), (1, "m", -5, 8, None), (1, "m", 35, 10, None), (1, None, 12, None, None), (2, "m", 5, 1, None), (3, "m", 0, 1, None), (4, "m", 0, 1, None), (None, "m", 0, 1, None)]
    series = [(1, 10, None), (2, 10, None), (3, 0, None), (3, None, None)]
    g = grid.regular_grid(spark.createDataFrame(rows, METRICS), spark.createDataFrame(series, SERIES))
    out = {(r.series_id, r.slot): (r.n_readings, r.filled) for r in g.collect()}
    assert out == {(1, -1): (2, False), (1, 0): (0, True), (1, 1): (0, True), (1, 2): (0, True), (1, 3): (1, False), (2, 0): (1, False)}
    values = {r.slot: r.value for r in g.collect() if r.series_id == 1}
    assert values[-1] == 6 and values[3] == 10 and 6 < values[1] < 10
    assert grid.regular_grid(spark.createDataFrame([], METRICS), spark.createDataFrame(series, SERIES)).count() == 0


def test_long_outage_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 16)
    rows = [(1, "m", 0, 0, None), (1, "m", 1000, 100, None)]
    g = grid.regular_grid(spark.createDataFrame(rows, METRICS), spark.createDataFrame([(1, 1, None)], SERIES)).where("filled")
    assert sorted(r.slot for r in g.collect()) == list(range(1, 1000))


def test_busy_of_edges(spark):
    df = spark.createDataFrame([(0, 0, 100), (0, 100, 250), (0, 300, 300), (0, 300, None)], "p int, start_ns bigint, end_ns bigint")
    assert {tuple(r) for r in bins.processor_busy(df, "p", 100).collect()} == {(0, 0, 100, 100), (0, 1, 100, 100), (0, 2, 50, 50)}


def test_basic_trace(spark):
    kinds = [("NotExist", "Runnable", None), ("Runnable", "Running", None), ("Running", "Running", None), ("Running", "Waiting", "chan receive"), ("Waiting", "Runnable", None), ("Runnable", "Running", None), ("Running", "NotExist", None)]
    rows = [(i, 10 * i, "StateTransition", 9, 0, None, None, ("Goroutine", 1, f, t, r, None)) for i, (f, t, r) in enumerate(kinds)]
    rows.append((7, 70, "StateTransition", None, 0, None, None, ("Goroutine", 2, "Undetermined", "Waiting", "what is this", None)))
    from spanmill.sources.files import EVENT_SCHEMA

    ev = spark.createDataFrame(rows, EVENT_SCHEMA)
    got = sorted((r.g, r.start_ns, r.end_ns, r.state) for r in intervals.goroutine_spans(ev).collect() if r.g == 1)
    assert got == [(1, 0, 10, "created"), (1, 10, 30, "active"), (1, 30, 40, "blocked (channel receive)"), (1, 40, 50, "ready"), (1, 50, 60, "active")]
    late = [r for r in intervals.goroutine_spans(ev).collect() if r.g == 2]
    assert [(r.start_ns, r.end_ns, r.state, r.before_trace) for r in late] == [(0, 70, None, True)]
    empty = spark.createDataFrame([], EVENT_SCHEMA)
    assert intervals.trace_extent(empty).first()[2] == 0 and intervals.goroutine_spans(empty).count() == 0


def test_ids_near_the_largest_long(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, top - 1), (top - 1, top - 2), (top - 2, None), (top - 3, top - 4), (top - 4, top - 3), (-(2**63) + 5, top - 3)], "g_id bigint, parent bigint")
    assert {tuple(r) for r in hierarchy.endless_nodes(df).collect()} == {(top - 3, top - 4), (top - 4, top - 4), (-(2**63) + 5, top - 4)}
    assert {(r.g_id, r.root, r.depth) for r in hierarchy.hierarchy(df).collect()} == {(top, top - 2, 2), (top - 1, top - 2, 1), (top - 2, top - 2, 0)}


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from spanmill import session

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(session.NoSharedFolder):
        session.checkpoint_root(SimpleNamespace(conf=conf, sparkContext=context))


def test_values_in_hidden_blocks(spark):
    """A season of any period beats the straight line between the ends; without one nothing is worse."""
    rng = np.random.default_rng(11)
    n, rows, hidden, truth = 3000, [], np.zeros(3000, dtype=bool), {}
    for at in np.cumsum(rng.integers(50, 150, 25)):
        hidden[at : at + 25] = True
    t = np.arange(n)
    truth[1] = 1000 * np.sin(2 * np.pi * t / 61.7) + 300 * np.cos(4 * np.pi * t / 61.7) + 0.3 * t + rng.normal(0, 60, n)
    truth[2] = np.cumsum(rng.normal(0, 100, n))
    for s, y in truth.items():
        truth[s] = y = np.round(y)
        rows += [(s, "m", int(i) * 1000, int(y[i]), None) for i in t[~hidden]]
    g = grid.regular_grid(spark.createDataFrame(rows, METRICS), spark.createDataFrame([(1, 1000, None), (2, 1000, None)], SERIES)).toPandas()
    error = {}
    for s, y in truth.items():
        x = g[(g.series_id == s) & g.filled].sort_values("slot")
        assert x.slot.tolist() == t[hidden].tolist()
        error[s] = np.abs(x.value.to_numpy() - y[hidden]).mean() / np.abs(np.interp(t[hidden], t[~hidden], y[~hidden]) - y[hidden]).mean()
    assert error[1] < 0.25 and error[2] < 1.02


def test_exact_ranks(spark):
    rng = np.random.default_rng(4)
    for v in (rng.integers(0, 10**9, 5000), rng.integers(0, 3, 4000), np.array([5]), np.repeat([1, 9], [999, 1])):
        rows = spark.createDataFrame([(int(x),) for x in v], "v bigint").repartition(5)
        ranks = sorted({1, max(1, len(v) // 4), max(1, len(v) // 4) + (len(v) > 1), len(v)})
        assert bins.exact_ranks(rows, ranks, len(v)) == {r: float(np.sort(v)[r - 1]) for r in ranks}
    assert bins.outlier_cutoff(spark.createDataFrame([], "v bigint"), "v").first()[0] is None
