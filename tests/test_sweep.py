import numpy as np
import pandas as pd
import pytest

from spanmill.operators.sweep import balanced_next, balanced_prefix, balanced_prev, running_max, starts_of
from spanmill.session import Scratch


def test_running_max_by_group():
    v = np.array([3, 1, 4, 2, 0, 5])
    assert running_max(v, np.array([0, 3])).tolist() == [3, 3, 4, 2, 2, 5]
    assert starts_of(np.array([1, 1, 2, 1])).tolist() == [0, 2, 3]
    assert starts_of(np.array([])).tolist() == []


@pytest.mark.parametrize("seed", range(2))
def test_balanced_windows_equal_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    n = 600
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.5, 7, rng.integers(0, 30, n)), "o": rng.permutation(n), "v": rng.integers(-1, 2, n)}).astype("int64")
    df = spark.createDataFrame(pdf).repartition(5)
    e = pdf.sort_values(["k", "o"]).reset_index(drop=True)
    for keys in (["k"], []):
        r = balanced_prefix(df, keys, ["o"], "v", Scratch(spark, "t")).toPandas().sort_values([*keys, "o"]).reset_index(drop=True)
        x = pdf.sort_values([*keys, "o"]).reset_index(drop=True)
        run = x.groupby("k").v.cumsum() if keys else x.v.cumsum()
        low = (run.groupby(x.k).cummin() if keys else run.cummin()).clip(upper=0)
        assert r.run.tolist() == run.tolist() and r.low.tolist() == low.tolist()
    nxt = balanced_next(df, ["k"], ["o"], ["o"], Scratch(spark, "t")).toPandas().sort_values(["k", "o"])
    assert nxt.next_o.fillna(-1).tolist() == e.groupby("k").o.shift(-1).fillna(-1).tolist()
    prv = balanced_prev(df, ["k"], ["o"], ["v"], Scratch(spark, "t")).toPandas().sort_values(["k", "o"])
    assert prv.prev_v.fillna(-9).tolist() == e.groupby("k").v.shift(1).fillna(-9).tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "k bigint, o bigint, v bigint")
    assert balanced_prefix(df, ["k"], ["o"], "v", Scratch(spark, "t")).count() == 0
    assert balanced_next(df, ["k"], ["o"], ["v"], Scratch(spark, "t")).count() == 0


def test_plan_has_no_window_over_data(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as o", "1L as v")
    plan = balanced_prefix(df, ["k"], ["o"], "v", Scratch(spark, "t"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
