import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import edges, sort
from tessera.operators.scans import FOLDS, scan

NAN = float("nan")


@pytest.mark.parametrize("right", [False, True])
def test_places_as_numpy(spark, right):
    rng = random.Random(2)
    known = [rng.choice([-1.5, 0.0, 2.0, 7.25, rng.uniform(-9, 9)]) for _ in range(900)] + [NAN, float("inf"), float("-inf"), NAN]
    asked = [-2.0, -1.5, 0.0, -0.0, 2.0, 7.25, 100.0, NAN, float("inf"), float("-inf")] + [rng.uniform(-10, 10) for _ in range(300)] + [2.0] * 400
    table = spark.createDataFrame([(v,) for v in known] + [(None,)], "e double")
    values = spark.createDataFrame([(i, v) for i, v in enumerate([*asked, None])], "i long, `x.y` double")
    want = np.searchsorted(np.sort(known), asked, side="right" if right else "left")
    got = {r.i: r.place for r in edges.searchsorted(values, table, "x.y", "e", right).collect()}
    assert got == {**{i: int(w) for i, w in enumerate(want)}, len(asked): None}


@pytest.mark.parametrize("right", [False, True])
def test_bins_as_numpy(spark, right):
    bins, asked = np.array([0.0, 1.0, 2.5, 4.0, 10.0]), [-1.0, 0.0, 0.2, 2.5, 6.4, 10.0, 11.0]
    values, table = spark.createDataFrame([(i, v) for i, v in enumerate(asked)], "i long, x double"), spark.createDataFrame([(float(b),) for b in bins], "e double")
    for decreasing in (False, True):
        got = [r.bin for r in edges.digitize(values, table, "x", "e", right, decreasing).orderBy("i").collect()]
        assert got == np.digitize(asked, bins[::-1] if decreasing else bins, right=right).tolist()


def test_no_edges_and_no_values(spark):
    none, some = spark.createDataFrame([], "e double"), spark.createDataFrame([(1.0,)], "x double")
    assert edges.searchsorted(some, none, "x", "e").first().place == 0
    assert edges.searchsorted(none, some, "e", "x").count() == 0


@pytest.mark.parametrize("name", sorted(set(FOLDS) - {"affine"}))
def test_folds_against_loops(spark, name):
    rng, fold = random.Random(7), FOLDS[name]
    value = lambda: rng.randrange(-999, 999) if fold.whole else rng.uniform(-1.2, 1.2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, None if rng.random() < 0.1 else value()) for i in range(3000)]
    frame = spark.createDataFrame(rows, f"k string, i long, x {'long' if fold.whole else 'double'}").repartition(5)
    for keys in ((), ("k",)):
        state, want = {}, {}
        for k, i, x in rows:
            k = k if keys else 0
            now = state.get(k, fold.start[0])
            state[k] = want[i] = now if x is None else float(fold.combine((np.float64(now),), (np.float64(x),))[0]) if not fold.whole else int(fold.combine((np.int64(now),), (np.int64(x),))[0])
        got = {r.i: r.y for r in scan(frame, name, [F.col("x")], ["i"], keys).collect()}
        assert len(got) == len(rows) and all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9) for i, w in want.items())


def test_affine_over_a_whole_frame(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0.9, 1.0, 0.0, -0.5]), rng.uniform(-1, 1)) for i in range(20_000)]
    got = {r.i: r.y for r in scan(spark.createDataFrame(rows, "i long, a double, b double").repartition(7), "affine", [F.col("a"), F.col("b")], ["i"]).collect()}
    h = 0.0
    for i, a, b in rows:
        h = a * h + b
        assert math.isclose(got[i], h, rel_tol=1e-9, abs_tol=1e-9)


def test_empty_frame_and_own_names(spark):
    frame = spark.createDataFrame([], "k string, i long, x double")
    assert scan(frame, "add", [F.col("x")], ["i"], ["k"]).count() == 0
    named = spark.createDataFrame([(1, 2.0), (2, 3.0)], "`a.b` long, y double")
    assert [r.y for r in scan(named, "add", [F.col("y")], ["a.b"]).orderBy("`a.b`").collect()] == [2.0, 5.0]


@pytest.mark.parametrize("name", ["scan_add", "scan_affine", "scan_affine_by_type", "searchsorted_table", "digitize_table_decreasing"])
def test_no_task_sees_everything(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranks_of_a_whole_frame(spark):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 1, 3])], "i long, x double")
    assert [(r.rank, r.position) for r in sort.argsort(frame, "x", "i").orderBy("rank").collect()] == [(0, 1), (1, 3), (2, 2), (3, 0), (4, 4)]
