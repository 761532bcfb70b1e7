import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import indexing as ix
from tessera.operators.indexing import Tensor, constant

A = np.arange(24).reshape(2, 3, 4)


@pytest.fixture(scope="module")
def a(spark):
    frame = spark.createDataFrame([(int(i), int(j), int(k), int(v)) for (i, j, k), v in np.ndenumerate(A)], "p long, q long, r long, `a.v` long")
    return Tensor(frame, A.shape, ("p", "q", "r"), "a.v")


def dense(t, fill=None):
    out = np.full(t.shape, np.nan if fill is None else fill)
    own = t.plain()
    for row in own.frame.collect():
        assert np.isnan(out[tuple(row[:-1])]) if fill is None else True
        out[tuple(row[:-1])] = row[-1]
    return out


def same(t, want):
    assert t.shape == np.shape(want)
    np.testing.assert_array_equal(dense(t), np.asarray(want, dtype=float))


READS = [
    (1, 2, -1), (0,), (slice(None), -1), (Ellipsis, slice(None, None, -2)), (slice(1, None), None, slice(-1, 0, -1)), (None, Ellipsis, None, 2),
    (slice(None), [0, 2], [1, 3]), (slice(None), [0, 2], slice(None)), ([0, 1], slice(None), [0, 1]), (0, slice(None), [0, 1]), ([1], [0, 1, 2]),
    (A % 5 == 0,), ([True, False],), ([1, 0],), ([[0, 1], [1, 0]],), (slice(None), [[0], [2]], [3, 0]), ([[1], [0]], slice(0, 2), [1, -1, 2]),
    (np.array([[True, False, True], [False, True, True]]), [1, 0, 3, 2]), (np.array([[True, False, True], [False, True, True]]), slice(1, None, 2)),
    (slice(None), np.array([False, True, True]), 3), (Ellipsis, [1, 1, 0]), (None, [1], None, slice(None), 2), (slice(5, 9),), (np.zeros((2, 3, 4), dtype=bool),), (-1, 0, [2, 3]),
]


@pytest.mark.parametrize("items", READS, ids=str)
def test_reads_as_numpy(a, items):
    same(a[items], A[items])


def test_random_basic_indices(a):
    rng = random.Random(4)
    for _ in range(12):
        items = tuple(rng.choice([rng.randrange(-n, n), slice(rng.choice([None, rng.randrange(-n - 1, n + 2)]), rng.choice([None, rng.randrange(-n - 1, n + 2)]), rng.choice([1, 2, -1, -2, 3]))]) for n in A.shape)
        same(a[items], A[items])


WRITES = [
    ((slice(None), 1), 1.0), (([0, 1], slice(None), [0, 2]), 5.0), ((A > 14,), -1.0), ((0, slice(None)), np.arange(4.0)), ((Ellipsis,), np.arange(3.0)[:, None]),
    (([0, 0, 0], [1, 1, 2]), np.arange(12.0).reshape(3, 4)), ((slice(None, None, -1), 2, slice(1, 3)), np.array([[7.0, 8.0], [9.0, 10.0]])), ((A % 7 == 1,), np.array([1.0, 2.0, 3.0, 4.0])),
    ((slice(None), [2, 0], None, slice(None)), np.array([[[50.0]], [[60.0]]])), ((-1, -1, -1), 99.0), (([True, False], [0, 2]), 3.0),
]


@pytest.mark.parametrize("items, value", WRITES, ids=str)
def test_writes_as_numpy(spark, a, items, value):
    want = A.astype(float)
    want[items] = value
    same(ix.put(a.map(lambda x: x.cast("double")), items, constant(spark, value) if isinstance(value, np.ndarray) else value), want)


def test_errors(a):
    for items in [(2, 0, 0), (0, 0, 0, 0), (slice(None), -4), (Ellipsis, Ellipsis), (np.ones((2, 2), dtype=bool),)]:
        with pytest.raises(IndexError):
            a[items]
    with pytest.raises(Exception, match="out of bounds"):
        a[[0, 2]].frame.collect()
    with pytest.raises(ValueError):
        ix.put(a, (0,), a)
    with pytest.raises(ValueError):
        ix.broadcast_to(a, (2, 3, 5))


def test_plans_of_reads(a):
    text = lambda t: t.frame._jdf.queryExecution().optimizedPlan().toString()
    basic = text(a[1:, ::-1, None, 2])
    assert "Join" not in basic and "Aggregate" not in basic
    assert text(a[[0, 1], :, [1, 2]]).count("Join") == 2  # one of the two arrays, one of picks and cells
    assert text(a[:, [0, 2]]).count("Join") == 1


@pytest.mark.parametrize("shapes", [((3,), (2, 3)), ((1, 3), (2, 1)), ((), (4,)), ((2, 1, 4), (3, 1), (4,)), ((1, 1), (1,)), ((0, 3), (1,))], ids=str)
def test_broadcasting_as_numpy(spark, shapes):
    arrays = [np.arange(np.prod(s)).reshape(s) + 10.0 * n for n, s in enumerate(shapes)]
    tensors = [constant(spark, x) for x in arrays]
    assert ix.broadcast_shapes(*shapes) == np.broadcast_shapes(*shapes)
    same(ix.apply(lambda *c: sum(c[1:], c[0]), *tensors), sum(arrays))
    for t, want in zip(ix.broadcast_arrays(*tensors), np.broadcast_arrays(*arrays)):
        same(t, want)
    want = [tuple(float(v) for v in row) for row in np.broadcast(*arrays)]
    assert [tuple(r)[1:] for r in sorted(ix.iterate(*tensors).collect())] == want


def test_shared_axes_never_meet_in_a_product(spark, a):
    large = spark.range(4000).select((F.col("id") % 50).alias("i"), (F.col("id") / 50).cast("long").alias("j"), F.rand(1).alias("x"))
    t = Tensor(large, (50, 80), ("i", "j"))
    plan = ix.apply(lambda x, y, z: x + y + z, t, t[:, :1], t[:1])
    assert "Cartesian" not in plan.frame._jdf.queryExecution().toString() and "NestedLoop" not in plan.frame._jdf.queryExecution().toString()


def test_outer_and_concatenate(spark, a):
    v = constant(spark, [1.0, 2.0])
    same(ix.outer(lambda x, y: x * y, v, a), np.multiply.outer([1.0, 2.0], A))
    same(ix.concatenate(a[0], a[:, 1], a[1, 2][None]), np.concatenate([A[0], A[:, 1], A[1, 2][None]]))


def test_shapes_that_do_not_fit():
    for shapes in itertools.permutations([(2, 3), (3, 2), (2,)], 2):
        try:
            want = np.broadcast_shapes(*shapes)
        except ValueError:
            with pytest.raises(ValueError):
                ix.broadcast_shapes(*shapes)
        else:
            assert ix.broadcast_shapes(*shapes) == want


def test_sparse_and_empty(spark):
    t = Tensor(spark.createDataFrame([(0, 1, 5.0), (3, 0, None)], "i long, j long, x double"), (4, 2), ("i", "j"))
    assert sorted(map(tuple, t[::-1].frame.collect())) == [(0, 0, None), (3, 1, 5.0)]
    assert t[1:3].frame.count() == 0 and t[[]].shape == (0, 2) and t[[]].frame.count() == 0
    assert {tuple(r) for r in ix.put(t, (3,), 2.0).frame.collect()} == {(0, 1, 5.0), (3, 0, 2.0)}
