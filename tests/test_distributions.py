import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.distributions import Draws, permutation

#: draw -> (mean, variance) of its distribution.
MOMENTS = {
    "uniform": (lambda d: d.uniform(2.0, 4.0), 3.0, 1 / 3),
    "normal": (lambda d: d.normal(1.0, 2.0), 1.0, 4.0),
    "gamma": (lambda d: d.gamma(2.5, 2.0), 5.0, 10.0),
    "gamma_below_one": (lambda d: d.standard_gamma(0.5), 0.5, 0.5),
    "beta": (lambda d: d.beta(2.0, 3.0), 0.4, 0.04),
    "wald": (lambda d: d.wald(2.0, 3.0), 2.0, 8 / 3),
    "chisquare": (lambda d: d.chisquare(4), 4.0, 8.0),
    "noncentral_chisquare": (lambda d: d.noncentral_chisquare(3, 2.0), 5.0, 14.0),
    "poisson": (lambda d: d.poisson(6.0), 6.0, 6.0),
    "binomial": (lambda d: d.binomial(20, 0.3), 6.0, 4.2),
    "negative_binomial": (lambda d: d.negative_binomial(4, 0.4), 6.0, 15.0),
    "geometric": (lambda d: d.geometric(0.25), 4.0, 12.0),
    "hypergeometric": (lambda d: d.hypergeometric(12, 8, 5), 3.0, 5 * 0.6 * 0.4 * 15 / 19),
    "triangular": (lambda d: d.triangular(0.0, 1.0, 5.0), 2.0, (25 + 1 - 5) / 18),
    "logseries": (lambda d: d.logseries(0.5), 0.5 / 0.5 / math.log(2), 2 / math.log(2) - 1 / math.log(2) ** 2),
    "zipf": (lambda d: d.zipf(5.0), 1.0823232 / 1.0369278, None),
    "vonmises": (lambda d: F.cos(d.vonmises(0.0, 2.0)), 0.6977746, None),
    "multinomial": (lambda d: F.get(d.multinomial(10, [0.2, 0.5, 0.3]), F.lit(1)), 5.0, 2.5),
    "urn": (lambda d: F.get(d.multivariate_hypergeometric([6, 4], 5), F.lit(0)), 3.0, 5 * 0.6 * 0.4 * 5 / 9),
}
N = 8_000


@pytest.mark.parametrize("name", MOMENTS)
def test_moments(spark, name):
    draw, mean, variance = MOMENTS[name]
    row = spark.range(N).select(draw(Draws(F.col("id"), 3)).cast("double").alias("y")).agg(F.avg("y"), F.var_samp("y"), F.count("y")).first()
    assert row[2] == N
    assert abs(row[0] - mean) < 5 * math.sqrt((variance or row[1]) / N)
    if variance:
        assert abs(row[1] / variance - 1) < 0.2


def test_partitions_and_null_keys(spark):
    keys = spark.createDataFrame([(1,), (None,), (2,), (1,)], "k long")
    draw = lambda f: sorted(f.select("k", Draws(F.col("k"), 1).normal().alias("y")).collect(), key=str)
    once, again = draw(keys.coalesce(1)), draw(keys.repartition(3))
    assert once == again and {r.y for r in once if r.k is None} == {None} and len({r.y for r in once}) == 3
    assert keys.limit(0).select(Draws(F.col("k")).poisson(2.0)).collect() == []


def test_permutation_has_every_place_once(spark):
    assert sorted(r.pos for r in permutation(spark.range(500), "id", 7).collect()) == list(range(500))
