"""Queries of random draws keyed by customers; the SQL works out the same uniforms and its own distribution functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions.distributions import TRIES, Draws, choice, permutation, permuted

QUERIES, ORACLES = {}, {}
SEED = 42


def u(stream=0, key="c_custkey"):
    number = f"({stream})::VARCHAR" if isinstance(stream, str) else f"'{stream}'"
    return f"((('0x' || substr(md5('{SEED}|' || {number} || '|' || {key}), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"


def normal(stream=0):
    following = f"{stream} + 1" if isinstance(stream, str) else stream + 1
    return f"(sqrt(-2 * ln({u(stream)})) * cos(2 * pi() * {u(following)}))"


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")


def _add(name, make, sql, digits=5, source="customer"):
    value = (lambda d: make(d)) if digits is None else (lambda d: F.round(make(d), digits) + 0.0)
    QUERIES[f"random_{name}"] = lambda spark, sf_dir: _customers(spark, sf_dir).select("c_custkey", value(Draws(F.col("c_custkey"), SEED)).alias("y"))
    ORACLES[f"random_{name}"] = f"SELECT c_custkey, {sql if digits is None else f'round({sql}, {digits}) + 0.0'} AS y FROM {source}"


for _name in ("rand", "random_sample", "ranf", "sample"):
    _add(_name, lambda d: d.random(), u(), 9)
_add("uniform", lambda d: d.uniform(-3.0, 5.0), f"-3 + 8 * {u()}", 8)
for _name, _low, _high, _closed in (("integers", -5, 20, False), ("randint", 0, 7, False), ("random_integers", 1, 6, True), ("tomaxint", 0, 1 << 31, False)):
    _add(_name, lambda d, a=_low, b=_high, c=_closed: d.integers(a, b, c), f"(floor({u()} * {_high - _low + _closed}) + {_low})::BIGINT", None)
_add("bytes", lambda d: F.lower(F.hex(d.bytes(20))), f"substr(md5('{SEED}|b0|' || c_custkey) || md5('{SEED}|b1|' || c_custkey), 1, 40)", None)
_add("standard_exponential", lambda d: d.exponential(), f"-ln({u()})")
_add("exponential_scaled", lambda d: d.exponential(2.0), f"-2 * ln({u()})")
for _name in ("standard_normal", "randn"):
    _add(_name, lambda d: d.normal(), normal())
_add("normal_scaled", lambda d: d.normal(3.0, 2.0), f"3 + 2 * {normal()}")
_add("lognormal", lambda d: d.lognormal(0.5, 0.25), f"exp(0.5 + 0.25 * {normal()})")
_add("standard_cauchy", lambda d: d.standard_cauchy(), f"tan(pi() * ({u()} - 0.5))", 3)
_add("laplace", lambda d: d.laplace(1.0, 2.0), f"CASE WHEN {u()} < 0.5 THEN 1 + 2 * ln(2 * {u()}) ELSE 1 - 2 * ln(2 - 2 * {u()}) END")
_add("logistic", lambda d: d.logistic(1.0, 2.0), f"1 + 2 * (ln({u()}) - ln(1 - {u()}))")
_add("gumbel", lambda d: d.gumbel(1.0, 2.0), f"1 - 2 * ln(-ln({u()}))")
_add("pareto", lambda d: d.pareto(3.0), f"exp(-ln({u()}) / 3) - 1")
_add("power", lambda d: d.power(3.0), f"exp(ln({u()}) / 3)")
_add("weibull", lambda d: d.weibull(1.5), f"exp(ln(-ln({u()})) / 1.5)")
_add("rayleigh", lambda d: d.rayleigh(2.0), f"2 * sqrt(-2 * ln({u()}))")
_add("triangular", lambda d: d.triangular(-1.0, 0.5, 4.0), f"CASE WHEN {u()} < 0.3 THEN -1 + sqrt({u()} * 7.5) ELSE 4 - sqrt((1 - {u()}) * 17.5) END")
_MIX = f"(SELECT c_custkey, 2 * pow({normal()}, 2) AS y0, {u(2)} AS v FROM customer)"
_add("wald", lambda d: d.wald(2.0, 3.0), "CASE WHEN v * (2 + x) <= 2 THEN x ELSE 4 / x END", source=f"(SELECT *, 2 + (y0 - sqrt(12 * y0 + y0 * y0)) / 3 AS x FROM {_MIX})")


def gamma(shape, stream=0):
    """The first of TRIES proposals that is accepted."""
    lifted = shape if shape >= 1 else shape + 1
    d = f"({lifted!r}::DOUBLE - 1 / 3e0)"
    at = f"{1000 + 100 * stream} + 3 * k"
    v = f"pow(1 + {normal(at)} / sqrt(9 * {d}), 3)"
    ok = f"CASE WHEN {v} > 0 THEN ln({u(at + ' + 2')}) < pow({normal(at)}, 2) / 2 + {d} * (1 - {v} + ln({v})) ELSE false END"
    drawn = f"list_extract(list_filter([CASE WHEN {ok} THEN {d} * {v} END FOR k IN range({TRIES})], lambda x: x IS NOT NULL), 1)"
    return f"({drawn})" if shape >= 1 else f"({drawn} * pow({u(900 + stream)}, 1 / {shape!r}::DOUBLE))"


_add("standard_gamma", lambda d: d.standard_gamma(2.5), gamma(2.5))
_add("standard_gamma_below_one", lambda d: d.standard_gamma(0.4), gamma(0.4))
_add("gamma_scaled", lambda d: d.gamma(1.5, 3.0), f"3 * {gamma(1.5)}")
_add("chisquare", lambda d: d.chisquare(5), f"2 * {gamma(2.5)}")
_add("beta", lambda d: d.beta(2.0, 3.0), f"{gamma(2.0)} / ({gamma(2.0)} + {gamma(3.0, 1)})")
_add("f", lambda d: d.f(4, 9), f"(2 * {gamma(2.0)} / 4) / (2 * {gamma(4.5, 1)} / 9)")
_add("standard_t", lambda d: d.standard_t(6), f"{normal()} / sqrt(2 * {gamma(3.0)} / 6)")
_add("noncentral_chisquare", lambda d: d.noncentral_chisquare(5, 4.0), f"pow({normal()} + 2, 2) + 2 * {gamma(2.0)}")
_add("noncentral_f", lambda d: d.noncentral_f(5, 8, 4.0), f"((pow({normal()} + 2, 2) + 2 * {gamma(2.0)}) / 5) / (2 * {gamma(4.0, 1)} / 8)")
_add("dirichlet", lambda d: F.get(d.dirichlet([2.0, 3.0, 1.5]), F.lit(1)), f"{gamma(3.0, 1)} / ({gamma(2.0)} + {gamma(3.0, 1)} + {gamma(1.5, 2)})")
_add("multivariate_normal", lambda d: F.get(d.multivariate_normal([1.0, -1.0], [[2.0, 0.0], [0.5, 1.5]]), F.lit(1)), f"-1 + 0.5 * {normal()} + 1.5 * {normal(2)}")


def counted(name, make, cells, count, first=0):
    """A discrete distribution: the SQL adds up the chances ``cells`` of k = 0, 1, ... itself."""
    bounds = f"(SELECT list(c ORDER BY k) AS cdf FROM (SELECT k, sum(p) OVER (ORDER BY k) AS c FROM (SELECT k, {cells} AS p FROM range({count}) r(k))))"
    _add(name, make, f"(len(list_filter(cdf, lambda c: c < {u()})) + {first})::INTEGER", None, f"customer, {bounds}")


counted("poisson_table", lambda d: d.poisson(3.5), "exp(k * ln(3.5) - 3.5 - lgamma(k + 1))", int(3.5 + 12 * math.sqrt(3.5) + 25) - 1)
counted("binomial", lambda d: d.binomial(12, 0.3), "exp(lgamma(13) - lgamma(k + 1) - lgamma(13 - k)) * pow(0.3, k) * pow(0.7, 12 - k)", 12)
counted("negative_binomial", lambda d: d.negative_binomial(3, 0.4), "(k + 1) * (k + 2) / 2 * pow(0.4, 3) * pow(0.6, k)", 160)
counted("hypergeometric", lambda d: d.hypergeometric(7, 9, 6), "exp(lgamma(8) - lgamma(k + 1) - lgamma(8 - k) + lgamma(10) - lgamma(7 - k) - lgamma(4 + k) - lgamma(17) + lgamma(7) + lgamma(11))", 6)
_add("geometric", lambda d: d.geometric(0.25), f"greatest(ceil(ln({u()}) / ln(0.75)), 1)::INTEGER", None)
_add("logseries", lambda d: d.logseries(0.6), f"CASE WHEN {u(1)} >= 0.6 THEN 1 ELSE floor(1 + ln({u(1)}) / ln(1 - pow(0.4, {u()}))) END::BIGINT", None)
_X = f"floor(pow({u('1000 + 2 * k')}, -1 / 1.5e0))"
_add("zipf", lambda d: d.zipf(2.5), f"list_extract(list_filter([CASE WHEN {u('1001 + 2 * k')} * {_X} * (pow(1 + 1 / {_X}, 1.5) - 1) / (pow(2, 1.5) - 1) <= pow(1 + 1 / {_X}, 1.5) / pow(2, 1.5) THEN {_X} END FOR k IN range({TRIES})], lambda x: x IS NOT NULL), 1)::BIGINT", None)
_TAU = 1 + math.sqrt(17)
_RHO = (_TAU - math.sqrt(2 * _TAU)) / 4
_R = (1 + _RHO * _RHO) / (2 * _RHO)
_ANGLES = f"(SELECT c_custkey, list_extract([CASE WHEN p[1] < 0 THEN -acos(p[2]) ELSE acos(p[2]) END FOR p IN [[t[3] - 0.5, (1 + {_R!r} * t[1]) / ({_R!r} + t[1]), t[2]] FOR t IN [[cos(pi() * {u('1000 + 3 * k')}), {u('1001 + 3 * k')}, {u('1002 + 3 * k')}] FOR k IN range({TRIES})]] IF 2 * ({_R!r} - p[2]) * (2 - 2 * ({_R!r} - p[2])) >= p[3] OR ln(2 * ({_R!r} - p[2]) / p[3]) + 1 - 2 * ({_R!r} - p[2]) >= 0], 1) + 0.5 AS a FROM customer)"
_add("vonmises", lambda d: d.vonmises(0.5, 2.0), "CASE WHEN a >= pi() THEN a - 2 * pi() WHEN a < -pi() THEN a + 2 * pi() ELSE a END", source=_ANGLES)
_CELLS = f"[CASE WHEN v < 0.2 THEN 0 WHEN v < 0.7 THEN 1 ELSE 2 END FOR v IN [{u('k')} FOR k IN range(10)]]"
_add("multinomial", lambda d: F.get(d.multinomial(10, [0.2, 0.5, 0.3]), F.lit(1)), f"len(list_filter({_CELLS}, lambda x: x = 1))::INTEGER", None)
_URN = f"[[{u('k')}, CASE WHEN k < 3 THEN 0e0 WHEN k < 7 THEN 1e0 ELSE 2e0 END] FOR k IN range(9)]"
_add("multivariate_hypergeometric", lambda d: F.get(d.multivariate_hypergeometric([3, 4, 2], 5), F.lit(1)), f"len(list_filter(list_sort({_URN})[1:5], lambda x: x[2] = 1))::INTEGER", None)
_add("choice_weighted", lambda d: d.cells([0.1, 0.6, 0.3]), f"CASE WHEN {u()} <= 0.1 THEN 0 WHEN {u()} <= 0.7 THEN 1 ELSE 2 END", None)
_add("spawn", lambda d: d.spawn(3).random(), u(0, "(c_custkey || '/3')"), 9)

QUERIES["random_choice"] = lambda spark, sf_dir: choice(_customers(spark, sf_dir), "c_custkey", 20, SEED).select("c_custkey")
ORACLES["random_choice"] = f"SELECT c_custkey FROM customer ORDER BY {u()}, c_custkey LIMIT 20"
for _name in ("permutation", "shuffle"):
    QUERIES[f"random_{_name}"] = lambda spark, sf_dir: permutation(_customers(spark, sf_dir), "c_custkey", SEED).select("c_custkey", "pos")
    ORACLES[f"random_{_name}"] = f"SELECT c_custkey, row_number() OVER (ORDER BY {u()}, c_custkey) - 1 AS pos FROM customer"
QUERIES["random_permuted"] = lambda spark, sf_dir: permuted(_customers(spark, sf_dir), "c_custkey", ["c_nationkey"], SEED).select("c_custkey", "pos")
ORACLES["random_permuted"] = f"SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY {u()}, c_custkey) - 1)::INTEGER AS pos FROM customer"
