"""Queries of Fourier transforms over all events' values, in order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import spectra
from tessera.operators.window import with_positions

QUERIES, ORACLES = {}, {}

_V = "(SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, count(*) OVER () AS n, value - 50 AS x FROM events)"
_K = "(SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events)"
_SUM = f"SELECT k AS pos, sum(x * cos(2 * pi() * ((k * t) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM {_V} v, {_K} k"


def _add(name, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(with_positions(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "ts", "value - 50 AS x"), ["ts", "event_id"]))
    ORACLES[name] = sql


_rounded = lambda frame, digits=3: frame.select("pos", *[(F.round(c, digits) + 0.0).alias(c) for c in frame.columns if c != "pos"])
_add("fft_vector", lambda v: _rounded(spectra.transform(v, v["x"])), f"SELECT pos, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM ({_SUM} GROUP BY k)")
_add("rfft_vector", lambda v: _rounded(spectra.rfft(v, v["x"])), f"SELECT pos, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM ({_SUM} WHERE 2 * k <= n GROUP BY k)")
_add("fft_vector_ortho", lambda v: _rounded(spectra.transform(v, v["x"], norm="ortho"), 4), f"SELECT pos, round(re / sqrt((SELECT count(*) FROM events)), 4) + 0.0 AS re, round(im / sqrt((SELECT count(*) FROM events)), 4) + 0.0 AS im FROM ({_SUM} GROUP BY k)")
_add("ifft_vector", lambda v: (lambda f: _rounded(spectra.transform(f, f["re"], f["im"], inverse=True), 6))(spectra.transform(v, v["x"])), f"SELECT t AS pos, round(x, 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM {_V}")
_add("irfft_vector", lambda v: _rounded(spectra.irfft(spectra.rfft(v, v["x"]), v.count()), 6), f"SELECT t AS pos, round(x, 6) + 0.0 AS x FROM {_V}")
# The values' energy is that of the transform over n.
_add("fft_vector_energy", lambda v: spectra.transform(v, v["x"], norm="ortho").agg(F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 1000, 3).alias("energy")), f"SELECT round(sum(x * x) / 1000, 3) AS energy FROM {_V}")
