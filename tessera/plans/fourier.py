"""Queries of Fourier transforms of the embeddings; the SQL sums up the definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fourier

QUERIES, ORACLES = {}, {}
_X = "(SELECT vec_id, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings)"
#: The first 33 numbers with the last 33 in reverse as imaginary parts.
_Z = "(SELECT vec_id, k, embedding[k + 1]::DOUBLE AS re, embedding[64 - k]::DOUBLE AS im FROM embeddings, range(33) r(k))"


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _numbers(f):
    """Transforms in rows: (vec_id, k, re, im), or (vec_id, k, y) where they are real."""
    rows = f.select("vec_id", F.posexplode("y").alias("k", "y"))
    if rows.schema["y"].dataType.simpleString() == "double":
        return rows.withColumn("y", F.round("y", 5) + 0.0)
    return rows.select("vec_id", "k", (F.round("y.re", 5) + 0.0).alias("re"), (F.round("y.im", 5) + 0.0).alias("im"))


def _add(name, transform, sql, prepare=lambda f: f, shape=None, norm="backward"):
    QUERIES[name] = lambda spark, sf_dir: _numbers(fourier.transform(prepare(_embeddings(spark, sf_dir)), transform, "v", shape, norm))
    ORACLES[name] = sql


def _sums(angle, count, sign, scale="1", weight="1"):
    """Sums of x times cos and sin of ``angle`` over n, for k below ``count``."""
    return f"""SELECT vec_id, k::INTEGER AS k, round(sum({weight} * x * cos({angle})) * {scale}, 5) + 0.0 AS re, round({sign} * sum({weight} * x * sin({angle})) * {scale}, 5) + 0.0 AS im
    FROM {_X}, range({count}) r(k) GROUP BY ALL"""


_LINE = "2 * pi() * k * n / 64"
_PLANE = "2 * pi() * ((k // 8) * (n // 8) + (k % 8) * (n % 8)) / 8"
_HALF_PLANE = "2 * pi() * ((k // 5) * (n // 8) + (k % 5) * (n % 8)) / 8"
_CUBE = "2 * pi() * ((k // 16) * (n // 16) + (k // 4 % 4) * (n // 4 % 4) + (k % 4) * (n % 4)) / 4"
_HALF_CUBE = "2 * pi() * ((k // 12) * (n // 16) + (k // 3 % 4) * (n // 4 % 4) + (k % 3) * (n % 4)) / 4"
_add("fft", "fft", _sums(_LINE, 64, -1))
_add("fft_ortho", "fft", _sums(_LINE, 64, -1, "0.125"), norm="ortho")
_add("fft_forward", "fft", _sums(_LINE, 64, -1, "(1 / 64e0)"), norm="forward")
_add("ifft", "ifft", _sums(_LINE, 64, 1, "(1 / 64e0)"))
_add("rfft", "rfft", _sums(_LINE, 33, -1))
_add("ihfft", "ihfft", _sums(_LINE, 33, 1, "(1 / 64e0)"))
_add("fft2", "fft2", _sums(_PLANE, 64, -1), shape=(8, 8))
_add("ifft2", "ifft2", _sums(_PLANE, 64, 1, "(1 / 64e0)"), shape=(8, 8))
_add("rfft2", "rfft2", _sums(_HALF_PLANE, 40, -1), shape=(8, 8))
_add("fftn", "fftn", _sums(_CUBE, 64, -1), shape=(4, 4, 4))
_add("ifftn", "ifftn", _sums(_CUBE, 64, 1, "(1 / 64e0)"), shape=(4, 4, 4))
_add("rfftn", "rfftn", _sums(_HALF_CUBE, 48, -1), shape=(4, 4, 4))

_halves = lambda f: f.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(32)), lambda k: F.struct(F.get("v", k).alias("re"), F.get("v", 63 - k).alias("im"))).alias("v"))
for _name, _sign, _scale in (("irfft", "-", "64e0"), ("hfft", "+", "1")):
    _add(_name, _name, f"SELECT vec_id, n::INTEGER AS k, round(sum(CASE WHEN k IN (0, 32) THEN re * cos(pi() * k * n / 32) ELSE 2 * (re * cos(pi() * k * n / 32) {_sign} im * sin(pi() * k * n / 32)) END) / {_scale}, 5) + 0.0 AS y FROM {_Z}, range(64) r(n) GROUP BY ALL", _halves)
# Inverses of real transforms give back what was there.
for _name, _of, _shape in (("irfft2", "rfft2", (8, 8)), ("irfftn", "rfftn", (4, 4, 4))):
    _add(_name, _name, f"SELECT vec_id, n::INTEGER AS k, round(x, 5) + 0.0 AS y FROM {_X}", lambda f, of=_of, shape=_shape: fourier.transform(f, of, "v", shape).select("vec_id", F.col("y").alias("v")), _shape)
