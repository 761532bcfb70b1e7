"""Queries of places among a table of edges, and of running folds over whole tables and hot keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import edges, sort
from tessera.operators.scans import scan

QUERIES, ORACLES = {}, {}


def _add(name, run, sql):
    QUERIES[name] = lambda spark, sf_dir: run(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem")))
    ORACLES[name] = sql


# Every event's value among the prices of all line items (with repeats), scaled to the values' size.
_EDGES = "SELECT floor(l_extendedprice) / 256 AS e FROM lineitem"
_edges = lambda lines: lines.select((F.floor("l_extendedprice") / 256).alias("e"))
_PLACES = """
SELECT event_id, {place} AS {name} FROM (
  SELECT event_id, v, sum(n) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY v) AS same, sum(n) OVER () AS every
  FROM (SELECT event_id, value AS v, 0 AS n FROM events UNION ALL SELECT NULL, e, 1 FROM (EDGES))) WHERE event_id IS NOT NULL
""".replace("EDGES", _EDGES)
for _name, _right, _sql in (("searchsorted_table", False, "(upto - same)::BIGINT"), ("searchsorted_table_right", True, "upto::BIGINT")):
    _add(_name, lambda e, l, r=_right: edges.searchsorted(e, _edges(l), "value", "e", r).select("event_id", "place"), _PLACES.format(place=_sql, name="place"))
for _name, _options, _sql in (
    ("digitize_table", {}, "upto::BIGINT"),
    ("digitize_table_right", {"right": True}, "(upto - same)::BIGINT"),
    ("digitize_table_decreasing", {"decreasing": True}, "(every - upto)::BIGINT"),
    ("digitize_table_decreasing_right", {"decreasing": True, "right": True}, "(every - upto + same)::BIGINT"),
):
    _add(_name, lambda e, l, o=_options: edges.digitize(e, _edges(l), "value", "e", **o).select("event_id", "bin"), _PLACES.format(place=_sql, name="bin"))

# Folds over all events in order of time, and within the few event types.
_ORDER = ["ts", "event_id"]
_ALL, _TYPE = "OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_NEAR_ONE, _BITS = "1 + (event_id % 5 - 2) / 1000e0", "event_id * 7919 % 1048576"
_FOLDS = {
    "add": ("value", "sum(value) {w}"),
    "multiply": (_NEAR_ONE, f"exp(sum(ln({_NEAR_ONE})) {{w}})"),
    "maximum": ("value", "max(value) {w}"),
    "minimum": ("value", "min(value) {w}"),
    "logaddexp": ("value / 100", "ln(sum(exp(value / 100)) {w})"),
    "add_integer": ("event_id", "(sum(event_id) {w})::BIGINT"),
    "maximum_integer": (_BITS, f"max({_BITS}) {{w}}"),
    "minimum_integer": (_BITS, f"min({_BITS}) {{w}}"),
    "bitwise_and": (_BITS, f"bit_and({_BITS}) {{w}}"),
    "bitwise_or": (_BITS, f"bit_or({_BITS}) {{w}}"),
    "bitwise_xor": (_BITS, f"bit_xor({_BITS}) {{w}}"),
}


def _folded(events, name, element, keys):
    made = scan(events.select("event_id", "ts", "event_type", F.expr(element).alias("v")), name, [F.col("v")], _ORDER, keys)
    return made.select("event_id", F.round("y", 5).alias("y") if dict(made.dtypes)["y"] == "double" else "y")


for _name, (_element, _sql) in _FOLDS.items():
    for _keys, _window, _end in (((), _ALL, ""), (("event_type",), _TYPE, "_by_type")):
        _whole = "integer" in _name or "bitwise" in _name
        _stated = _sql.format(w=_window)
        _add(f"scan_{_name}{_end}", lambda e, _, n=_name, x=_element, k=_keys: _folded(e, n, x, k), f"SELECT event_id, {_stated if _whole else f'round({_stated}, 5)'} AS y FROM events")
_ODD = 0.7071067811865476  # no value then stands halfway between two roundings
# A row that is 60 or more back has no weight left in the last digit at a decay of one half.
for _end, _keys, _part in (("", (), ""), ("_by_type", ("event_type",), "PARTITION BY event_type ")):
    _add(
        f"scan_affine{_end}",
        lambda e, _, k=_keys: scan(e.select("event_id", "ts", "event_type", "value"), "affine", [F.lit(0.5), F.col("value")], _ORDER, k).select("event_id", F.round(F.col("y") * _ODD, 5).alias("y")),
        f"SELECT event_id, round(list_sum([v[len(v) - i] * pow(0.5, i) FOR i IN range(len(v))]) * {_ODD}, 5) AS y FROM (SELECT event_id, list(value) OVER ({_part}ORDER BY ts, event_id ROWS 70 PRECEDING) AS v FROM events)",
    )
_add("argsort_all", lambda e, _: sort.argsort(e, "value", "event_id"), "SELECT (row_number() OVER (ORDER BY value, event_id) - 1)::BIGINT AS rank, event_id AS position FROM events")
_add("lexsort_all", lambda e, _: sort.lexsort(e, ["value", "event_type"], "event_id"), "SELECT (row_number() OVER (ORDER BY event_type, value, event_id) - 1)::BIGINT AS rank, event_id AS position FROM events")
