"""Streaming forms of ordered operations: windows over event time, and running sums that keep state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_sums(stream: DataFrame, time: str, value: str, keys: list[str], width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Sums and counts over tumbling (or sliding) windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def session_sums(stream: DataFrame, time: str, value: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def running_scan(stream: DataFrame, key: str, order: str, value: str, decay: float = 1.0) -> DataFrame:
    """h = decay * h + x for each key over all batches (decay 1: a running sum); state is one number for each key."""
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {order} {stream.schema[order].dataType.simpleString()}, h double"

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        h = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for x in rows[value].fillna(0.0):
            h = decay * h + float(x)
            out.append(h)
        state.update((h,))
        yield pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "h": out})

    return stream.groupBy(key).applyInPandasWithState(step, schema, "h double", "append", GroupStateTimeout.NoTimeout)
