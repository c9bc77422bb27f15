"""Flows of a stream of trips: event-time windows with a watermark, and points to trips per user.

Row numbers need all rows, so streamed flows are named by a hash of their keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import h3bits

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Window width, and the offset that starts weeks on Monday (1970-01-01 was a Thursday).
WINDOWS = {"hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("7 days", "4 days")}
PAIR_SCHEMA = "user_id string, origin_time timestamp, origin_latitude double, origin_longitude double, destination_time timestamp, destination_latitude double, destination_longitude double"
_STATE = "time timestamp, latitude double, longitude double"


def windowed_flows(trips: DataFrame, *, grain: str = "hour", resolution: int = 8, lateness: str = "10 minutes", group_by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and weights of flows for each window; works for streams (append mode) and tables alike."""
    width, offset = WINDOWS[grain]
    cell = lambda e: F.coalesce(h3bits.parent(F.col(f"{e}_h3_index"), resolution), F.col(f"{e}_h3_index")).alias(f"{e}_h3_index")
    weight = F.coalesce(F.col("trip_weight").cast("double"), F.lit(0.0)) if "trip_weight" in trips.columns else F.lit(1.0)
    rows = trips.filter("origin_h3_index IS NOT NULL AND destination_h3_index IS NOT NULL").withWatermark("origin_time_utc", lateness)
    window = F.window("origin_time_utc", width, width, offset) if offset != "0 seconds" else F.window("origin_time_utc", width)
    out = rows.groupBy(window.alias("w"), cell("origin"), cell("destination"), *group_by).agg(F.count(F.lit(1)).alias("flow_count"), F.sum(weight).alias("flow_value"))
    keys = ["origin_h3_index", "destination_h3_index", *group_by]
    name = F.format_string("flow_%016x", F.xxhash64(F.col("w.start"), *keys))
    return out.select(name.alias("flow_id"), *keys, F.col("w.start").alias("window_start_utc"), F.col("w.end").alias("window_end_utc"), "flow_count", "flow_value")


def streamed_pairs(points: DataFrame, *, lateness: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Each point of a user with the one before, across batches; a user's last point is kept
    until the watermark is `idle_ms` past it."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["time_utc", "point_id"])
        last = state.getOption
        out = []
        for r in rows.itertuples(index=False):
            now = (r.time_utc, float(r.latitude), float(r.longitude))
            if last is not None and last[0] <= now[0]:
                out.append((key[0], *last, *now))
            last = now if last is None or last[0] <= now[0] else last
        state.update(last)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(last[0]).timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        names = [c.split()[0] for c in PAIR_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names)

    rows = points.select("user_id", "point_id", "time_utc", "latitude", "longitude").withWatermark("time_utc", lateness)
    return rows.groupBy("user_id").applyInPandasWithState(run, PAIR_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
