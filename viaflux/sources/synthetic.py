"""Seeded synthetic trips of any size, with chosen defects. Rows follow from their number and the seed alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SyntheticOptions:
    rows: int = 1000
    seed: int = 0
    users: int = 100
    #: tier_1 has UTC times, tier_2 local HH:MM texts, tier_3 none.
    tier: str = "tier_1"
    #: number, dot, comma, dm, dms, or mixed texts.
    coordinates: str = "number"
    null_ratio: float = 0.0
    duplicate_ratio: float = 0.0
    #: Share of weights that are no numbers, and of trips that end before they start.
    corrupt_ratio: float = 0.0
    centre: tuple[float, float] = (-70.65, -33.45)
    spread: float = 0.2
    start: str = "2026-01-01"
    days: int = 28
    modes: tuple[str, ...] = ("bus", "metro", "walk", "car")
    purposes: tuple[str, ...] = ("work", "education", "shopping", "home")


def unit(seed: int, name: str, *keys: Column) -> Column:
    """A number in [0, 1) from the seed, a name and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _coordinate(value: Column, kind: str, positive: str, negative: str) -> Column:
    side = F.when(value < 0, negative).otherwise(positive)
    a = F.abs(value)
    degrees, minutes = F.floor(a), (a - F.floor(a)) * 60
    dm = F.format_string("%d° %.6f' %s", degrees, minutes, side)
    dms = F.format_string("%d° %d' %.4f\" %s", degrees, F.floor(minutes), (minutes - F.floor(minutes)) * 60, side)
    dot = F.format_string("%.8f", value)
    return {"number": value, "dot": dot, "comma": F.replace(dot, F.lit("."), F.lit(",")), "dm": dm, "dms": dms}[kind]


def trips(spark: SparkSession, options: SyntheticOptions | None = None, partitions: int | None = None) -> DataFrame:
    """A raw table of trips; nothing but row numbers is made on the driver."""
    o = options or SyntheticOptions()
    df = spark.range(0, o.rows, 1, partitions) if partitions else spark.range(o.rows)
    # a duplicate repeats the row before it
    copied = (unit(o.seed, "copy", F.col("id")) < o.duplicate_ratio) & (F.col("id") > 0)
    k = F.when(copied, F.col("id") - 1).otherwise(F.col("id"))
    df = df.select(k.alias("k"), F.col("id"))
    u = lambda name: unit(o.seed, name, F.col("k"))
    pick = lambda values, name: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u(name) * len(values)) + 1).cast("int"))
    hole = lambda c, name: F.when(u(f"null {name}") >= o.null_ratio, c)
    columns: dict[str, Column] = {"movement_id": F.concat(F.lit("s"), F.col("k").cast("string")), "user_id": F.concat(F.lit("u"), F.floor(u("user") * o.users).cast("string"))}
    for end in ("origin", "destination"):
        for axis, centre, sides in (("longitude", o.centre[0], "EW"), ("latitude", o.centre[1], "NS")):
            value = F.lit(centre) + (u(f"{end} {axis} 1") + u(f"{end} {axis} 2") - 1) * o.spread
            if o.coordinates == "mixed":
                kinds = ("dot", "comma", "dm", "dms")
                which = F.floor(u(f"{end} format") * len(kinds))
                shown = F.coalesce(*[F.when(which == i, _coordinate(value, kind, *sides)) for i, kind in enumerate(kinds)])
            else:
                shown = _coordinate(value, o.coordinates, *sides)
            columns[f"{end}_{axis}"] = hole(shown, end)  # both axes of an end are missing together
    begin = F.unix_seconds(F.lit(o.start).cast("timestamp")) + F.floor(u("time") * o.days * 86400)
    length = F.floor(300 + u("length") * 5400) * F.when(u("corrupt time") < o.corrupt_ratio, -1).otherwise(1)
    times = {"origin": F.timestamp_seconds(begin), "destination": F.timestamp_seconds(begin + length)}
    for end, t in times.items():
        if o.tier == "tier_1":
            columns[f"{end}_time_utc"] = t
        elif o.tier == "tier_2":
            columns[f"{end}_time_local_hhmm"] = F.date_format(t, "HH:mm")
    columns["mode"], columns["purpose"] = pick(o.modes, "mode"), hole(pick(o.purposes, "purpose"), "purpose")
    weight = F.round(u("weight") * 10 + 0.1, 3)
    columns["trip_weight"] = F.when(u("corrupt weight") < o.corrupt_ratio, F.lit("n/d")).otherwise(weight.cast("string")) if o.corrupt_ratio else weight
    return df.select(*[c.alias(n) for n, c in columns.items()])
