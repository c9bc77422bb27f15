"""Profiles of three kinds of raw sources: smart-card trips in stages, household surveys, and check-ins at venues."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, prep
from ..operators.importing import ImportOptions, with_row_number
from . import files
from .profiles import SourceProfile

#: What the columns of stage 1, 2, 3 and 4 end with.
STAGE_ENDINGS = ("1era", "2da", "3era", "4ta")
#: What tells the columns of a stage's start and end.
BOARDING, ALIGHTING = "subida", "bajada"


@dataclass(frozen=True)
class StageLayout:
    """Columns of a wide trip: those of the trip, and those of each stage in order."""

    trip_level: tuple[str, ...]
    stages: tuple[tuple[str, ...], ...]


def layout_of(raw: Mapping[str, Any] | None) -> StageLayout:
    """A layout from its keys `trip_level`, `stage_1`, `stage_2` and so on; missing keys are empty."""
    raw = raw or {}
    numbered = sorted((int(k.removeprefix("stage_")), k) for k in raw if re.fullmatch(r"stage_[0-9]+", k))
    return StageLayout(tuple(raw.get("trip_level") or ()), tuple(tuple(raw[k] or ()) for _, k in numbered))


def read_layout(spark: SparkSession, path: str) -> StageLayout:
    """A layout file: JSON, or YAML where a parser is installed."""
    text = files.FileSystem(spark, path).read_text(path)
    if path.endswith(".json"):
        return layout_of(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path} is YAML, whose parser isn't installed; write the layout as JSON") from e
    return layout_of(yaml.safe_load(text))


def stage_stem(column: str) -> str:
    """A stage column's name without the number of its stage."""
    endings = "|".join(STAGE_ENDINGS)
    return re.sub(rf"_(?:(?:{endings})(?:_etapa)?|[1-4])$", "", column)


def stage_count(df: DataFrame, layout: StageLayout, declared: str | None = None) -> Column:
    """The declared number of stages where it is one, else the last stage with a value."""
    present = lambda cols: reduce(lambda a, b: a | b, [prep.valid_or_null(F.col(f"`{c}`")).isNotNull() for c in cols], F.lit(False))
    held = [F.when(present([c for c in cols if c in df.columns]), i).otherwise(0) for i, cols in enumerate(layout.stages, 1)]
    found = F.greatest(F.lit(0), F.lit(0), *held)
    if declared is None or declared not in df.columns:
        return found
    n = F.floor(coerce.number(F.col(f"`{declared}`"), df.schema[declared].dataType))
    return F.when(n.between(0, len(layout.stages)), n.cast("int")).otherwise(found)


def smart_card_trips(
    df: DataFrame, stops: DataFrame, layout: StageLayout, *, stop: str, x: str = "x", y: str = "y", crs: str = "EPSG:5361", declared: str | None = "etapas", starts: str = f"paradero{BOARDING}", ends: str = f"paradero{ALIGHTING}"
) -> DataFrame:
    """A row for each trip: its own columns, first valid values of boarding, last valid ones of alighting, and degrees of both stops."""
    have = [[c for c in cols if c in df.columns] for cols in layout.stages]
    firsts: dict[str, list[str]] = {}
    lasts: dict[str, list[str]] = {}
    for column in [c for cols in have for c in cols]:
        for mark, into in ((BOARDING, firsts), (ALIGHTING, lasts)):
            if mark in column.lower():
                into.setdefault(stage_stem(column), []).append(column)
    col = lambda c: F.col(f"`{c}`")
    out = df.select(
        *[col(c) for c in layout.trip_level if c in df.columns],
        stage_count(df, layout, declared).alias("stages_found"),
        *[prep.first_valid(*map(col, cols)).alias(n) for n, cols in firsts.items()],
        *[prep.last_valid(*map(col, cols)).alias(n) for n, cols in lasts.items()],
    )
    for code, end in ((starts, BOARDING), (ends, ALIGHTING)):
        if code in out.columns:
            out = prep.locate_stops(out, code, stops, stop=stop, x=x, y=y, into=("_px", "_py"))
            out = prep.project_xy_to_latlon(out, "_px", "_py", crs=crs, lon=f"{end}_lon", lat=f"{end}_lat", status=None, zero_is_missing=False).drop("_px", "_py")
    return out


def household_trips(
    df: DataFrame,
    *,
    persons: DataFrame | None = None,
    person_keys: Sequence[str] = (),
    households: DataFrame | None = None,
    household_keys: Sequence[str] = (),
    codes: Mapping[str, DataFrame] | None = None,
    lists: Mapping[str, Mapping[str, str]] | None = None,
    coordinates: Mapping[tuple[str, str], tuple[str, str]] | None = None,
    crs: str = "EPSG:5361",
    weights: Sequence[str] = (),
    weight: str = "trip_weight_src",
) -> DataFrame:
    """Trips of a survey with attributes of person and household, labels for codes, degrees, and the first weight that is a number.

    `codes` gives a field's table, whose first column is the key and whose
    second is the label; `lists` the labels of fields that hold several codes;
    `coordinates` the pairs of projected columns, which go, and their degrees.
    """
    if persons is not None:
        df = prep.join_suffixed(df, persons, person_keys, "_person")
    if households is not None:
        df = prep.join_suffixed(df, households, household_keys, "_household")
    for field, table in (codes or {}).items():
        if field in df.columns:
            if len(table.columns) < 2:
                raise ValueError(f"the code table of {field!r} has no label column")
            order = df.columns
            df = prep.decode(df, field, table, table.columns[0], table.columns[1]).select(*[F.col(f"`{c}`") for c in order])
    for field, labels in (lists or {}).items():
        if field in df.columns:
            df = df.withColumn(field, F.nullif(prep.decode_list(F.col(f"`{field}`"), labels), F.lit("")))
    for (x, y), (lon, lat) in (coordinates or {}).items():
        if x in df.columns and y in df.columns:
            df = prep.project_xy_to_latlon(df, x, y, crs=crs, lon=lon, lat=lat, status=None).drop(x, y)
    have = [w for w in weights if w in df.columns]
    return df.withColumn(weight, prep.first_number(df, have)) if have else df


def checkin_trips(checkins: DataFrame, venues: DataFrame, zones: DataFrame, *, ring: str = "ring", user: str = "user_id", venue: str = "venue_id", time: str = "datetime", lon: str = "lon", lat: str = "lat", category: str = "category") -> DataFrame:
    """Each user's consecutive check-ins at venues inside the zones as trips, numbered by user and time.

    Venues without readable coordinates and check-ins without a user go. A venue
    with several rows takes the least of them.
    """
    at = {c: coerce.number(F.col(f"`{c}`"), venues.schema[c].dataType) for c in (lon, lat)}
    inside = prep.within_polygons(venues.select(venue, category, at[lon].alias(lon), at[lat].alias(lat)), lon, lat, zones.select(ring), ring)
    places = inside.groupBy(venue).agg(F.min(F.struct(lat, lon, category)).alias("_at")).select(venue, "_at.*")
    visits = checkins.filter(F.col(user).isNotNull()).select(user, venue, time).join(places, venue)
    pairs = prep.previous_rows(visits, user, time, [venue, lat, lon, category, time])
    ends = [F.col(f"{p}{c}").alias(f"{end}_{c}") for end, p in (("origin", "previous_"), ("destination", "")) for c in (lat, lon, time, category)]
    trips = pairs.select(user, *ends, F.col(venue).alias("_venue"))
    numbered = with_row_number(trips, "trip_id", [user, f"destination_{time}", "_venue"]).drop("_venue")
    return numbered.withColumn("movement_id_src", F.col("trip_id").cast("string"))


def smart_card_profile(stops: DataFrame, layout: StageLayout, name: str = "smart_card_trips", *, options: ImportOptions | None = None, fields: Mapping[str, str] | None = None, values: Mapping[str, Mapping[str, str]] | None = None, **step: Any) -> SourceProfile:
    """The profile of `smart_card_trips`; `step` goes to it."""
    return SourceProfile(name, "trips of smart cards, stages summed up and stops located", fields or {}, values or {}, options, lambda df: smart_card_trips(df, stops, layout, **step))


def household_profile(name: str = "household_trips", *, options: ImportOptions | None = None, fields: Mapping[str, str] | None = None, values: Mapping[str, Mapping[str, str]] | None = None, **step: Any) -> SourceProfile:
    """The profile of `household_trips`; `step` goes to it."""
    return SourceProfile(name, "trips of a household survey, decoded and projected", fields or {}, values or {}, options, lambda df: household_trips(df, **step))


def checkin_profile(venues: DataFrame, zones: DataFrame, name: str = "checkin_trips", *, options: ImportOptions | None = None, fields: Mapping[str, str] | None = None, values: Mapping[str, Mapping[str, str]] | None = None, **step: Any) -> SourceProfile:
    """The profile of `checkin_trips`; `step` goes to it."""
    defaults = {"movement_id": "movement_id_src", "origin_latitude": "origin_lat", "origin_longitude": "origin_lon", "destination_latitude": "destination_lat", "destination_longitude": "destination_lon"}
    return SourceProfile(name, "consecutive check-ins of users at venues inside zones", fields or defaults, values or {}, options, lambda df: checkin_trips(df, venues, zones, **step))
