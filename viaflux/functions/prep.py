"""Building blocks of preprocessing: code tables, stages, first valid values, zones, projection, indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import coerce
from .geo import TransverseMercator, in_bbox, in_polygon

#: Texts that stand for a missing value.
NULL_LIKE = ("", "-", "nan", "none", "null", "n/a", "na")
WGS84_INVERSE_FLATTENING = 298.257223563
#: Grids on the GRS80 ellipsoid by EPSG code, with zone and whether it is south.
GRS80_GRIDS = {5361: (19, True), 5362: (18, True), 31978: (18, True), 31979: (19, True), 31981: (21, True), 31983: (23, True)}


def projection(crs: str) -> TransverseMercator:
    """The grid of an EPSG code: UTM on WGS84 (326zz north, 327zz south), on ETRS89 (258zz), or one of `GRS80_GRIDS`."""
    try:
        code = int(str(crs).strip().upper().removeprefix("EPSG:"))
    except ValueError:
        code = 0
    family, zone = divmod(code, 100)
    inverse = 298.257222101
    if family in (326, 327) and 1 <= zone <= 60:
        south, inverse = family == 327, WGS84_INVERSE_FLATTENING
    elif family == 258 and 28 <= zone <= 38:
        south = False
    elif code in GRS80_GRIDS:
        zone, south = GRS80_GRIDS[code]
    else:
        raise ValueError(f"the projection {crs!r} is unknown; known are UTM zones and EPSG:{sorted(GRS80_GRIDS)}")
    return TransverseMercator(6.0 * zone - 183.0, false_northing=10_000_000.0 if south else 0.0, inverse_flattening=inverse)


def code_key(c: Column) -> Column:
    """A key of a code table: trimmed, without quotes and without a trailing `.0`."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"^[\"']+|[\"']+$", ""), r"\.0+$", ""), F.lit(""))


def decode(df: DataFrame, field: str, table: DataFrame, key: str, label: str, target: str | None = None) -> DataFrame:
    """Codes replaced by labels of a table; those that it lacks keep their value. Of several labels of a key the smallest counts."""
    codes = table.select(code_key(F.col(f"`{key}`")).alias("_key"), F.col(f"`{label}`").alias("_label")).groupBy("_key").agg(F.min("_label").alias("_label"))
    out = df.join(codes, code_key(F.col(f"`{field}`")) == F.col("_key"), "left")
    return out.withColumn(target or field, F.coalesce("_label", F.col(f"`{field}`").cast("string"))).drop("_key", "_label")


def decode_map(c: Column, table: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.coalesce(F.element_at(pairs, code_key(c)), c.cast("string"))


def decode_list(c: Column, table: Mapping[str, str], sep: str = ";") -> Column:
    """A list in text, each entry decoded."""
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    entries = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(entries, lambda x: F.coalesce(F.element_at(pairs, x), x)), sep)


def valid_or_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*NULL_LIKE), t)


def first_valid(*columns: Column) -> Column:
    return F.coalesce(*[valid_or_null(c) for c in columns])


def last_valid(*columns: Column) -> Column:
    return F.coalesce(*[valid_or_null(c) for c in reversed(columns)])


def first_number(df: DataFrame, names: Sequence[str]) -> Column:
    return F.coalesce(*[coerce.number(F.col(f"`{n}`"), df.schema[n].dataType) for n in names])


def stages_to_rows(df: DataFrame, stems: Sequence[str], suffixes: Sequence[str], needed: str) -> DataFrame:
    """Wide stage columns `stem + suffix` as a row for each stage that has `needed`; `stage` counts from 1."""
    stage = lambda i, s: F.struct(F.lit(i).alias("stage"), *[F.col(f"`{stem}{s}`").alias(stem) for stem in stems])
    wide = [f"{stem}{s}" for stem in stems for s in suffixes]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in wide]
    long = df.select(*rest, F.explode(F.array(*[stage(i, s) for i, s in enumerate(suffixes, 1)])).alias("_s"))
    return long.select(*rest, "_s.*").filter(valid_or_null(F.col(needed)).isNotNull())


def sequence_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str = "movement_seq") -> DataFrame:
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def previous_rows(df: DataFrame, user: str, time: str, fields: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """Each row with fields of the same user's row before; first rows go."""
    w = Window.partitionBy(user).orderBy(time, *fields)
    out = df.withColumns({f"{prefix}{f}": F.lag(f).over(w) for f in fields} | {"_nth": F.row_number().over(w)})
    return out.filter(F.col("_nth") > 1).drop("_nth")


def zone_of(lon: Column, lat: Column, zones: Sequence[tuple[str, Sequence[Sequence[float]]]]) -> Column:
    """The name of the first zone (polygon) that holds a point; its box is tested first."""
    return F.coalesce(*[F.when(in_polygon(lon, lat, ring), F.lit(name)) for name, ring in zones])


def within(df: DataFrame, lon: str, lat: str, zones: DataFrame, box: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat")) -> DataFrame:
    """Rows joined with rectangles on grid squares that both touch, so that no pair outside a shared square is compared."""
    side = 1.0
    keyed = df.withColumn("_gx", F.floor(F.col(lon) / side)).withColumn("_gy", F.floor(F.col(lat) / side))
    x0, y0, x1, y1 = (F.col(c) for c in box)
    grid = zones.withColumn("_gx", F.explode(F.sequence(F.floor(x0 / side), F.floor(x1 / side)))).withColumn("_gy", F.explode(F.sequence(F.floor(y0 / side), F.floor(y1 / side))))
    joined = keyed.join(grid, ["_gx", "_gy"])
    return joined.filter((F.col(lon) >= x0) & (F.col(lon) <= x1) & (F.col(lat) >= y0) & (F.col(lat) <= y1)).drop("_gx", "_gy")


def join_first(df: DataFrame, table: DataFrame, keys: Mapping[str, str], columns: Mapping[str, str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of `df` with columns of a table (name there -> name here) by one or more normalised keys (name here -> name there).

    Each row of `df` stays once: of several rows of a key the first in `order`,
    then by the columns themselves, counts. A null key meets nothing.
    """
    order = [F.col(f"`{c}`") for c in order]
    marks = [f"_key{i}" for i in range(len(keys))]
    taken = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(columns)])
    right = table.select(*[code_key(F.col(f"`{there}`")).alias(m) for m, there in zip(marks, keys.values(), strict=True)], taken.alias("_taken"))
    right = right.dropna(subset=marks).groupBy(*marks).agg(F.min("_taken").alias("_taken"))
    on = reduce(lambda a, b: a & b, [code_key(df[f"`{here}`"]) == right[m] for here, m in zip(keys, marks, strict=True)])
    out = df.join(right, on, "left")
    kept = [df[f"`{c}`"] for c in df.columns if c not in columns.values()]
    return out.select(*kept, *[right["_taken"][f"_v{i}"].alias(n) for i, n in enumerate(columns.values())])


def join_suffixed(df: DataFrame, table: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """A left join by keys of the same name in both; the table's other columns that `df` has too get the suffix."""
    rest = [c for c in table.columns if c not in keys]
    right = table.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").alias(c + suffix if c in df.columns else c) for c in rest])
    on = reduce(lambda a, b: a & b, [df[f"`{k}`"] == right[f"_key{i}"] for i, k in enumerate(keys)])
    return df.join(right, on, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def stop_code(c: Column) -> Column:
    """The form in which codes of stops and stations are compared.

    A code of parts `a-b` has its number last: where the last part is no number
    it changes places with the one before. A name of one part is upper case
    without accents and backquotes. Null-like texts are null.
    """
    t = valid_or_null(c)
    parts = F.split(t, "-")
    n = F.size(parts)
    last, before = F.element_at(parts, -1), F.try_element_at(parts, n - 1)
    swapped = F.array_join(F.concat(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), F.array(last, before)), "-")
    name = F.trim(F.upper(F.translate(t, "ÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛáéíóúüñàèìòùâêîôû`", "AEIOUUNAEIOUAEIOUaeiouunaeiouaeiou")))
    return F.when(n < 2, name).otherwise(F.when(last.rlike("^[0-9]+$"), t).otherwise(swapped))


def locate_stops(df: DataFrame, code: str, stops: DataFrame, *, stop: str, x: str = "x", y: str = "y", into: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Rows with the coordinates of their stop; codes meet in the form of `stop_code`."""
    keyed = stops.select(stop_code(F.col(f"`{stop}`")).alias("_stop"), F.col(f"`{x}`").alias("_x"), F.col(f"`{y}`").alias("_y"))
    marked = df.withColumn("_stop_code", stop_code(F.col(f"`{code}`")))
    return join_first(marked, keyed, {"_stop_code": "_stop"}, {"_x": into[0], "_y": into[1]}).drop("_stop_code")


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule for a column of rings, arrays of (lon, lat) structs, closed or not."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), after.alias("b"))
    crossed = lambda e: F.when((e.a.lat > lat) != (e.b.lat > lat), lon < (e.b.lon - e.a.lon) * (lat - e.a.lat) / (e.b.lat - e.a.lat) + e.a.lon).otherwise(False)
    return F.size(F.filter(edges, crossed)) % 2 == 1


def within_polygons(df: DataFrame, lon: str, lat: str, zones: DataFrame, ring: str, side: float = 0.02) -> DataFrame:
    """Rows joined with each polygon of a table that holds them; points and boxes meet on squares of `side` degrees."""
    points = zones.withColumns({f"_{f}_{axis}": getattr(F, f"array_{f}")(F.col(f"`{ring}`.{axis}")) for f in ("min", "max") for axis in ("lon", "lat")})
    squares = lambda axis: F.explode(F.sequence(F.floor(F.col(f"_min_{axis}") / side), F.floor(F.col(f"_max_{axis}") / side)))
    grid = points.withColumn("_gx", squares("lon")).withColumn("_gy", squares("lat"))
    keyed = df.withColumn("_gx", F.floor(F.col(f"`{lon}`") / side)).withColumn("_gy", F.floor(F.col(f"`{lat}`") / side))
    joined = keyed.join(grid, ["_gx", "_gy"]).filter(inside_ring(F.col(f"`{lon}`"), F.col(f"`{lat}`"), F.col(f"`{ring}`")))
    return joined.drop("_gx", "_gy", "_min_lon", "_max_lon", "_min_lat", "_max_lat")


def project_xy_to_latlon(df: DataFrame, x: str, y: str, *, crs: str = "EPSG:5361", lon: str = "longitude", lat: str = "latitude", status: str | None = "projection_status", zero_is_missing: bool = True) -> DataFrame:
    """Degrees of projected coordinates (decimal commas allowed), and how the parsing went: ok, missing, invalid."""
    grid = projection(crs)
    raw = [F.replace(F.trim(F.col(f"`{c}`").cast("string")), F.lit(","), F.lit(".")) for c in (x, y)]
    values = [F.when(t.rlike(coerce.NUMBER), t.try_cast("double")) for t in raw]
    if zero_is_missing:
        values = [F.nullif(v, F.lit(0.0)) for v in values]
    out_lon, out_lat = grid.to_lonlat(*values)
    out = df.withColumn("_lon", out_lon).withColumn("_lat", out_lat)
    if status:
        blank = [F.coalesce(t == "", F.lit(True)) for t in raw]
        zero = [F.coalesce(t.rlike(r"^[+-]?0+([.]0*)?$"), F.lit(False)) if zero_is_missing else F.lit(False) for t in raw]
        missing = blank[0] | blank[1] | zero[0] | zero[1]
        out = out.withColumn(status, F.when(missing, "missing").when(values[0].isNull() | values[1].isNull(), "invalid").otherwise("ok"))
    return out.withColumn(lon, F.col("_lon")).withColumn(lat, F.col("_lat")).drop("_lon", "_lat")


def plus_minutes(ts: Column, minutes: Column) -> Column:
    """A time some minutes, fractions included, after another."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(minutes * 60_000_000).cast("long"))


def station_pair(c: Column) -> Column:
    """Upper case without accents, and the two parts of `A-B` in order."""
    t = F.translate(F.upper(F.trim(c)), "ÁÉÍÓÚÜÑ", "AEIOUUN")
    return F.array_join(F.array_sort(F.transform(F.split(t, "-"), lambda x: F.trim(x))), "-")


def top_flows(flows: DataFrame, k: int) -> DataFrame:
    """The k flows of most value; a sort with a limit, so each task sends k rows."""
    return flows.orderBy(F.desc("flow_value"), "flow_id").limit(k)


def top_places(flows: DataFrame, end: str, k: int) -> DataFrame:
    return flows.groupBy(F.col(f"{end}_h3_index").alias("cell")).agg(F.sum("flow_value").alias("value")).orderBy(F.desc("value"), "cell").limit(k)


def flow_indicators(flows: DataFrame, k: int = 10) -> DataFrame:
    """One row: flows, total value, share of the k largest, share within a cell."""
    top = top_flows(flows, k).agg(F.sum("flow_value").alias("top"))
    inner = F.sum(F.when(F.col("origin_h3_index") == F.col("destination_h3_index"), F.col("flow_value")).otherwise(0.0))
    total = flows.agg(F.count(F.lit(1)).alias("flows"), F.sum("flow_value").alias("total"), inner.alias("inner"))
    both = total.withColumn("_k", F.lit(0)).join(F.broadcast(top.withColumn("_k", F.lit(0))), "_k")  # one row each
    return both.select("flows", "total", (F.col("top") / F.col("total")).alias("top_share"), (F.col("inner") / F.col("total")).alias("intrazonal_share"))


def neighbourhood(flows: DataFrame, cell: str) -> DataFrame:
    """Flows that touch a cell."""
    return flows.filter((F.col("origin_h3_index") == cell) | (F.col("destination_h3_index") == cell))


def related_locations(flows: DataFrame, locations: DataFrame, cell: str) -> DataFrame:
    """The locations (`id`) at either end of flows that touch a cell, and the cell's own."""
    ends = neighbourhood(flows, cell).select(F.explode(F.array("origin_h3_index", "destination_h3_index")).alias("id"))
    own = flows.sparkSession.range(1).select(F.lit(cell).alias("id"))
    return locations.join(ends.union(own), "id", "left_semi")


def spread(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Median, quartiles and their distance for each group, exact and interpolated."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    out = df.groupBy(*group).agg(F.count(value).alias("n"), q.alias("q"))
    return out.select(*group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: the row count and an order-free hash of all columns."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash"))


def value_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.col(f"`{field}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def box_of(lon: Column, lat: Column, box: Sequence[float]) -> Column:
    return in_bbox(lon, lat, box)
