"""The queries of the engine's own operators on the driver's tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..datasets import FlowDataset
from ..functions import coerce, geo, h3bits, h3proj, prep, timeutil
from ..operators import cleaning, drilldown, export, filtering, fixing, flows, importing, inference, validation
from ..sources import artifacts, profiles, raw_profiles
from ..streaming import flows as stream
from . import views
from .views import TRACES_SQL, TRIPS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _time_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def _parent_sql(cell: str, res: int) -> str:
    clear = ((1 << 63) - 1) & ~((15 << 52) | ((1 << 3 * (15 - res)) - 1))
    return f"printf('%x', (('0x' || {cell})::BIGINT & {clear}) | {(res << 52) | ((1 << 3 * (15 - res)) - 1)})"


# --- flows ---------------------------------------------------------------


def _build(spark: SparkSession, sf_dir: str, **options) -> FlowDataset:
    return flows.build_flows(views.trips(spark, sf_dir), options=flows.FlowBuildOptions(**options))[0]


def _flow_query(name: str, *, cell: int = 8, window: str | None = None, basis: str = "origin", group: tuple[str, ...] = (), least: int = 1, ids: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _build(spark, sf_dir, h3_resolution=cell, group_by=list(group), time_aggregation=window or "none", time_basis=basis, min_trips_per_flow=least).flows
        times = [_time(c) for c in ("window_start_utc", "window_end_utc")] if window else []
        first = ["flow_id"] if ids else []
        return out.select(*first, "origin_h3_index", "destination_h3_index", *times, *group, F.col("flow_count").cast("long").alias("flow_count"), F.round("flow_value", 2).alias("flow_value"))

    roll = (lambda c: c) if cell == 8 else (lambda c: _parent_sql(c, cell))
    start = f"date_trunc('{window}', {basis}_time_utc)" if window else ""
    times = f"{start} AS window_start_utc, {start} + INTERVAL {dict(hour='1 HOUR', day='1 DAY', week='7 DAY')[window]} AS window_end_utc," if window else ""
    keys = ["origin_h3_index", "destination_h3_index", *(["window_start_utc", "window_end_utc"] if window else []), *group]
    shown = ", ".join(_time_sql(k) if k.startswith("window") else k for k in keys)
    order = ", ".join(f"{k} ASC NULLS LAST" for k in keys)
    number = f"'flow_' || lpad((row_number() OVER (ORDER BY {order}) - 1)::VARCHAR, 7, '0') AS flow_id," if ids else ""
    sql = f"""WITH {TRIPS_SQL}, keyed AS (SELECT {roll('origin_h3_index')} AS origin_h3_index, {roll('destination_h3_index')} AS destination_h3_index, {times} {''.join(g + ', ' for g in group)} trip_weight
      FROM trips WHERE origin_h3_index IS NOT NULL AND destination_h3_index IS NOT NULL),
    grouped AS (SELECT {', '.join(keys)}, count(*) AS flow_count, sum(trip_weight) AS flow_value FROM keyed GROUP BY ALL HAVING count(*) >= {least})
    SELECT {number} {shown}, flow_count::BIGINT AS flow_count, round(flow_value, 2) AS flow_value FROM grouped"""
    query(sql, name)(run)


_flow_query("flows_basic")
_flow_query("flows_daily", window="day")
_flow_query("flows_weekly", window="week")
_flow_query("flows_hourly_trips", window="hour")
_flow_query("flows_segmented", group=("mode", "segment"))
_flow_query("flows_weighted", group=("mode",))
_flow_query("flows_threshold", least=4, group=("segment",))
_flow_query("flows_dest_basis", window="week", basis="destination")
_flow_query("flows_rollup_parent", cell=6)
_flow_query("flows_null_groups", group=("purpose",))
_flow_query("flow_ids", cell=7, group=("purpose",), ids=True)

_BRIDGE_SQL = f"""WITH {TRIPS_SQL}, keyed AS (SELECT movement_id, {_parent_sql('origin_h3_index', 6)} AS o, {_parent_sql('destination_h3_index', 6)} AS d, purpose FROM trips WHERE origin_h3_index IS NOT NULL AND destination_h3_index IS NOT NULL),
  grouped AS (SELECT o, d, purpose FROM keyed GROUP BY ALL), ids AS (SELECT *, 'flow_' || lpad((row_number() OVER (ORDER BY o, d, purpose ASC NULLS LAST) - 1)::VARCHAR, 7, '0') AS flow_id FROM grouped)
  SELECT DISTINCT flow_id, movement_id FROM keyed k JOIN ids i ON k.o = i.o AND k.d = i.d AND k.purpose IS NOT DISTINCT FROM i.purpose"""


@query(_BRIDGE_SQL)
def flow_to_trips(spark, sf_dir):
    return _build(spark, sf_dir, h3_resolution=6, group_by=["purpose"], keep_flow_to_trips=True).flow_to_trips.distinct()


@query(_BRIDGE_SQL)
def trips_from_flows_bridge(spark, sf_dir):
    return drilldown.get_trips_from_flows(_build(spark, sf_dir, h3_resolution=6, group_by=["purpose"], keep_flow_to_trips=True))[0]


@query(_BRIDGE_SQL)
def trips_from_flows_reconstruct(spark, sf_dir):
    return drilldown.get_trips_from_flows(_build(spark, sf_dir, h3_resolution=6, group_by=["purpose"]))[0]


@query(f"WITH {TRIPS_SQL} SELECT movement_id FROM trips WHERE origin_h3_index IS NULL OR destination_h3_index IS NULL GROUP BY 1")
def coverage_unmatched(spark, sf_dir):
    built = _build(spark, sf_dir, h3_resolution=6)
    pairs, _ = drilldown.get_trips_from_flows(built)
    return drilldown.unmatched_movements(pairs, built.source_trips).distinct()


# --- filters -------------------------------------------------------------

_SHOWN = ("movement_id", "user_id", "mode", "purpose", "trip_weight")
_SHOWN_SQL = ", ".join(_SHOWN)


def _filter_query(name: str, condition: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filtering.filter_trips(views.trips(spark, sf_dir), filtering.FilterOptions(**options))[0].data.select(*_SHOWN)

    query(f"WITH {TRIPS_SQL} SELECT {_SHOWN_SQL} FROM trips WHERE {condition}", name)(run)


def _polygon_sql(lon: str, lat: str, ring) -> str:
    edges = [f"(CASE WHEN ({y1} > {lat}) <> ({y2} > {lat}) AND {lon} < ({x2 - x1!r}::DOUBLE) * ({lat} - {y1!r}::DOUBLE) / ({y2 - y1!r}::DOUBLE) + {x1!r}::DOUBLE THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(ring, [ring[-1], *ring[:-1]], strict=True) if y1 != y2]
    return f"({lon} IS NOT NULL AND {lat} IS NOT NULL AND ({' + '.join(edges)}) % 2 = 1)"


_BOX = (-70.805, -33.605, -70.605, -33.355)
_RING = [(-70.857, -33.652), (-70.553, -33.601), (-70.601, -33.253), (-70.753, -33.403)]


def _box_sql(e: str) -> str:
    return f"({e}_longitude BETWEEN {_BOX[0]} AND {_BOX[2]} AND {e}_latitude BETWEEN {_BOX[1]} AND {_BOX[3]})"


_filter_query("where_eq", "mode = 'R'", where={"mode": "R"})
_filter_query("where_ne_nulls", "purpose IS NOT NULL AND purpose <> '1-URGENT'", where={"purpose": {"ne": "1-URGENT"}})
_filter_query("where_ne_float", "origin_latitude IS NULL OR origin_latitude <> 95", where={"origin_latitude": {"ne": 95.0}})
_filter_query("where_in", "mode IN ('A', 'N')", where={"mode": ["A", "N"]})
_filter_query("where_not_in", "purpose IS NULL OR purpose NOT IN ('1-URGENT', '2-HIGH')", where={"purpose": {"not_in": ["1-URGENT", "2-HIGH"]}})
_filter_query("where_null", "purpose IS NULL", where={"purpose": {"is_null": True}})
_filter_query("where_range", "trip_weight > 10 AND trip_weight <= 20", where={"trip_weight": {"gt": 10, "lte": 20}})
_filter_query("where_between", "origin_time_utc BETWEEN '1995-01-01' AND '1996-06-30'", where={"origin_time_utc": {"between": ["1995-01-01", "1996-06-30"]}})
_INTERVAL = ("1995-03-01", "1996-09-01")
_filter_query("time_starts", "origin_time_utc >= '1995-03-01' AND origin_time_utc < '1996-09-01'", time=filtering.TimeFilter(*_INTERVAL, "starts_within"))
_filter_query("time_ends", "destination_time_utc >= '1995-03-01' AND destination_time_utc < '1996-09-01'", time=filtering.TimeFilter(*_INTERVAL, "ends_within"))
_filter_query("time_contains", "origin_time_utc >= '1995-03-01' AND destination_time_utc <= '1996-09-01'", time=filtering.TimeFilter(*_INTERVAL, "contains"))
_filter_query("time_overlaps", "origin_time_utc < '1996-09-01' AND destination_time_utc > '1995-03-01'", time=filtering.TimeFilter(*_INTERVAL, "overlaps"))
_filter_query("bbox_origin", _box_sql("origin"), bbox=_BOX)
_filter_query("bbox_both", f"{_box_sql('origin')} AND {_box_sql('destination')}", bbox=_BOX, spatial_predicate="both")
_filter_query("bbox_either", f"{_box_sql('origin')} OR {_box_sql('destination')}", bbox=_BOX, spatial_predicate="either")
_filter_query("polygon", _polygon_sql("destination_longitude", "destination_latitude", _RING), polygon=_RING, spatial_predicate="destination")
_filter_query(
    "filter_combined",
    f"mode = 'R' AND origin_time_utc < '1996-09-01' AND destination_time_utc > '1995-03-01' AND {_box_sql('origin')} AND {_polygon_sql('origin_longitude', 'origin_latitude', _RING)}",
    where={"mode": "R"}, time=filtering.TimeFilter(*_INTERVAL), bbox=_BOX, polygon=_RING,
)
_CELL_KEYS = [53 * 3 + 1, 53 * 7 + 2, 53 * 11 + 4]


def _cell_text(key: int) -> str:
    return format(views._HEAD + views._TAIL + sum((key // 7**k % 7) << (21 + 3 * k) for k in range(7)), "x")


_CELLS = [_cell_text(k) for k in _CELL_KEYS]
_LIST = ", ".join(f"'{c}'" for c in _CELLS)
_filter_query("h3_cells", f"origin_h3_index IN ({_LIST})", h3_cells=_CELLS)


@query(f"""WITH {TRIPS_SQL}, f AS (SELECT mode = 'R' AS a, coalesce(origin_time_utc < '1996-09-01' AND destination_time_utc > '1995-03-01', false) AS b, coalesce({_box_sql('origin')}, false) AS c FROM trips)
  SELECT count(*)::BIGINT AS rows_in, count(*) FILTER (NOT a)::BIGINT AS dropped_where, count(*) FILTER (a AND NOT b)::BIGINT AS dropped_time, count(*) FILTER (a AND b AND NOT c)::BIGINT AS dropped_bbox FROM f""")
def filter_drop_counts(spark, sf_dir):
    _, report = filtering.filter_trips(views.trips(spark, sf_dir), filtering.FilterOptions(where={"mode": "R"}, time=filtering.TimeFilter(*_INTERVAL), bbox=_BOX))
    d = report.summary["dropped_by_axis"]
    return spark.createDataFrame([(report.summary["rows_in"], d["where"], d["time"], d["bbox"])], "rows_in long, dropped_where long, dropped_time long, dropped_bbox long")


_FLOWS8 = f"SELECT origin_h3_index, destination_h3_index, mode, count(*)::BIGINT AS flow_count, round(sum(trip_weight), 2) AS flow_value FROM trips WHERE destination_h3_index IS NOT NULL GROUP BY ALL"


@query(f"WITH {TRIPS_SQL}, f AS ({_FLOWS8}) SELECT * FROM f WHERE mode IN ('A', 'R') AND flow_count >= 3")
def flows_where(spark, sf_dir):
    out, _ = filtering.filter_flows(_build(spark, sf_dir, group_by=["mode"]), filtering.FlowFilterOptions(where={"mode": {"A", "R"}, "flow_count": {"gte": 3}}))
    return out.flows.select("origin_h3_index", "destination_h3_index", "mode", "flow_count", F.round("flow_value", 2).alias("flow_value"))


@query(f"WITH {TRIPS_SQL} SELECT DISTINCT movement_id FROM trips WHERE destination_h3_index IS NOT NULL AND (origin_h3_index IN ({_LIST}) OR destination_h3_index IN ({_LIST}))")
def flows_h3_sync(spark, sf_dir):
    built = _build(spark, sf_dir, keep_flow_to_trips=True)
    out, _ = filtering.filter_flows(built, filtering.FlowFilterOptions(h3_cells=_CELLS, spatial_predicate="either"))
    return out.flow_to_trips.select("movement_id").distinct()


# --- clean ---------------------------------------------------------------


def _clean_query(name: str, condition: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cleaning.clean_trips(views.trips(spark, sf_dir), options=cleaning.CleanOptions(**options))[0].data.select(*_SHOWN)

    query(f"WITH {TRIPS_SQL} SELECT {_SHOWN_SQL} FROM trips WHERE {condition}", name)(run)


def _latlon_sql() -> str:
    half, off, none = [], [], []
    for e in ("origin", "destination"):
        a, b = f"{e}_latitude", f"{e}_longitude"
        half.append(f"(({a} IS NULL) <> ({b} IS NULL))")
        off.append(f"({a} IS NOT NULL AND {b} IS NOT NULL AND NOT ({a} BETWEEN -90 AND 90 AND {b} BETWEEN -180 AND 180))")
        none.append(f"({a} IS NULL AND {b} IS NULL)")
    return f"({' OR '.join(half + off)} OR ({' AND '.join(none)}))"


_clean_query("clean_nulls", "purpose IS NOT NULL AND origin_latitude IS NOT NULL", drop_rows_with_nulls_in_fields=["purpose", "origin_latitude"], drop_rows_with_nulls_in_required_fields=True)
_clean_query("clean_latlon", f"NOT {_latlon_sql()}", drop_rows_with_invalid_latlon=True)
_clean_query("clean_h3", "destination_h3_index IS NOT NULL AND origin_h3_index IS NOT NULL", drop_rows_with_invalid_h3=True)
_clean_query("clean_time_order", "origin_time_utc <= destination_time_utc", drop_rows_with_origin_after_destination=True)
_clean_query("clean_categorical", "(mode IS NULL OR mode <> 'N') AND purpose IS NOT NULL AND purpose <> '1-URGENT'", drop_rows_by_categorical_values={"mode": ["N"], "purpose": [None, "1-URGENT"]})


@query(f"WITH {TRIPS_SQL} SELECT user_id, mode, min(movement_id) AS movement_id FROM trips WHERE origin_time_utc <= destination_time_utc GROUP BY ALL")
def clean_dups(spark, sf_dir):
    o = cleaning.CleanOptions(drop_duplicates=True, duplicates_subset=["user_id", "mode"], drop_rows_with_origin_after_destination=True)
    return cleaning.clean_trips(views.trips(spark, sf_dir), options=o, row_order=["movement_id"])[0].data.select("user_id", "mode", "movement_id")


@query(f"""WITH {TRIPS_SQL}, r AS (SELECT *, CASE WHEN purpose IS NULL THEN 'nulls_fields' WHEN {_latlon_sql()} THEN 'invalid_latlon' WHEN destination_h3_index IS NULL THEN 'invalid_h3' WHEN origin_time_utc > destination_time_utc THEN 'origin_after_destination' END AS rule FROM trips),
  n AS (SELECT *, CASE WHEN rule IS NULL THEN row_number() OVER (PARTITION BY rule IS NULL, trip_id ORDER BY movement_id) END AS nth FROM r),
  t AS (SELECT CASE WHEN rule IS NOT NULL THEN rule WHEN nth > 1 THEN 'duplicates' WHEN mode = 'N' THEN 'categorical_values' ELSE 'kept' END AS rule FROM n) SELECT rule, count(*)::BIGINT AS n FROM t GROUP BY 1""")
def clean_summary(spark, sf_dir):
    o = cleaning.CleanOptions(False, ["purpose"], True, True, True, True, ["trip_id"], {"mode": ["N"]})
    _, report = cleaning.clean_trips(views.trips(spark, sf_dir), options=o, row_order=["movement_id"])
    rows = [(k, v) for k, v in report.summary["dropped_by_rule"].items() if v] + [("kept", report.summary["rows_out"])]
    return spark.createDataFrame(rows, "rule string, n long")


# --- validate ------------------------------------------------------------


def _issue_rows(spark: SparkSession, report) -> DataFrame:
    return spark.createDataFrame([(i.code, i.field or "", int(i.row_count or 0)) for i in report.issues], "code string, field string, n long")


def _count_sql(code: str, field: str, condition: str) -> str:
    return f"SELECT '{code}' AS code, '{field}' AS field, count(*)::BIGINT AS n FROM trips WHERE {condition} HAVING count(*) > 0"


_C = "VAL.CORE.CONSTRAINT_VIOLATION"


@query(
    f"WITH {TRIPS_SQL} "
    + " UNION ALL ".join(
        [
            _count_sql(_C, "origin_latitude", "origin_latitude > 90"),
            _count_sql(_C, "trip_weight", "trip_weight > 45"),
            _count_sql(_C, "segment", "length(segment) NOT BETWEEN 4 AND 9"),
            _count_sql(_C, "movement_id", "movement_id IN (SELECT movement_id FROM trips GROUP BY 1 HAVING count(*) > 1)"),
            _count_sql("VAL.CORE.OD_SPATIAL_BOTH_MISSING", "", "(origin_latitude IS NULL OR origin_longitude IS NULL) AND (destination_latitude IS NULL OR destination_longitude IS NULL)"),
            _count_sql("VAL.TEMPORAL.ORIGIN_AFTER_DESTINATION", "", "origin_time_utc > destination_time_utc"),
            _count_sql("VAL.DUPLICATES.ROWS_FOUND", "", "(trip_id, movement_seq) IN (SELECT (trip_id, movement_seq) FROM trips GROUP BY trip_id, movement_seq HAVING count(*) > 1)"),
        ]
    )
)
def val_constraints(spark, sf_dir):
    t = views.trips(spark, sf_dir)
    o = validation.ValidationOptions(validate_temporal_consistency=True, validate_duplicates=True, duplicates_subset=["trip_id", "movement_seq"], sample_rows_per_issue=0)
    return _issue_rows(spark, validation.validate_trips(t, options=o)[1])


@query(f"WITH {TRIPS_SQL} SELECT count(*)::BIGINT AS n, count(*) FILTER (try_cast(segment AS DOUBLE) IS NULL)::BIGINT AS not_float, count(*) FILTER (try_cast(user_id AS BIGINT) IS NULL)::BIGINT AS not_int, count(*) FILTER (lower(mode) NOT IN ('true','t','1','yes','y','si','sí','false','f','0','no','n'))::BIGINT AS not_bool FROM trips")
def val_types(spark, sf_dir):
    df = views.trips_table(spark, sf_dir)
    bad = lambda c, t: F.count_if(validation.uninterpretable(df, c, t)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), bad("segment", "float").alias("not_float"), bad("user_id", "int").alias("not_int"), bad("mode", "bool").alias("not_bool"))


@query(f"WITH {TRIPS_SQL} SELECT count(*) FILTER (NOT regexp_matches(movement_id, '^(?:[0-9]+-1)'))::BIGINT AS prefix_bad, count(*) FILTER (NOT regexp_matches(user_id, '^(?:1[0-9]*)$'))::BIGINT AS full_bad FROM trips")
def val_pattern(spark, sf_dir):
    df = views.trips_table(spark, sf_dir)
    return df.agg(F.count_if(validation.violation(df, "movement_id", "pattern", "[0-9]+-1")).cast("long").alias("prefix_bad"), F.count_if(validation.violation(df, "user_id", "pattern", "1[0-9]*", full_match=True)).cast("long").alias("full_bad"))


@query(f"WITH {TRIPS_SQL} SELECT count(purpose)::BIGINT AS n, round(avg(CASE WHEN purpose IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1.0 ELSE 0.0 END) FILTER (purpose IS NOT NULL), 9) AS ratio FROM trips")
def val_domain_ratio(spark, sf_dir):
    t = views.trips(spark, sf_dir)
    _, report = validation.validate_trips(t, options=validation.ValidationOptions(validate_constraints=False, validate_types_and_formats=False, validate_domains="full", domains_min_in_domain_ratio=0.5))
    return t.data.agg(F.count("purpose").alias("n")).withColumn("ratio", F.round(F.lit(report.summary["domains"]["purpose"]), 9))


@query(f"WITH {TRACES_SQL}, s AS (SELECT *, lag(time_utc) OVER (PARTITION BY user_id ORDER BY k, point_id) AS before FROM traces) SELECT user_id, count(*)::BIGINT AS n FROM s WHERE before > time_utc GROUP BY 1")
def val_monotonic(spark, sf_dir):
    return validation.time_regressions(views.traces_table(spark, sf_dir), ["k", "point_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRACES_SQL} SELECT count(*)::BIGINT AS rows, true AS ok FROM traces")
def val_traces(spark, sf_dir):
    _, report = validation.validate_traces(views.traces(spark, sf_dir), row_order=["time_utc", "point_id"])
    return spark.createDataFrame([(report.summary["rows"], report.ok)], "rows long, ok boolean")


_T = "VAL.CONSTRAINTS.VIOLATION"
_FAULTS_SQL = """traces AS (SELECT * REPLACE (CASE WHEN k % 11 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN k % 7 = 3 THEN latitude + 200 ELSE latitude END AS latitude,
  CASE WHEN k % 13 = 0 THEN 'p' ELSE point_id END AS point_id, CASE WHEN k % 5 = 0 THEN '9' || location_ref ELSE location_ref END AS location_ref) FROM sound)"""


def _fault_sql(code: str, field: str, condition: str) -> str:
    return _count_sql(code, field, condition).replace("FROM trips", "FROM traces")


@query(
    f"WITH {TRACES_SQL.replace('traces AS', 'sound AS', 1)}, {_FAULTS_SQL} "
    + " UNION ALL ".join(
        [
            _fault_sql("VAL.REQUIRED.NULL_IN_REQUIRED", "user_id", "user_id IS NULL"),
            _fault_sql(_T, "latitude", "latitude > 90"),
            _fault_sql(_T, "location_ref", "NOT regexp_full_match(location_ref, '[a-z]+')"),
            _fault_sql(_T, "point_id", "point_id IN (SELECT point_id FROM traces GROUP BY 1 HAVING count(*) > 1)"),
        ]
    )
)
def val_traces_faults(spark, sf_dir):
    """Points with faults: what the report counts."""
    t = views.traces(spark, sf_dir)
    k = F.col("k")
    data = t.data.withColumns(
        {
            "user_id": F.when(k % 11 != 0, F.col("user_id")),
            "latitude": F.when(k % 7 == 3, F.col("latitude") + 200).otherwise(F.col("latitude")),
            "point_id": F.when(k % 13 == 0, "p").otherwise(F.col("point_id")),
            "location_ref": F.when(k % 5 == 0, F.concat(F.lit("9"), "location_ref")).otherwise(F.col("location_ref")),
        }
    )
    o = validation.TraceValidationOptions(validate_monotonic_time_per_user=False)
    _, report = validation.validate_traces(replace(t, data=data), options=o)
    return _issue_rows(spark, report)


@query(f"WITH {TRIPS_SQL} SELECT count(*)::BIGINT AS n, true AS near FROM trips")
def val_domain_sample(spark, sf_dir):
    """A sampled domain ratio lies near that of all rows, and a rerun agrees."""
    t = views.trips(spark, sf_dir)
    o = validation.ValidationOptions(validate_constraints=False, validate_types_and_formats=False, validate_domains="full", domains_min_in_domain_ratio=0.1)
    whole = validation.validate_trips(t, options=o)[1].summary
    parts = [validation.validate_trips(t, options=replace(o, validate_domains="sample", domains_sample_frac=0.3))[1].summary["domains"]["purpose"] for _ in range(2)]
    return spark.createDataFrame([(whole["rows"], parts[0] == parts[1] and abs(parts[0] - whole["domains"]["purpose"]) < 0.05)], "n long, near boolean")


# --- inference -----------------------------------------------------------

_HAVERSINE = """(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)))"""


def _h_sql(a: str, b: str) -> str:
    return f"pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)"


_PAIRS_SQL = """pairs AS (SELECT user_id, point_id AS origin_point, latitude AS lat1, longitude AS lon1, time_utc AS t1, location_ref AS r1, lead(point_id) OVER w AS destination_point, lead(latitude) OVER w AS lat2, lead(longitude) OVER w AS lon2, lead(time_utc) OVER w AS t2, lead(location_ref) OVER w AS r2
  FROM traces WINDOW w AS (PARTITION BY user_id ORDER BY time_utc, point_id))"""
_DIST_SQL = "(2 * 6371000.0 * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))"


@query(f"WITH {TRACES_SQL}, {_PAIRS_SQL} SELECT user_id, origin_point, destination_point FROM pairs WHERE destination_point IS NOT NULL")
def pairs(spark, sf_dir):
    p = inference.point_pairs(inference.prepared(views.traces_table(spark, sf_dir)))
    return p.select("user_id", F.col("o.point_id").alias("origin_point"), F.col("d.point_id").alias("destination_point"))


@query(f"WITH {TRACES_SQL}, {_PAIRS_SQL} SELECT origin_point, round({_DIST_SQL}, 3) AS metres FROM pairs WHERE destination_point IS NOT NULL")
def haversine(spark, sf_dir):
    p = inference.point_pairs(inference.prepared(views.traces_table(spark, sf_dir)))
    return p.select(F.col("o.point_id").alias("origin_point"), F.round(geo.haversine_m(F.col("o.latitude"), F.col("o.longitude"), F.col("d.latitude"), F.col("d.longitude")), 3).alias("metres"))


@query(f"WITH {TRACES_SQL}, {_PAIRS_SQL}, f AS (SELECT date_diff('microsecond', t1, t2) / 1e6 AS dt, {_DIST_SQL} AS dist, coalesce(r1 = r2, false) AS same FROM pairs WHERE destination_point IS NOT NULL) SELECT count(*) FILTER (dt > 90000)::BIGINT AS max_time, count(*) FILTER (dt < 600)::BIGINT AS min_time, count(*) FILTER (dist < 120)::BIGINT AS min_distance, count(*) FILTER (same)::BIGINT AS same_place, count(*) FILTER (NOT (dt > 90000 OR dt < 600 OR dist < 120 OR same))::BIGINT AS trips FROM f")
def thresholds(spark, sf_dir):
    o = inference.InferTripsOptions(max_time_delta_s=90000, min_time_delta_s=600, min_distance_m=120, drop_same_place=True)
    _, report = inference.infer_trips_from_traces(views.traces(spark, sf_dir), views.TRIP_SCHEMA, options=o)
    r = report.summary["reasons"]
    return spark.createDataFrame([(r["max_time"], r["min_time"], r["min_distance"], r["same_place"], report.summary["trips"])], "max_time long, min_time long, min_distance long, same_place long, trips long")


_CLUSTER_SQL = f"""lagged AS (SELECT *, lag(time_utc) OVER w AS t0, lag(latitude) OVER w AS lat1, lag(longitude) OVER w AS lon1, latitude AS lat2, longitude AS lon2 FROM traces WINDOW w AS (PARTITION BY user_id ORDER BY time_utc, point_id)),
  marked AS (SELECT *, CASE WHEN coalesce(date_diff('microsecond', t0, time_utc) / 1e6 <= 200000 AND {_DIST_SQL} <= 250, false) THEN 0 ELSE 1 END AS starts FROM lagged),
  clustered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY time_utc, point_id ROWS UNBOUNDED PRECEDING) AS cluster FROM marked)"""


@query(f"WITH {TRACES_SQL}, {_CLUSTER_SQL} SELECT user_id, cluster::BIGINT AS cluster, count(*)::BIGINT AS points FROM clustered GROUP BY ALL")
def clusters(spark, sf_dir):
    df = inference.with_clusters(inference.prepared(views.traces_table(spark, sf_dir)), 250, 200000)
    return df.groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("points"))


@query(f"""WITH {TRACES_SQL}, {_CLUSTER_SQL}, ends AS (SELECT user_id, cluster, arg_min(point_id, (time_utc, point_id)) AS first, arg_max(point_id, (time_utc, point_id)) AS last FROM clustered GROUP BY ALL)
  SELECT * FROM (SELECT user_id, last AS origin_point, lead(first) OVER (PARTITION BY user_id ORDER BY cluster) AS destination_point FROM ends) WHERE destination_point IS NOT NULL""")
def cluster_trips(spark, sf_dir):
    p = inference.cluster_pairs(inference.prepared(views.traces_table(spark, sf_dir)), 250, 200000)
    return p.select("user_id", F.col("o.point_id").alias("origin_point"), F.col("d.point_id").alias("destination_point"))


@query(f"""WITH {TRACES_SQL}, {_PAIRS_SQL} SELECT 'm' || (row_number() OVER (ORDER BY user_id, t1, origin_point) - 1) AS movement_id, user_id, r1 AS origin_location_ref, r2 AS destination_location_ref, strftime(t1, '%Y-%m-%d %H:%M:%S') AS origin_time_utc, strftime(t2, '%Y-%m-%d %H:%M:%S') AS destination_time_utc
  FROM pairs WHERE destination_point IS NOT NULL AND NOT coalesce(r1 = r2, false)""")
def propagate(spark, sf_dir):
    o = inference.InferTripsOptions(propagate_fields={"location_ref": "both"}, drop_same_place=True)
    t, _ = inference.infer_trips_from_traces(views.traces(spark, sf_dir), views.TRIP_SCHEMA, options=o)
    return t.data.select("movement_id", "user_id", "origin_location_ref", "destination_location_ref", _time("origin_time_utc"), _time("destination_time_utc"))


_TRACE_CELL_SQL = views._cell_sql("user_id::BIGINT % 200")


@query(f"""WITH {TRACES_SQL}, p AS (SELECT user_id, time_utc, weight, k, lead(k) OVER w AS k2 FROM traces WINDOW w AS (PARTITION BY user_id ORDER BY time_utc, point_id)),
  keyed AS (SELECT {_parent_sql(views._cell_sql('k'), 7)} AS origin_h3_index, {_parent_sql(views._cell_sql('k2'), 7)} AS destination_h3_index, date_trunc('hour', time_utc) AS w, weight FROM p WHERE k2 IS NOT NULL),
  g AS (SELECT origin_h3_index, destination_h3_index, w, count(*) AS flow_count, sum(weight) AS flow_value FROM keyed GROUP BY ALL)
  SELECT 'flow_' || lpad((row_number() OVER (ORDER BY origin_h3_index, destination_h3_index, w) - 1)::VARCHAR, 7, '0') AS flow_id, origin_h3_index, destination_h3_index, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start_utc, flow_count::BIGINT AS flow_count, round(flow_value, 2) AS flow_value FROM g""")
def flows_hourly(spark, sf_dir):
    """Events as points, each user's consecutive points as trips, and hourly flows between cells of resolution 7."""
    p = inference.point_pairs(inference.prepared(views.traces_table(spark, sf_dir)), ["k", "weight"])
    t = p.select(F.concat(F.lit("m"), F.col("o.point_id")).alias("movement_id"), "user_id", F.col("o.time_utc").alias("origin_time_utc"), F.col("d.time_utc").alias("destination_time_utc"), views.cell_id(F.col("o.k")).alias("origin_h3_index"), views.cell_id(F.col("d.k")).alias("destination_h3_index"), F.col("o.weight").alias("trip_weight"))
    base = views.trips(spark, sf_dir)
    built, _ = flows.build_flows(type(base)(t, views.TRIP_SCHEMA, metadata=base.metadata), options=flows.FlowBuildOptions(h3_resolution=7, time_aggregation="hour"))
    return built.flows.select("flow_id", "origin_h3_index", "destination_h3_index", _time("window_start_utc"), "flow_count", F.round("flow_value", 2).alias("flow_value"))


# --- import and fix ------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an uncooked table of texts."""
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lat = F.concat(F.lit("33° "), (F.col("o_custkey") % 60).cast("string"), F.lit(".5' S"))
    return j.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("id"),
        F.col("o_custkey").cast("string").alias("person"),
        F.when(F.col("o_custkey") % 3 == 0, lat).otherwise(F.concat(F.lit("-33,"), (F.col("o_custkey") % 90).cast("string"))).alias("lat"),
        F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 10:30:00"), F.when(F.col("o_custkey") % 2 == 0, F.lit("-04:00")).otherwise(F.lit(""))).alias("start"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("end"),
        F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")).alias("how"),
        F.col("o_orderpriority").alias("why"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise(F.lit("many")).alias("seats"),
        F.when(F.col("l_linenumber") == 1, F.lit("Yes")).when(F.col("l_linenumber") == 2, F.lit("NO")).otherwise(F.lit("?")).alias("return"),
        F.concat(F.lpad((F.col("o_custkey") % 30).cast("string"), 2, "0"), F.lit(":15")).alias("clock"),
        F.col("l_linenumber").alias("extra"),
    )


_RAW_SQL = """raw AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, o_custkey, o_custkey::VARCHAR AS person, o_orderdate::TIMESTAMP AS od, l_shipdate::TIMESTAMP AS sd, l_returnflag AS how, o_orderpriority AS why, l_quantity, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_IMPORT_SCHEMA = views.TripSchema(
    "1.0",
    {
        f.name: f
        for f in (
            views.FieldSpec("movement_id", "string", True),
            views.FieldSpec("user_id", "string", True),
            views.FieldSpec("origin_latitude", "float"),
            views.FieldSpec("origin_time_utc", "datetime", True),
            views.FieldSpec("destination_time_utc", "datetime", True),
            views.FieldSpec("mode", "categorical", domain=views.DomainSpec(["air", "rail", "unknown"], False)),
            views.FieldSpec("purpose", "categorical", domain=views.DomainSpec([])),
            views.FieldSpec("seats", "int"),
            views.FieldSpec("is_return", "bool"),
            views.FieldSpec("origin_time_local_hhmm", "string"),
        )
    },
    ["movement_id", "user_id", "origin_time_utc", "destination_time_utc"],
)
_FIELDS = {"movement_id": "id", "user_id": "person", "origin_latitude": "lat", "origin_time_utc": "start", "destination_time_utc": "end", "mode": "how", "purpose": "why", "is_return": "return", "origin_time_local_hhmm": "clock"}


def _imported(spark, sf_dir, **options):
    profile = profiles.SourceProfile("lines", default_field_correspondence=_FIELDS, default_value_correspondence={"mode": {"A": "air", "R": "rail"}}, default_options=importing.ImportOptions(keep_extra_fields=False, **options))
    return profiles.import_trips_from_profile(_raw(spark, sf_dir), profile, _IMPORT_SCHEMA)


@query(f"WITH {_RAW_SQL} SELECT id AS movement_id, person AS user_id, CASE how WHEN 'A' THEN 'air' WHEN 'R' THEN 'rail' ELSE 'unknown' END AS mode, why AS purpose FROM raw")
def import_recode_domain(spark, sf_dir):
    return _imported(spark, sf_dir)[0].data.select("movement_id", "user_id", "mode", "purpose")


@query(f"WITH {_RAW_SQL} SELECT id AS movement_id, CASE how WHEN 'A' THEN 'air' ELSE 'unknown' END AS mode FROM raw")
def import_closed_domain(spark, sf_dir):
    """A closed domain of one value, and a stranger for nearly each row."""
    raw = _raw(spark, sf_dir).withColumn("how", F.when(F.trim("how") == "A", "air").otherwise(F.concat(F.lit("c"), "id")))
    profile = profiles.SourceProfile("lines", default_field_correspondence=_FIELDS, default_options=importing.ImportOptions(keep_extra_fields=False))
    return profiles.import_trips_from_profile(raw, profile, _IMPORT_SCHEMA)[0].data.select("movement_id", "mode")


@query(f"WITH {_RAW_SQL} SELECT id AS movement_id, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT END AS seats, CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false END AS is_return, CASE WHEN o_custkey % 30 < 24 THEN lpad((o_custkey % 30)::VARCHAR, 2, '0') || ':15' END AS origin_time_local_hhmm FROM raw")
def import_coerce(spark, sf_dir):
    return _imported(spark, sf_dir)[0].data.select("movement_id", "seats", "is_return", "origin_time_local_hhmm")


@query(f"WITH {_RAW_SQL} SELECT id AS movement_id, round(CASE WHEN o_custkey % 3 = 0 THEN -(33 + (o_custkey % 60 + 0.5::DOUBLE) / 60) ELSE ('-33.' || (o_custkey % 90)::VARCHAR)::DOUBLE END, 9) AS origin_latitude FROM raw")
def coord_parse(spark, sf_dir):
    return _imported(spark, sf_dir)[0].data.select("movement_id", F.round("origin_latitude", 9).alias("origin_latitude"))


@query(f"WITH {_RAW_SQL} SELECT id AS movement_id, strftime(od + INTERVAL 630 MINUTE + CASE WHEN o_custkey % 2 = 0 THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS origin_time_utc FROM raw")
def tz_to_utc(spark, sf_dir):
    """Texts with an offset beside local ones of a zone without daylight saving (UTC-5)."""
    return _imported(spark, sf_dir, source_timezone="America/Jamaica")[0].data.select("movement_id", _time("origin_time_utc"))


@query(f"WITH {_RAW_SQL} SELECT purpose, count(*)::BIGINT AS n FROM (SELECT why AS purpose FROM raw) GROUP BY 1")
def domain_bootstrap(spark, sf_dir):
    t, _ = _imported(spark, sf_dir)
    assert t.effective.domains["purpose"].get("bootstrapped")
    return t.data.groupBy("purpose").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRIPS_SQL} SELECT CASE mode WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE mode END AS mode, count(*)::BIGINT AS n FROM trips GROUP BY 1")
def fix_recode(spark, sf_dir):
    """A swap: pairs apply at once."""
    t, _ = fixing.fix_trips_correspondence(views.trips(spark, sf_dir), value_corrections={"mode": {"A": "R", "R": "A"}})
    return t.data.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRIPS_SQL} SELECT user_id, count(*)::BIGINT AS n FROM trips GROUP BY 1")
def fix_rename(spark, sf_dir):
    base = views.trips(spark, sf_dir)
    t = type(base)(base.data.withColumnRenamed("user_id", "who"), base.schema, metadata=base.metadata, effective=base.effective)
    return fixing.fix_trips_correspondence(t, field_corrections={"who": "user_id"})[0].data.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRACES_SQL} SELECT point_id, user_id, strftime(time_utc, '%Y-%m-%d %H:%M:%S') AS time_utc FROM traces")
def import_traces(spark, sf_dir):
    raw = views.traces_table(spark, sf_dir).select(F.col("point_id").alias("pid"), F.col("user_id").alias("uid"), F.date_format("time_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), "latitude", "longitude")
    t, _ = importing.import_traces_from_dataframe(raw, views.TRACE_SCHEMA, field_correspondence={"point_id": "pid", "user_id": "uid", "time_utc": "at"})
    return t.data.select("point_id", "user_id", _time("time_utc"))


# --- cells ---------------------------------------------------------------

_VALID_SQL = "(v >> 59 = 1 AND (v >> 56) & 7 = 0 AND (v >> 45) & 127 <= 121 AND list_aggregate([CASE WHEN r <= ((v >> 52) & 15) THEN (v >> (3 * (15 - r))) & 7 < 7 ELSE (v >> (3 * (15 - r))) & 7 = 7 END FOR r IN range(1, 16)], 'bool_and'))"


@query(f"WITH {TRIPS_SQL}, c AS (SELECT DISTINCT origin_h3_index AS cell, ('0x' || origin_h3_index)::BIGINT AS v FROM trips) SELECT cell, ((v >> 52) & 15)::INTEGER AS resolution, {_parent_sql('cell', 5)} AS parent5, {_parent_sql('cell', 0)} AS parent0 FROM c")
def h3_resolution_parent(spark, sf_dir):
    c = views.trips_table(spark, sf_dir).select(F.col("origin_h3_index").alias("cell")).distinct()
    return c.select("cell", h3bits.resolution(F.col("cell")).alias("resolution"), h3bits.parent(F.col("cell"), 5).alias("parent5"), h3bits.parent(F.col("cell"), 0).alias("parent0"))


@query(f"WITH {TRIPS_SQL}, c AS (SELECT DISTINCT ('0x' || origin_h3_index)::BIGINT + k * 4398046511104 * 37 AS v FROM trips, range(0, 12) t(k)) SELECT printf('%x', v) AS cell, {_VALID_SQL} AS valid FROM c")
def h3_valid(spark, sf_dir):
    c = views.trips_table(spark, sf_dir).select(h3bits.to_long(F.col("origin_h3_index")).alias("v")).distinct()
    c = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).select((F.col("v") + F.col("k") * F.lit(4398046511104 * 37)).alias("v")).distinct()
    t = h3bits.to_text(F.col("v"))
    return c.select(t.alias("cell"), h3bits.valid(t).alias("valid"))


@query()
def latlng_to_cell(spark, sf_dir):
    df = views.traces_table(spark, sf_dir).select("latitude", "longitude").distinct()
    return df.select("latitude", "longitude", *[h3proj.cell_of(F.col("latitude"), F.col("longitude"), r).alias(f"cell{r}") for r in (5, 8)])


@query()
def cell_to_latlng(spark, sf_dir):
    c = views.trips_table(spark, sf_dir).select(F.col("origin_h3_index").alias("cell")).distinct()
    at = c.withColumn("at", h3proj.centre_of(F.col("cell")))
    return at.select("cell", F.round("at.latitude", 9).alias("latitude"), F.round("at.longitude", 9).alias("longitude"))


@query()
def infer_with_cells(spark, sf_dir):
    o = inference.InferTripsOptions(infer_mode="consecutive_clusters", cluster_radius_m=250, cluster_max_time_gap_s=200000)
    return inference.infer_trips_from_traces(views.traces(spark, sf_dir), views.TRIP_SCHEMA, options=o)[0].data.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("origin_time_utc", "destination_time_utc")})


@query(f"WITH {TRIPS_SQL} SELECT user_id, round(avg(origin_longitude), 7) AS lon, round(avg(origin_latitude), 7) AS lat FROM trips WHERE origin_latitude BETWEEN -90 AND 90 GROUP BY 1")
def utm_round_trip(spark, sf_dir):
    """Degrees to metres and back through the Parquet scan's own numbers."""
    df = views.trips_table(spark, sf_dir).filter("origin_latitude BETWEEN -90 AND 90").groupBy("user_id").agg(F.avg("origin_longitude").alias("a"), F.avg("origin_latitude").alias("b"))
    x, y = prep.projection("EPSG:5361").to_xy(F.col("a"), F.col("b"))
    back = prep.project_xy_to_latlon(df.withColumn("x", x).withColumn("y", y), "x", "y")
    return back.select("user_id", F.round("longitude", 7).alias("lon"), F.round("latitude", 7).alias("lat"))


# --- preparation and indicators -----------------------------------------


@query("SELECT n_name AS label, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def lookup_decode(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select((F.col("c_nationkey").cast("string")).alias("code")).withColumn("code", F.concat(F.lit(" \""), F.col("code"), F.lit(".0\" ")))
    return prep.decode(c, "code", views.table(spark, sf_dir, "nation"), "n_nationkey", "n_name").groupBy(F.col("code").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, string_agg(CASE p WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE p END, ';' ORDER BY p) AS priorities FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY 1")
def list_decode(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "; ").alias("p"))
    return o.select("o_custkey", prep.decode_list(F.col("p"), {"1-URGENT": "now", "5-LOW": "later"}).alias("priorities"))


_WIDE = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'bus' ELSE '-' END AS m1, CASE WHEN o_orderkey % 3 = 0 THEN 'metro' END AS m2, CASE WHEN o_orderkey % 5 = 0 THEN 'walk' ELSE 'nan' END AS m3, o_orderkey % 7 AS t1, o_orderkey % 11 AS t2, o_orderkey % 13 AS t3 FROM orders"


def _wide(spark, sf_dir):
    k = F.col("o_orderkey")
    return views.table(spark, sf_dir, "orders").select(
        k, F.when(k % 2 == 0, "bus").otherwise("-").alias("mode_1"), F.when(k % 3 == 0, "metro").alias("mode_2"), F.when(k % 5 == 0, "walk").otherwise("nan").alias("mode_3"), (k % 7).alias("t_1"), (k % 11).alias("t_2"), (k % 13).alias("t_3")
    )


@query(f"WITH w AS ({_WIDE}) SELECT o_orderkey, 1 AS stage, m1 AS mode, t1 AS t FROM w WHERE m1 = 'bus' UNION ALL SELECT o_orderkey, 2, m2, t2 FROM w WHERE m2 IS NOT NULL UNION ALL SELECT o_orderkey, 3, m3, t3 FROM w WHERE m3 = 'walk'")
def stage_unpivot(spark, sf_dir):
    return prep.stages_to_rows(_wide(spark, sf_dir), ["mode_", "t_"], ["1", "2", "3"], "mode_").select("o_orderkey", "stage", F.col("mode_").alias("mode"), F.col("t_").alias("t"))


@query(f"WITH w AS ({_WIDE}) SELECT o_orderkey, coalesce(nullif(m1, '-'), m2, nullif(m3, 'nan')) AS first, coalesce(nullif(m3, 'nan'), m2, nullif(m1, '-')) AS last FROM w")
def first_valid(spark, sf_dir):
    m = [F.col(f"mode_{i}") for i in (1, 2, 3)]
    return _wide(spark, sf_dir).select("o_orderkey", prep.first_valid(*m).alias("first"), prep.last_valid(*m).alias("last"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS movement_seq FROM lineitem")
def seq_in_group(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return prep.sequence_in_group(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("SELECT * FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_event_id FROM events) WHERE previous_event_id IS NOT NULL")
def shift_join(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return prep.previous_rows(e, "user_id", "ts", ["event_id"]).select("user_id", "event_id", "previous_event_id")


_ZONES = [("west", [(-70.903, -33.753), (-70.703, -33.753), (-70.703, -33.203), (-70.903, -33.203)]), ("slope", [(-70.703, -33.703), (-70.503, -33.603), (-70.553, -33.253)])]


@query(f"WITH {TRIPS_SQL} SELECT movement_id, CASE WHEN {_polygon_sql('origin_longitude', 'origin_latitude', _ZONES[0][1])} THEN 'west' WHEN {_polygon_sql('origin_longitude', 'origin_latitude', _ZONES[1][1])} THEN 'slope' END AS zone FROM trips")
def spatial_within(spark, sf_dir):
    return views.trips_table(spark, sf_dir).select("movement_id", prep.zone_of(F.col("origin_longitude"), F.col("origin_latitude"), _ZONES).alias("zone"))


def _zones(spark: SparkSession) -> DataFrame:
    rows = [(name, [{"lon": x, "lat": y} for x, y in ring]) for name, ring in _ZONES]
    return spark.createDataFrame(rows, "zone string, ring array<struct<lon:double,lat:double>>")


@query(f"WITH {TRIPS_SQL} " + " UNION ALL ".join(f"SELECT movement_id, '{name}' AS zone FROM trips WHERE {_polygon_sql('origin_longitude', 'origin_latitude', ring)}" for name, ring in _ZONES))
def spatial_join(spark, sf_dir):
    """Origins met with a table of polygons."""
    df = views.trips_table(spark, sf_dir).select("movement_id", "origin_longitude", "origin_latitude")
    return prep.within_polygons(df, "origin_longitude", "origin_latitude", _zones(spark), "ring").select("movement_id", "zone")


@query("""WITH t AS (SELECT l_partkey, l_suppkey, l_linestatus, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_linestatus) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l.l_partkey, l.l_suppkey, t.l_linestatus AS label FROM lineitem l LEFT JOIN t ON t.l_partkey = l.l_partkey AND t.l_suppkey = l.l_suppkey AND n = 1 AND t.l_suppkey % 3 <> 0""")
def join_two_keys(spark, sf_dir):
    """The first label of two keys for every row; a third of the keys has none."""
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    labels = views.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_shipdate").filter(F.col("l_suppkey") % 3 != 0)
    return prep.join_first(li, labels, {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"}, {"l_linestatus": "label"}, order=["l_shipdate"])


@query("SELECT o_orderkey, o_custkey, o_orderpriority AS label, c_mktsegment, c.label AS label_customer FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment, c_name AS label FROM customer WHERE c_custkey % 2 = 0) c ON c_custkey = o_custkey")
def join_suffixed(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label"))
    c = views.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_name").alias("label"))
    return prep.join_suffixed(o, c, ["o_custkey"], "_customer")


_STAGES_SQL = """w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 3)::VARCHAR ELSE '-' END AS etapas,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'S-' || o_custkey END AS up1, CASE WHEN o_orderkey % 7 <> 0 THEN 'S-' || (o_custkey + 1) ELSE '-' END AS down1,
  CASE WHEN o_orderkey % 3 = 0 THEN 'S-' || (o_custkey + 2) ELSE '' END AS up2, CASE WHEN o_orderkey % 9 = 0 THEN 'S-' || (o_custkey + 3) END AS down2 FROM orders)"""


@query(f"""WITH {_STAGES_SQL} SELECT id, coalesce(try_cast(etapas AS INTEGER), CASE WHEN up2 <> '' OR down2 IS NOT NULL THEN 2 WHEN up1 IS NOT NULL OR down1 <> '-' THEN 1 ELSE 0 END) AS stages_found,
  coalesce(up1, nullif(up2, '')) AS paraderosubida, coalesce(down2, nullif(down1, '-')) AS paraderobajada FROM w""")
def smart_card_trips(spark, sf_dir):
    """Orders as wide trips of two stages: what boards first and alights last."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stop = lambda n: F.concat(F.lit("S-"), (c + n).cast("string"))
    wide = views.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 2 == 0, (k % 3).cast("string")).otherwise("-").alias("etapas"),
        F.when(k % 5 != 0, stop(0)).alias("paraderosubida_1era"),
        F.when(k % 7 != 0, stop(1)).otherwise("-").alias("paraderobajada_1era"),
        F.when(k % 3 == 0, stop(2)).otherwise("").alias("paraderosubida_2da"),
        F.when(k % 9 == 0, stop(3)).alias("paraderobajada_2da"),
    )
    stops = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("S-"), F.col("c_custkey").cast("string")).alias("stop"), (F.lit(300_000) + F.col("c_custkey")).alias("x"), (F.lit(6_300_000) + F.col("c_custkey")).alias("y"))
    layout = raw_profiles.layout_of({"trip_level": ["id"], "stage_1": ["paraderosubida_1era", "paraderobajada_1era"], "stage_2": ["paraderosubida_2da", "paraderobajada_2da"]})
    return raw_profiles.smart_card_trips(wide, stops, layout, stop="stop").select("id", "stages_found", "paraderosubida", "paraderobajada")


@query(f"""WITH {TRACES_SQL}, places AS (SELECT s_suppkey, -70.9::DOUBLE + (s_suppkey % 40) * 0.01::DOUBLE AS lon, -33.7::DOUBLE + (s_suppkey % 50) * 0.01::DOUBLE AS lat FROM supplier),
 inside AS (SELECT * FROM places WHERE {_polygon_sql('lon', 'lat', _ZONES[0][1])} OR {_polygon_sql('lon', 'lat', _ZONES[1][1])}),
 visits AS (SELECT user_id, time_utc, s_suppkey, point_id FROM traces JOIN inside ON s_suppkey = k % 10 + 1),
 pairs AS (SELECT user_id, s_suppkey AS venue, time_utc, lag(time_utc) OVER (PARTITION BY user_id ORDER BY time_utc, s_suppkey) AS before FROM visits)
 SELECT user_id, strftime(before, '%Y-%m-%d %H:%M:%S') AS origin, strftime(time_utc, '%Y-%m-%d %H:%M:%S') AS destination FROM pairs WHERE before IS NOT NULL""")
def checkin_trips(spark, sf_dir):
    """Points as check-ins at suppliers: consecutive ones inside the zones."""
    visits = views.traces_table(spark, sf_dir).select("user_id", (F.col("k") % 10 + 1).alias("venue_id"), F.col("time_utc").alias("datetime"))
    n = F.col("s_suppkey")
    venues = views.table(spark, sf_dir, "supplier").select(n.cast("long").alias("venue_id"), (F.lit(-70.9) + (n % 40) * F.lit(0.01)).alias("lon"), (F.lit(-33.7) + (n % 50) * F.lit(0.01)).alias("lat"), F.col("s_name").alias("category"))
    out = raw_profiles.checkin_trips(visits, venues, _zones(spark))
    return out.select("user_id", F.date_format("origin_datetime", "yyyy-MM-dd HH:mm:ss").alias("origin"), F.date_format("destination_datetime", "yyyy-MM-dd HH:mm:ss").alias("destination"))


_FLOW_SQL = "f AS (SELECT origin_h3_index, destination_h3_index, count(*) AS flow_count, sum(trip_weight) AS flow_value FROM trips WHERE destination_h3_index IS NOT NULL GROUP BY ALL)"


@query(f"WITH {TRIPS_SQL}, {_FLOW_SQL} SELECT origin_h3_index, destination_h3_index, round(flow_value, 2) AS flow_value FROM f ORDER BY flow_value DESC, origin_h3_index, destination_h3_index LIMIT 10")
def top_flows(spark, sf_dir):
    return prep.top_flows(_build(spark, sf_dir).flows, 10).select("origin_h3_index", "destination_h3_index", F.round("flow_value", 2).alias("flow_value"))


@query(f"WITH {TRIPS_SQL}, {_FLOW_SQL} SELECT destination_h3_index AS cell, round(sum(flow_value), 2) AS value FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_destinations(spark, sf_dir):
    return prep.top_places(_build(spark, sf_dir).flows, "destination", 10).select("cell", F.round("value", 2).alias("value"))


@query(f"WITH {TRIPS_SQL}, {_FLOW_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY flow_value DESC, origin_h3_index, destination_h3_index) AS n FROM f) SELECT count(*)::BIGINT AS flows, round(sum(flow_value), 2) AS total, round(sum(flow_value) FILTER (n <= 10) / sum(flow_value), 9) AS top_share, round(coalesce(sum(flow_value) FILTER (origin_h3_index = destination_h3_index), 0) / sum(flow_value), 9) AS intrazonal_share FROM r")
def coverage_ratio(spark, sf_dir):
    k = prep.flow_indicators(_build(spark, sf_dir).flows)
    return k.select("flows", F.round("total", 2).alias("total"), F.round("top_share", 9).alias("top_share"), F.round("intrazonal_share", 9).alias("intrazonal_share"))


@query(f"WITH {TRIPS_SQL} SELECT mode, count(trip_weight)::BIGINT AS n, quantile_cont(trip_weight, 0.25) AS q1, quantile_cont(trip_weight, 0.5) AS median, quantile_cont(trip_weight, 0.75) AS q3, quantile_cont(trip_weight, 0.75) - quantile_cont(trip_weight, 0.25) AS iqr FROM trips GROUP BY 1")
def percentile_iqr(spark, sf_dir):
    return prep.spread(views.trips_table(spark, sf_dir), ["mode"], "trip_weight")


@query(f"WITH {TRIPS_SQL} SELECT purpose AS value, count(*)::BIGINT AS n FROM trips GROUP BY 1")
def value_counts(spark, sf_dir):
    return prep.value_counts(views.trips_table(spark, sf_dir), "purpose")


@query(f"WITH {TRIPS_SQL}, {_FLOW_SQL} SELECT origin_h3_index, destination_h3_index, flow_count::BIGINT AS flow_count FROM f WHERE origin_h3_index = '{_CELLS[0]}' OR destination_h3_index = '{_CELLS[0]}'")
def neighbourhood(spark, sf_dir):
    return prep.neighbourhood(_build(spark, sf_dir).flows, _CELLS[0]).select("origin_h3_index", "destination_h3_index", "flow_count")


@query(f"""WITH {TRIPS_SQL}, {_FLOW_SQL}, touched AS (SELECT * FROM f WHERE origin_h3_index = '{_CELLS[0]}' OR destination_h3_index = '{_CELLS[0]}')
SELECT id FROM (SELECT origin_h3_index AS id FROM f UNION SELECT destination_h3_index FROM f)
WHERE id = '{_CELLS[0]}' OR id IN (SELECT origin_h3_index FROM touched UNION SELECT destination_h3_index FROM touched)""")
def related_locations(spark, sf_dir):
    flows = _build(spark, sf_dir).flows
    locations = flows.select(F.explode(F.array("origin_h3_index", "destination_h3_index")).alias("id")).distinct()
    return prep.related_locations(flows, locations, _CELLS[0])


@query("SELECT hour(ts - INTERVAL 5 HOUR)::INTEGER AS local_hour, count(*)::BIGINT AS n FROM events GROUP BY 1")
def local_hour(spark, sf_dir):
    t = views.traces_table(spark, sf_dir)
    return t.groupBy(timeutil.local_hour(F.col("time_utc"), "America/Jamaica").alias("local_hour")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRIPS_SQL}, {_FLOW_SQL} SELECT DISTINCT id, true AS located FROM (SELECT origin_h3_index AS id FROM f UNION ALL SELECT destination_h3_index FROM f)")
def export_locations(spark, sf_dir):
    return export.locations(_build(spark, sf_dir).flows).select("id", F.expr("coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)").alias("located"))


@query(f"WITH {TRIPS_SQL}, {_FLOW_SQL} SELECT origin_h3_index AS origin, destination_h3_index AS dest, round(flow_value, 2) AS count, flow_count::BIGINT AS flow_count FROM f")
def export_layout(spark, sf_dir):
    """The written flows.csv, read again."""
    result, _ = export.export_flows(_build(spark, sf_dir), _shared(spark), options=export.ExportFlowsOptions(folder_name="flows", extra_flow_fields=["flow_count"]))
    df = spark.read.csv(result.artifacts["flows.csv"], header=True)
    return df.select("origin", "dest", F.round(F.col("count").cast("double"), 2).alias("count"), F.col("flow_count").cast("long").alias("flow_count"))


def _shared(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}"
    return f"{root.rstrip('/')}/viaflux-{uuid.uuid4().hex}"


@query(f"WITH {TRIPS_SQL} SELECT movement_id, user_id, mode, trip_weight FROM trips")
def trips_parquet_round_trip(spark, sf_dir):
    at, _ = artifacts.write_trips(views.trips(spark, sf_dir), f"{_shared(spark)}/trips")
    return artifacts.read_trips(spark, at)[0].data.select("movement_id", "user_id", "mode", "trip_weight")


@query(f"WITH {TRIPS_SQL}, {_FLOW_SQL} SELECT origin_h3_index, destination_h3_index, flow_count::BIGINT AS flow_count, round(flow_value, 2) AS flow_value FROM f")
def flows_feather_round_trip(spark, sf_dir):
    at, _ = artifacts.write_flows(_build(spark, sf_dir), f"{_shared(spark)}/flows", options=artifacts.WriteOptions(storage_format="feather", require_validated=False))
    return artifacts.read_flows(spark, at)[0].flows.select("origin_h3_index", "destination_h3_index", "flow_count", F.round("flow_value", 2).alias("flow_value"))


@query(f"WITH {TRIPS_SQL} SELECT origin_h3_index, destination_h3_index, strftime(date_trunc('week', origin_time_utc), '%Y-%m-%d %H:%M:%S') AS window_start_utc, count(*)::BIGINT AS flow_count, round(sum(trip_weight), 2) AS flow_value FROM trips WHERE destination_h3_index IS NOT NULL GROUP BY ALL")
def flows_windowed(spark, sf_dir):
    """The streaming plan of weekly flows, run on a table."""
    out = stream.windowed_flows(views.trips_table(spark, sf_dir), grain="week")
    return out.select("origin_h3_index", "destination_h3_index", _time("window_start_utc"), "flow_count", F.round("flow_value", 2).alias("flow_value"))


__all__ = ["ORACLES", "QUERIES", "coerce", "dt", "timeutil"]
