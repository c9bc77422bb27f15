"""Trips, traces and zones as views of the driver's tables.

The same views exist in SQL (`TRIPS_SQL`, `TRACES_SQL`) for the oracles. Cells
are made by bit arithmetic from integer keys, so that validity, resolution and
roll-up are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..datasets import TraceDataset, TripDataset
from ..schema import DomainSpec, EffectiveSchema, FieldSpec, TraceSchema, TripSchema

#: A cell of resolution 8 on base cell 20: seven digits of base 7 from a key, the first digit 3, the rest unused.
_HEAD = (1 << 59) | (8 << 52) | (20 << 45) | (3 << 42)
_TAIL = (1 << 21) - 1


def cell_id(key: Column) -> Column:
    v = F.lit(_HEAD | _TAIL).cast("long")
    for k in range(7):
        v = v + F.shiftleft(F.floor(key / 7**k).cast("long") % 7, 21 + 3 * k)
    return F.lower(F.hex(v))


def _cell_sql(key: str) -> str:
    return f"printf('%x', {_HEAD | _TAIL} + " + " + ".join(f"((({key}) // {7**k}) % 7) * {1 << (21 + 3 * k)}" for k in range(7)) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timestamp(c: str) -> Column:
    """A time column of the tables (without a zone) as a UTC timestamp."""
    return F.col(c).cast("timestamp")


MODES = ["A", "N", "R"]
TRIP_SCHEMA = TripSchema(
    "1.0",
    {
        f.name: f
        for f in (
            FieldSpec("movement_id", "string", True, {"unique": True}),
            FieldSpec("user_id", "string", True, {"pattern": r"[0-9]+"}),
            FieldSpec("origin_longitude", "float", False, {"range": {"min": -180, "max": 180}}),
            FieldSpec("origin_latitude", "float", False, {"range": {"min": -90, "max": 90}}),
            FieldSpec("destination_longitude", "float", False, {"range": {"min": -180, "max": 180}}),
            FieldSpec("destination_latitude", "float", False, {"range": {"min": -90, "max": 90}}),
            FieldSpec("origin_time_utc", "datetime", True),
            FieldSpec("destination_time_utc", "datetime", True),
            FieldSpec("origin_h3_index", "string", True, {"h3": {"require_valid": True, "resolution": 8}}),
            FieldSpec("destination_h3_index", "string", False, {"h3": {"require_valid": True, "resolution": 8}}),
            FieldSpec("trip_id", "string", True),
            FieldSpec("movement_seq", "int", True),
            FieldSpec("mode", "categorical", False, domain=DomainSpec(MODES)),
            FieldSpec("purpose", "categorical", False, {"nullable": True}, DomainSpec(["1-URGENT", "2-HIGH", "3-MEDIUM"], True)),
            FieldSpec("trip_weight", "float", False, {"range": {"min": 0, "max": 45}}),
            FieldSpec("segment", "string", False, {"length": {"min": 4, "max": 9}}),
        )
    },
    ["movement_id", "user_id", "origin_time_utc", "destination_time_utc", "origin_h3_index", "trip_id", "movement_seq"],
)


def trips_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trips from the customer's zone to the supplier's; only needed columns are read."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    movement = F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    to = F.col("s_nationkey") * 53 + F.col("l_suppkey") % 5
    return j.select(
        movement.alias("movement_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.when(F.col("o_custkey") % 97 != 0, F.lit(-70.9) + (F.col("o_custkey") % 40) * F.lit(0.01)).alias("origin_longitude"),
        F.when(F.col("o_custkey") % 97 != 0, F.when(F.col("o_custkey") % 101 == 0, F.lit(95.0)).otherwise(F.lit(-33.7) + (F.col("o_custkey") % 50) * F.lit(0.01))).alias("origin_latitude"),
        F.when(F.col("l_suppkey") % 31 != 0, F.lit(-70.9) + (F.col("l_suppkey") % 40) * F.lit(0.01)).alias("destination_longitude"),
        (F.lit(-33.7) + (F.col("l_suppkey") % 50) * F.lit(0.01)).alias("destination_latitude"),
        timestamp("o_orderdate").alias("origin_time_utc"),
        timestamp("l_shipdate").alias("destination_time_utc"),
        cell_id(F.col("c_nationkey") * 53 + F.col("o_custkey") % 5).alias("origin_h3_index"),
        F.when(F.col("l_suppkey") % 23 != 0, cell_id(to)).alias("destination_h3_index"),
        F.col("l_orderkey").cast("string").alias("trip_id"),
        F.col("l_linenumber").cast("long").alias("movement_seq"),
        F.col("l_returnflag").alias("mode"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("purpose"),
        F.col("l_quantity").cast("double").alias("trip_weight"),
        F.col("c_mktsegment").alias("segment"),
    )


TRIPS_SQL = f"""trips AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS movement_id, o_custkey::VARCHAR AS user_id,
    CASE WHEN o_custkey % 97 <> 0 THEN -70.9::DOUBLE + (o_custkey % 40) * 0.01::DOUBLE END AS origin_longitude,
    CASE WHEN o_custkey % 97 <> 0 THEN CASE WHEN o_custkey % 101 = 0 THEN 95.0::DOUBLE ELSE -33.7::DOUBLE + (o_custkey % 50) * 0.01::DOUBLE END END AS origin_latitude,
    CASE WHEN l_suppkey % 31 <> 0 THEN -70.9::DOUBLE + (l_suppkey % 40) * 0.01::DOUBLE END AS destination_longitude,
    -33.7::DOUBLE + (l_suppkey % 50) * 0.01::DOUBLE AS destination_latitude,
    o_orderdate::TIMESTAMP AS origin_time_utc, l_shipdate::TIMESTAMP AS destination_time_utc,
    {_cell_sql('c_nationkey * 53 + o_custkey % 5')} AS origin_h3_index,
    CASE WHEN l_suppkey % 23 <> 0 THEN {_cell_sql('s_nationkey * 53 + l_suppkey % 5')} END AS destination_h3_index,
    l_orderkey::VARCHAR AS trip_id, l_linenumber::BIGINT AS movement_seq, l_returnflag AS mode, nullif(o_orderpriority, '5-LOW') AS purpose,
    l_quantity::DOUBLE AS trip_weight, c_mktsegment AS segment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def trips(spark: SparkSession, sf_dir: str, *columns: str) -> TripDataset:
    """The trips view as a dataset; it counts as validated so that builds run."""
    df = trips_table(spark, sf_dir)
    df = df.select(*columns) if columns else df
    dtypes = {n: f.dtype for n, f in TRIP_SCHEMA.fields.items() if n in df.columns}
    return TripDataset(df, TRIP_SCHEMA, metadata={"is_validated": True, "temporal": {"tier": "tier_1"}, "events": []}, effective=EffectiveSchema(dtypes, temporal={"tier": "tier_1"}, fields=df.columns))


TRACE_SCHEMA = TraceSchema(
    "1.0",
    {
        f.name: f
        for f in (
            FieldSpec("point_id", "string", True, {"unique": True}),
            FieldSpec("user_id", "string", True),
            FieldSpec("time_utc", "datetime", True),
            FieldSpec("latitude", "float", True, {"range": {"min": -90, "max": 90}}),
            FieldSpec("longitude", "float", True, {"range": {"min": -180, "max": 180}}),
            FieldSpec("location_ref", "string", False, {"pattern": "[a-z]+"}),
        )
    },
    ["point_id", "user_id", "time_utc", "latitude", "longitude"],
)


def traces_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points; places follow from the user and the event's number."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.concat(F.lit("p"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("point_id"),
        F.col("user_id").cast("string").alias("user_id"),
        timestamp("ts").alias("time_utc"),
        (F.lit(-33.5) + (F.col("user_id") % 20) * F.lit(0.01) + (k % 7) * F.lit(0.001)).alias("latitude"),
        (F.lit(-70.7) + (F.col("user_id") % 15) * F.lit(0.01) + (k % 5) * F.lit(0.001)).alias("longitude"),
        F.col("event_type").alias("location_ref"),
        k.alias("k"),
        F.col("value").alias("weight"),
    )


TRACES_SQL = """traces AS (
  SELECT 'p' || lpad(event_id::VARCHAR, 12, '0') AS point_id, user_id::VARCHAR AS user_id, ts::TIMESTAMP AS time_utc,
    -33.5::DOUBLE + (user_id % 20) * 0.01::DOUBLE + (k % 7) * 0.001::DOUBLE AS latitude,
    -70.7::DOUBLE + (user_id % 15) * 0.01::DOUBLE + (k % 5) * 0.001::DOUBLE AS longitude, event_type AS location_ref, k, value AS weight
  FROM (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events))
"""


def traces(spark: SparkSession, sf_dir: str) -> TraceDataset:
    return TraceDataset(traces_table(spark, sf_dir), TRACE_SCHEMA, metadata={"is_validated": True, "dataset_id": "traces"})
