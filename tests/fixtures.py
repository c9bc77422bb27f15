"""Small hand-checked trips, flows and points."""

import datetime as dt

from viaflux.datasets import TripDataset
from viaflux.schema import DomainSpec, EffectiveSchema, FieldSpec, TraceSchema, TripSchema

A, B, C, D = "8828308281fffff", "8828308285fffff", "882830828dfffff", "8828308287fffff"


def at(h, m=0, day=1):
    return dt.datetime(2026, 4, day, h, m)


SCHEMA = TripSchema(
    "1.0",
    {
        f.name: f
        for f in (
            FieldSpec("movement_id", "string", True),
            FieldSpec("user_id", "string"),
            FieldSpec("origin_longitude", "float"),
            FieldSpec("origin_latitude", "float"),
            FieldSpec("destination_longitude", "float"),
            FieldSpec("destination_latitude", "float"),
            FieldSpec("origin_time_utc", "datetime"),
            FieldSpec("destination_time_utc", "datetime"),
            FieldSpec("origin_h3_index", "string", True, {"h3": {"require_valid": True}}),
            FieldSpec("destination_h3_index", "string", True),
            FieldSpec("trip_id", "string"),
            FieldSpec("movement_seq", "int"),
            FieldSpec("mode", "categorical", domain=DomainSpec(["bus", "metro"])),
            FieldSpec("purpose", "string"),
            FieldSpec("trip_weight", "float", constraints={"range": {"min": 0, "max": 2.5}}),
        )
    },
    ["movement_id", "origin_h3_index", "destination_h3_index"],
)
TRACES = TraceSchema("1.0", {f.name: f for f in (FieldSpec("point_id", "string", True), FieldSpec("user_id", "string", True), FieldSpec("time_utc", "datetime", True), FieldSpec("latitude", "float", True), FieldSpec("longitude", "float", True))}, ["point_id", "user_id", "time_utc", "latitude", "longitude"], timezone="America/Santiago")


def dataset(df, validated=True):
    dtypes = {n: f.dtype for n, f in SCHEMA.fields.items()}
    return TripDataset(df, SCHEMA, metadata={"is_validated": validated, "temporal": {"tier": "tier_1"}}, effective=EffectiveSchema(dtypes, temporal={"tier": "tier_1"}))


def trips(spark):
    rows = [
        ("m0", A, B, at(8, 10), at(8, 40), "bus", "work", 1.0, -70.66, -33.45),
        ("m1", A, B, at(8, 20), at(8, 50), "bus", None, 2.0, -70.60, -33.40),
        ("m2", A, B, at(8, 45), at(9, 5), "metro", "study", 1.5, -70.50, -33.30),
        ("m3", C, D, at(9, 10), at(9, 0), "bus", "work", 3.0, None, -33.45),
    ]
    df = spark.createDataFrame(rows, "movement_id string, origin_h3_index string, destination_h3_index string, origin_time_utc timestamp, destination_time_utc timestamp, mode string, purpose string, trip_weight double, origin_longitude double, origin_latitude double")
    return dataset(df)
