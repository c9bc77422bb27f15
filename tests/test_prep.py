"""Joins with code tables, stops and zones, and projections by code."""

import math

import pytest
from pyspark.sql import functions as F

from viaflux.functions import geo, prep


def test_join_first_keeps_each_row_once(spark):
    df = spark.createDataFrame([(1, "7", "a", "old"), (2, "7.0", "b", "old"), (3, None, "a", "old"), (4, "9", "a", "old")], "k int, home string, who string, label string")
    table = spark.createDataFrame([("7", "a", "x", 2), ("7", "a", "y", 1), ("7", "b", "z", 1), (None, "a", "null", 1)], "h string, w string, l string, at int")
    out = prep.join_first(df, table, {"home": "h", "who": "w"}, {"l": "label"}, order=["at"])
    assert {r["k"]: r["label"] for r in out.collect()} == {1: "y", 2: "z", 3: None, 4: None} and out.columns == df.columns


def test_join_suffixed(spark):
    a = spark.createDataFrame([(1, 2, "p"), (1, 3, "q")], "home int, person int, sex string")
    b = spark.createDataFrame([(1, 2, "r", 5)], "home int, person int, sex string, age int")
    assert sorted(map(tuple, prep.join_suffixed(a, b, ["home", "person"], "_person").collect())) == [(1, 2, "p", "r", 5), (1, 3, "q", None, None)]


@pytest.mark.parametrize("code,form", [("PA-12", "PA-12"), ("12-PA", "PA-12"), ("T-12-PA", "T-PA-12"), ("Ñuñoa`", "NUNOA"), (" Baquedano ", "BAQUEDANO"), ("-", None), ("nan", None), (None, None)])
def test_stop_code(spark, code, form):
    assert spark.createDataFrame([(code,)], "c string").select(prep.stop_code(F.col("c"))).first()[0] == form


def test_stops_are_located(spark):
    trips = spark.createDataFrame([(1, "12-PA"), (2, "Ñuñoa"), (3, "?"), (4, None)], "k int, up string")
    stops = spark.createDataFrame([("PA-12", 1.0, 2.0), ("NUNOA", 3.0, 4.0), ("NUNOA", 3.0, 9.0), (None, 0.0, 0.0)], "code string, x double, y double")
    out = prep.locate_stops(trips, "up", stops, stop="code", into=("up_x", "up_y"))
    assert sorted(map(tuple, out.select("k", "up_x", "up_y").collect())) == [(1, 1.0, 2.0), (2, 3.0, 4.0), (3, None, None), (4, None, None)]


def test_points_meet_the_polygons_that_hold_them(spark):
    rings = {"l": [(0.0, 0.0), (0.1, 0.0), (0.1, 0.05), (0.05, 0.05), (0.05, 0.1), (0.0, 0.1)], "t": [(0.03, 0.03), (0.15, 0.04), (0.08, 0.15)]}
    zones = spark.createDataFrame([(n, [{"lon": x, "lat": y} for x, y in ring + ring[:1]]) for n, ring in rings.items()], "zone string, ring array<struct<lon:double,lat:double>>")
    points = spark.range(400).select("id", ((F.col("id") % 20) * 0.0081 - 0.001).alias("x"), (F.floor(F.col("id") / 20) * 0.0079 - 0.001).alias("y"))
    got = {(r["id"], r["zone"]) for r in prep.within_polygons(points, "x", "y", zones, "ring").collect()}
    shown = points.select("id", *[geo.in_polygon(F.col("x"), F.col("y"), ring).alias(n) for n, ring in rings.items()]).collect()
    assert got == {(r["id"], n) for r in shown for n in rings if r[n]} and len(got) > 100


def test_every_zone_has_its_meridian(spark):
    for crs, lon, lat in (("EPSG:32633", 15.0, 52.0), ("epsg:32719", -69.0, -33.0), ("25830", -3.0, 40.0), ("EPSG:5361", -69.0, -33.0)):
        grid = prep.projection(crs)
        x, y = grid.to_xy(F.lit(lon), F.lit(lat))
        r = spark.range(1).select(x.alias("x"), y.alias("y"), *[c.alias(n) for n, c in zip(("lon", "lat"), grid.to_lonlat(x, y), strict=True)]).first()
        assert math.isclose(r["x"], 500_000, abs_tol=1e-6) and math.isclose(r["lon"], lon, abs_tol=1e-9) and math.isclose(r["lat"], lat, abs_tol=1e-9) and (r["y"] > 6e6) == (lat < 0)
    for crs in ("EPSG:32661", "EPSG:4326", "utm"):
        with pytest.raises(ValueError):
            prep.projection(crs)
