"""Profiles of raw sources on small tables, up to the import."""

import json

import pytest

from tests.fixtures import SCHEMA
from viaflux.functions import prep
from viaflux.operators.importing import ImportOptions
from viaflux.sources import raw_profiles
from viaflux.sources.profiles import import_trips_from_profile

LAYOUT = {"trip_level": ["id", "etapas", "absent"], "stage_1": ["tipo_1era", "paraderosubida_1era", "paraderobajada_1era"], "stage_2": ["tipo_2da", "paraderosubida_2da", "paraderobajada_2da"]}


def test_layout_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps(LAYOUT))
    want = raw_profiles.layout_of(LAYOUT)
    assert raw_profiles.read_layout(spark, f"{tmp_path}/l.json") == want and len(want.stages) == 2 and want.trip_level == ("id", "etapas", "absent")
    pytest.importorskip("yaml")
    (tmp_path / "l.yaml").write_text("trip_level: [id, etapas, absent]\nstage_1:\n- tipo_1era\n- paraderosubida_1era\n- paraderobajada_1era\nstage_2: [tipo_2da, paraderosubida_2da, paraderobajada_2da]\n")
    assert raw_profiles.read_layout(spark, f"{tmp_path}/l.yaml") == want
    (tmp_path / "e.yaml").write_text("")
    assert raw_profiles.read_layout(spark, f"{tmp_path}/e.yaml") == raw_profiles.StageLayout((), ())


@pytest.mark.parametrize("name,stem", [("paraderosubida_1era", "paraderosubida"), ("t_2da_etapa", "t"), ("zona_3", "zona"), ("factor_5", "factor_5"), ("subida", "subida")])
def test_stage_stems(name, stem):
    assert raw_profiles.stage_stem(name) == stem


def test_smart_card(spark):
    x, y = 346_000, 6_297_000
    df = spark.createDataFrame(
        [("a", "2", "BUS", "12-PA", "Ñuñoa", "METRO", "NUNOA", "PA-13"), ("b", "?", "BUS", "PA-13", "-", None, "-", None), ("c", None, None, "nan", None, "-", "", None), ("d", "9", None, None, None, "METRO", "x", None)],
        "id string, etapas string, tipo_1era string, paraderosubida_1era string, paraderobajada_1era string, tipo_2da string, paraderosubida_2da string, paraderobajada_2da string",
    )
    stops = spark.createDataFrame([("PA-12", f"{x},0", f"{y}"), ("PA-13", f"{x + 1000}", f"{y}"), ("Ñuñoa", "0", "0")], "code string, x string, y string")
    out = raw_profiles.smart_card_trips(df, stops, raw_profiles.layout_of(LAYOUT), stop="code")
    assert out.columns == ["id", "etapas", "stages_found", "paraderosubida", "paraderobajada", "subida_lon", "subida_lat", "bajada_lon", "bajada_lat"]
    r = {x["id"]: x for x in out.collect()}
    assert {k: (v["stages_found"], v["paraderosubida"], v["paraderobajada"]) for k, v in r.items()} == {"a": (2, "12-PA", "PA-13"), "b": (1, "PA-13", None), "c": (0, None, None), "d": (2, "x", None)}
    assert abs(r["a"]["subida_lat"] + 33.45) < 0.1 and r["a"]["bajada_lon"] > r["a"]["subida_lon"] and r["b"]["bajada_lon"] is None and r["d"]["subida_lat"] is None
    profile = raw_profiles.smart_card_profile(
        stops, raw_profiles.layout_of(LAYOUT), stop="code", fields={"movement_id": "id", "origin_longitude": "subida_lon", "origin_latitude": "subida_lat", "destination_longitude": "bajada_lon", "destination_latitude": "bajada_lat"}, options=ImportOptions(keep_extra_fields=False, single_stage=True)
    )
    trips, report = import_trips_from_profile(df, profile, SCHEMA)
    got = {r["movement_id"]: r["origin_h3_index"] for r in trips.data.select("movement_id", "origin_h3_index").collect()}
    assert got["a"].startswith("88") and set(got) >= {"a", "b"}


def test_household(spark):
    df = spark.createDataFrame([(1, 1, "2.0", "1;3", "346000,0", "6297000", None, "1,5"), (1, 2, "9", "", "0", "0", "2", "1")], "home int, person int, purpose string, modes string, ox string, oy string, w1 string, w2 string")
    persons = spark.createDataFrame([(1, 1, "f", "x")], "home int, person int, sex string, purpose string")
    homes = spark.createDataFrame([(1, "north")], "home int, area string")
    code = spark.createDataFrame([("2", "work"), ("3", "study")], "k string, label string")
    out = raw_profiles.household_trips(
        df, persons=persons, person_keys=["home", "person"], households=homes, household_keys=["home"], codes={"purpose": code, "absent": code}, lists={"modes": {"1": "bus", "3": "walk"}}, coordinates={("ox", "oy"): ("lon", "lat")}, weights=["w0", "w1", "w2"]
    )
    r = {x["person"]: x.asDict() for x in out.collect()}
    assert (r[1]["purpose"], r[1]["modes"], r[1]["sex"], r[1]["purpose_person"], r[1]["area"]) == ("work", "bus;walk", "f", "x", "north")
    assert (r[2]["purpose"], r[2]["modes"], r[2]["sex"], r[2]["lon"], r[2]["trip_weight_src"]) == ("9", None, None, None, 2.0)
    assert abs(r[1]["lat"] + 33.45) < 0.1 and "ox" not in out.columns


def test_checkins(spark):
    zones = spark.createDataFrame([([{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}, {"lon": 0.0, "lat": 1.0}],), ([{"lon": 0.5, "lat": 0.0}, {"lon": 2.0, "lat": 0.0}, {"lon": 2.0, "lat": 1.0}, {"lon": 0.5, "lat": 1.0}],)], "ring array<struct<lon:double,lat:double>>")
    venues = spark.createDataFrame([("v1", "0.2", "0.2", "home"), ("v2", "0.7", "0.7", "work"), ("v3", "5", "5", "out"), ("v4", "n/a", "0.1", "?")], "venue_id string, lon string, lat string, category string")
    visits = spark.createDataFrame([("u1", "v1", "08"), ("u1", "v3", "09"), ("u1", "v2", "10"), ("u1", "v1", "11"), ("u2", "v2", "08"), (None, "v1", "07"), ("u2", "v4", "09")], "user_id string, venue_id string, datetime string")
    out = raw_profiles.checkin_trips(visits, venues, zones)
    rows = sorted(map(tuple, out.select("trip_id", "user_id", "origin_category", "destination_category", "origin_datetime", "destination_datetime", "movement_id_src").collect()))
    assert rows == [(0, "u1", "home", "work", "08", "10", "0"), (1, "u1", "work", "home", "10", "11", "1")]
    trips, _ = import_trips_from_profile(visits, raw_profiles.checkin_profile(venues, zones), SCHEMA, options=ImportOptions(keep_extra_fields=False))
    assert sorted(r["movement_id"] for r in trips.data.select("movement_id").collect()) == ["0", "1"]
    assert prep.fingerprint(raw_profiles.checkin_trips(visits.filter("false"), venues, zones)).first()["rows"] == 0
