import json

from pyspark.sql import functions as F

from tests.fixtures import SCHEMA
from viaflux.functions import prep
from viaflux.operators.cleaning import CleanOptions, clean_trips
from viaflux.operators.importing import ImportOptions, import_trips_from_dataframe
from viaflux.sources import readers, synthetic


def test_synthetic_trips_are_stable_and_have_their_defects(spark):
    o = synthetic.SyntheticOptions(rows=2000, seed=5, coordinates="mixed", null_ratio=0.1, duplicate_ratio=0.05, corrupt_ratio=0.1)
    a, b = synthetic.trips(spark, o), synthetic.trips(spark, o, partitions=7)
    assert prep.fingerprint(a).first() == prep.fingerprint(b).first()
    assert prep.fingerprint(synthetic.trips(spark, synthetic.SyntheticOptions(rows=2000, seed=6))).first() != prep.fingerprint(a).first()
    counts = a.agg(F.countDistinct("movement_id").alias("ids"), F.count_if(F.col("origin_latitude").isNull()).alias("holes"), F.count_if(F.col("trip_weight") == "n/d").alias("bad"), F.count_if(F.col("origin_longitude").isNull() != F.col("origin_latitude").isNull()).alias("half")).first()
    assert 1850 < counts["ids"] < 1950 and 150 < counts["holes"] < 250 and 150 < counts["bad"] < 250 and counts["half"] == 0


def test_every_coordinate_format_imports_alike(spark):
    got = []
    for kind in ("number", "dot", "comma", "dm", "dms"):
        raw = synthetic.trips(spark, synthetic.SyntheticOptions(rows=50, seed=1, coordinates=kind))
        t, _ = import_trips_from_dataframe(raw, SCHEMA, options=ImportOptions(keep_extra_fields=False))
        got.append({r["movement_id"]: (round(r["origin_latitude"], 5), r["origin_h3_index"]) for r in t.data.select("movement_id", "origin_latitude", "origin_h3_index").collect()})
    assert all({k: v[0] for k, v in g.items()} == {k: v[0] for k, v in got[0].items()} for g in got) and len(got[0]) == 50
    t, _ = import_trips_from_dataframe(synthetic.trips(spark, synthetic.SyntheticOptions(rows=300, duplicate_ratio=0.2)), SCHEMA)
    cleaned, report = clean_trips(t, options=CleanOptions(drop_duplicates=True, duplicates_subset=["movement_id"]))
    assert cleaned.data.count() == t.data.select("movement_id").distinct().count() == report.summary["rows_out"]


def test_tiers(spark):
    for tier, column in (("tier_2", "origin_time_local_hhmm"), ("tier_3", "mode")):
        df = synthetic.trips(spark, synthetic.SyntheticOptions(rows=5, tier=tier))
        assert column in df.columns and "origin_time_utc" not in df.columns


def test_text_and_geojson(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;año\n1;dos\n2;tré\n".encode("latin-1"))
    df = readers.delimited(spark, f"{tmp_path}/a.csv", encoding="ISO-8859-1")
    assert df.columns == ["id", "año"] and dict(df.dtypes) == {"id": "string", "año": "string"} and df.collect()[1][1] == "tré"
    line = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]}, "properties": {"departure_time": "2026-01-01 10:00:00", "minutes": 7.5}}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0]]}, "properties": {}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(line))
    df = readers.geojson_lines(spark, f"{tmp_path}/a.geojson", {"departure_time": "string", "minutes": "double"})
    r = df.withColumn("end", F.date_format(prep.plus_minutes(F.col("departure_time").cast("timestamp"), F.col("minutes")), "HH:mm:ss")).collect()
    assert [tuple(x) for x in r] == [(1.0, 2.0, 5.0, 6.0, "2026-01-01 10:00:00", 7.5, "10:07:30")]


def test_feather_is_written_and_read_by_tasks(spark, tmp_path):
    import pyarrow.feather as pf

    from viaflux.sources import feather, files

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(1000).repartition(3).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("kind"), F.timestamp_seconds("id").alias("at"))
        at = f"{tmp_path}/t.feather"
        fs = files.FileSystem(spark, at)
        feather.write(fs, df, at, "lz4", ["kind"])
        assert len(fs.names(at)) == 3
        assert str(pf.read_table(f"{at}/{fs.names(at)[0]}").schema.field("kind").type).startswith("dictionary")
        one = f"{at}/{fs.names(at)[0]}"
        assert feather.read(spark, at).dtypes == df.dtypes and feather.read(spark, one).count() == len(pf.read_table(one))
        assert prep.fingerprint(feather.read(spark, at)).first() == prep.fingerprint(df).first()
        other = f"{tmp_path}/d.feather"
        assert feather._write_by_driver(fs, df, other, None, ["kind"])
        assert prep.fingerprint(feather._read_binary(spark, [f"{other}/{n}" for n in fs.names(other)])).first() == prep.fingerprint(df).first()
        empty = f"{tmp_path}/e.feather"
        feather.write(fs, df.filter("id < 0"), empty, "zstd", ["kind"])
        assert feather.read(spark, empty).count() == 0 and feather.read(spark, empty).columns == df.columns
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
