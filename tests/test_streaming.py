import json

from viaflux.streaming.flows import streamed_pairs, windowed_flows

A, B = "8828308281fffff", "8828308285fffff"


def run(spark, folder, schema, plan, name):
    stream = spark.readStream.schema(schema).json(folder)
    q = plan(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_windowed_flows(spark, tmp_path):
    rows = [("2026-04-01T08:10:00Z", A, B, 1.0), ("2026-04-01T08:40:00Z", A, B, 2.0), ("2026-04-01T09:10:00Z", A, B, 4.0), ("2026-04-01T12:00:00Z", A, B, 1.0)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(dict(zip(["origin_time_utc", "origin_h3_index", "destination_h3_index", "trip_weight"], r, strict=True))) for r in rows))
    (tmp_path / "b.json").write_text(json.dumps({"origin_time_utc": "2026-04-01T15:00:00Z", "origin_h3_index": A, "destination_h3_index": B, "trip_weight": 1.0}))
    got = run(spark, str(tmp_path), "origin_time_utc timestamp, origin_h3_index string, destination_h3_index string, trip_weight double", windowed_flows, "flows_out")
    assert {(r["window_start_utc"].hour, r["flow_count"], r["flow_value"]) for r in got} >= {(8, 2, 3.0), (9, 1, 4.0)}


def test_streamed_pairs(spark, tmp_path):
    rows = [("u", "p0", "2026-04-01T08:00:00Z", 1.0, 1.0), ("u", "p1", "2026-04-01T08:05:00Z", 2.0, 1.0), ("v", "p2", "2026-04-01T08:05:00Z", 2.0, 1.0)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(dict(zip(["user_id", "point_id", "time_utc", "latitude", "longitude"], r, strict=True))) for r in rows))
    got = run(spark, str(tmp_path), "user_id string, point_id string, time_utc timestamp, latitude double, longitude double", streamed_pairs, "pairs_out")
    assert [(r["user_id"], r["origin_latitude"], r["destination_latitude"]) for r in got] == [("u", 1.0, 2.0)]
