import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.fixtures import SCHEMA, TRACES, A, B, C, D, at, dataset, trips
from viaflux.datasets import TripDataset
from viaflux.issues import BuildFailed, CleanFailed, FilterFailed, FixFailed, ImportFailed, InferenceFailed, QueryFailed, StorageFailed, ValidationFailed
from viaflux.operators.cleaning import CleanOptions, clean_trips
from viaflux.operators.drilldown import coverage, get_trips_from_flows
from viaflux.operators.export import ExportFlowsOptions, export_flows
from viaflux.operators.filtering import FilterOptions, FlowFilterOptions, TimeFilter, filter_flows, filter_trips
from viaflux.operators.fixing import FixCorrespondenceOptions, fix_trips_correspondence
from viaflux.operators.flows import FlowBuildOptions, build_flows
from viaflux.operators.importing import MAX_DOMAIN, ImportOptions, import_traces_from_dataframe, import_trips_from_dataframe, with_row_number
from viaflux.operators.inference import InferTripsOptions, infer_trips_from_traces
from viaflux.operators.validation import ValidationOptions, repeated, repeated_all, validate_traces, validate_trips
from viaflux.schema import DomainSpec, EffectiveSchema, FieldSpec, TripSchema
from viaflux.sources import artifacts
from viaflux.sources.profiles import SourceProfile, import_trips_from_profile


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_ungrouped_flows(spark):
    f, report = build_flows(trips(spark))
    got = rows(f.flows, "flow_id", "origin_h3_index", "destination_h3_index", "flow_count", "flow_value")
    assert sorted(got) == [("flow_0000000", A, B, 3, 4.5), ("flow_0000001", C, D, 1, 3.0)]
    assert report.ok and report.summary["flows_out"] == 2


def test_threshold_and_windows(spark):
    f, _ = build_flows(trips(spark), options=FlowBuildOptions(min_trips_per_flow=2))
    assert f.flows.count() == 1
    f, _ = build_flows(trips(spark), options=FlowBuildOptions(time_aggregation="hour", group_by=["mode"]))
    assert f.flows.count() == 3


def test_empty_after_threshold_warns(spark):
    f, report = build_flows(trips(spark), options=FlowBuildOptions(min_trips_per_flow=9))
    assert f.flows.count() == 0 and "FLOW.OUTPUT.EMPTY_AFTER_THRESHOLD" in report.codes() and report.ok


@pytest.mark.parametrize(
    "options,code",
    [
        (dict(h3_resolution=16), "INVALID_H3_RESOLUTION"),
        (dict(h3_resolution=9), "TOO_FINE"),
        (dict(time_aggregation="month"), "INVALID_TIME_AGGREGATION"),
        (dict(group_by=["nope"]), "GROUP_BY"),
        (dict(min_trips_per_flow=0), "MIN_TRIPS"),
    ],
)
def test_fatal_build_options(spark, options, code):
    with pytest.raises(BuildFailed, match=code):
        build_flows(trips(spark), options=FlowBuildOptions(**options))


def test_build_needs_validation_and_cells(spark):
    t = trips(spark)
    with pytest.raises(BuildFailed, match="NOT_VALIDATED"):
        build_flows(dataset(t.data, validated=False))
    with pytest.raises(BuildFailed, match="INVALID_OR_MIXED"):
        build_flows(dataset(t.data.withColumn("origin_h3_index", F.lit("junk"))))
    with pytest.raises(BuildFailed, match="NO_BUILDABLE"):
        build_flows(dataset(t.data.withColumn("origin_h3_index", F.lit(None).cast("string"))))
    with pytest.raises(BuildFailed, match="NO_TRIPS"):
        build_flows(dataset(t.data.limit(0)))


def test_bridge_and_drilldown_agree_with_null_keys(spark):
    t = trips(spark)
    f, _ = build_flows(t, options=FlowBuildOptions(group_by=["purpose"], keep_flow_to_trips=True, h3_resolution=7))
    by_bridge, r1 = get_trips_from_flows(f)
    f2, _ = build_flows(t, options=FlowBuildOptions(group_by=["purpose"], h3_resolution=7))
    derived, r2 = get_trips_from_flows(f2)
    assert rows(by_bridge, "*") == rows(derived, "*") and len(rows(derived, "*")) == 4
    assert (r1.summary["source"], r2.summary["source"]) == ("flow_to_trips", "source_trips")
    assert coverage(f, by_bridge, t)["unmatched_flows"] == 0


def test_drilldown_without_source(spark):
    f, _ = build_flows(trips(spark))
    with pytest.raises(QueryFailed):
        get_trips_from_flows(type(f)(f.flows, None, f.aggregation_spec))


def test_flow_filter_keeps_bridge_in_step(spark):
    f, _ = build_flows(trips(spark), options=FlowBuildOptions(keep_flow_to_trips=True))
    out, report = filter_flows(f, FlowFilterOptions(where={"flow_count": {"gt": 1}}, h3_cells=[A, "junk"]))
    assert out.flows.count() == 1 and out.flow_to_trips.count() == 3
    assert not report.ok and "FLT.H3.INVALID_CELL_VALUES" in report.codes()
    assert report.summary["dropped_by_axis"] == {"where": 1, "h3_cells": 0}


@pytest.mark.parametrize(
    "where,ids",
    [
        ({"mode": "bus"}, {"m0", "m1", "m3"}),
        ({"mode": ["bus", "metro"]}, {"m0", "m1", "m2", "m3"}),
        ({"purpose": {"ne": "work"}}, {"m2"}),
        ({"purpose": {"not_in": ["work"]}}, {"m1", "m2"}),
        ({"purpose": {"is_null": True}}, {"m1"}),
        ({"origin_longitude": {"ne": -70.66}}, {"m1", "m2", "m3"}),
        ({"trip_weight": {"between": [1.5, 2.0]}}, {"m1", "m2"}),
        ({"origin_time_utc": {"gte": "2026-04-01T08:20:00Z"}}, {"m1", "m2", "m3"}),
        ({"mode": {"gt": "a"}}, {"m0", "m1", "m2", "m3"}),  # not for this dtype: left out
    ],
)
def test_where(spark, where, ids):
    out, _ = filter_trips(trips(spark), FilterOptions(where=where))
    assert {r[0] for r in rows(out.data, "movement_id")} == ids


@pytest.mark.parametrize(
    "predicate,ids",
    [("starts_within", {"m1"}), ("ends_within", {"m0", "m1"}), ("contains", {"m1"}), ("overlaps", {"m0", "m1", "m2"})],
)
def test_time(spark, predicate, ids):
    out, _ = filter_trips(trips(spark), FilterOptions(time=TimeFilter("2026-04-01T08:15:00", "2026-04-01T08:51:00", predicate), where={"movement_id": ["m0", "m1", "m2"]}))
    got = {r[0] for r in rows(out.data, "movement_id")}
    assert got == ids if predicate != "starts_within" else got == {"m1", "m2"}


def test_spatial_axes_and_counts(spark):
    t = trips(spark)
    out, report = filter_trips(t, FilterOptions(bbox=(-70.7, -33.5, -70.55, -33.35), polygon=[(-70.7, -33.5), (-70.62, -33.5), (-70.62, -33.4), (-70.7, -33.4)]))
    assert {r[0] for r in rows(out.data, "movement_id")} == {"m0"}
    assert report.summary["dropped_by_axis"] == {"bbox": 2, "polygon": 1}


def test_filter_errors(spark):
    t = trips(spark)
    for options, code in [
        (FilterOptions(bbox=(1, 1, 0, 0)), "BBOX"),
        (FilterOptions(polygon=[(0, 0), (1, 1)]), "POLYGON"),
        (FilterOptions(time=TimeFilter("2026-01-02", "2026-01-01")), "INTERVAL"),
        (FilterOptions(h3_cells=["junk"]), "INVALID_CELL"),
        (FilterOptions(where={"nope": 1}, strict=True), "FIELD_NOT_FOUND"),
    ]:
        with pytest.raises(FilterFailed, match=code):
            filter_trips(t, options)
    out, report = filter_trips(t, FilterOptions(where={"nope": 1}))
    assert out.data.count() == 4 and not report.ok


def test_many_cells_use_a_join(spark):
    base = int(A, 16) & ~(0o7777 << 21)
    digits = [(a, b, c, d) for a in range(7) for b in range(7) for c in range(7) for d in range(7)][:1200]
    cells = [A] + [format(base | (a << 30) | (b << 27) | (c << 24) | (d << 21), "x") for a, b, c, d in digits]
    cells = [c for c in cells if c != C]
    out, report = filter_trips(trips(spark), FilterOptions(h3_cells=cells))
    assert out.data.count() == 3 and report.summary["dropped_by_axis"] == {"h3_cells": 1}
    f, _ = build_flows(trips(spark), options=FlowBuildOptions(keep_flow_to_trips=True))
    out, report = filter_flows(f, FlowFilterOptions(where={"flow_count": {"gte": 1}}, h3_cells=cells))
    assert report.summary["dropped_by_axis"] == {"where": 0, "h3_cells": 1} and out.flows.count() == report.summary["rows_out"]
    assert {r["origin_h3_index"] for r in out.flows.collect()} == {A} and out.flow_to_trips.count() == 3
    assert [r["origin_h3_index"] for r in report.details["dropped_samples"]["h3_cells"].collect()] == [C]


def test_filters_stay_out_of_python(spark):
    out, _ = filter_trips(trips(spark), FilterOptions(where={"mode": "bus"}, bbox=(-71, -34, -70, -33), h3_cells=[A]))
    assert "Python" not in out.data._jdf.queryExecution().executedPlan().toString()


def test_clean_counts_are_incremental(spark):
    t = trips(spark)
    o = CleanOptions(drop_rows_with_nulls_in_fields=["purpose"], drop_rows_with_origin_after_destination=True, drop_duplicates=True, duplicates_subset=["origin_h3_index"], drop_rows_by_categorical_values={"mode": ["metro"], "purpose": ["x"]})
    out, report = clean_trips(t, options=o, row_order=["movement_id"])
    assert {r[0] for r in rows(out.data, "movement_id")} == {"m0"}
    d = report.summary["dropped_by_rule"]
    assert (d["nulls_fields"], d["origin_after_destination"], d["duplicates"], d["categorical_values"]) == (1, 1, 1, 0)
    assert "CLN.CATEGORICAL.SKIPPED" in report.codes() and out.is_validated


def test_clean_latlon_and_subset(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, None, None), ("b", None, None, None, None), ("c", 1.0, None, 1.0, 1.0), ("d", 95.0, 1.0, 1.0, 1.0)], "movement_id string, origin_latitude double, origin_longitude double, destination_latitude double, destination_longitude double")
    out, _ = clean_trips(dataset(df), options=CleanOptions(drop_rows_with_invalid_latlon=True))
    assert rows(out.data, "movement_id") == [("a",)]
    with pytest.raises(CleanFailed):
        clean_trips(dataset(df), options=CleanOptions(drop_duplicates=True, duplicates_subset=["nope"]))


def test_validation(spark):
    out, report = validate_trips(trips(spark), options=ValidationOptions(validate_temporal_consistency=True, validate_domains="full"))
    assert not report.ok and not out.is_validated
    by = {(i.code, i.field): i.row_count for i in report.issues if i.level == "error"}
    assert by[("VAL.CORE.CONSTRAINT_VIOLATION", "trip_weight")] == 1
    assert by[("VAL.TEMPORAL.ORIGIN_AFTER_DESTINATION", None)] == 1
    with pytest.raises(ValidationFailed):
        validate_trips(trips(spark), options=ValidationOptions(strict=True))
    with pytest.raises(ValidationFailed, match="DUPLICATES_SUBSET"):
        validate_trips(trips(spark), options=ValidationOptions(validate_duplicates=True))


def test_uniqueness_checks_agree_with_one_by_one(spark):
    rows = [("a", 0.0, None), ("a", -0.0, None), ("b", 1.0, "x"), (None, 1.0, "x"), (None, None, "x"), ("c", float("nan"), "y"), ("d", float("nan"), "y"), ("a", 0.0, "null")]
    df = spark.createDataFrame(rows, "k string, v double, w string")
    subsets = [(["k"], True), (["v", "w"], False), (["k", "v"], False), (["w"], True), (["k", "w"], True)]
    assert repeated_all(df, subsets) == [repeated(df, names, drop) for names, drop in subsets] == [3, 6, 3, 5, 0]
    assert repeated_all(df.filter("false"), subsets) == [0] * 5 and repeated_all(df, []) == [] and repeated_all(df, subsets[:1]) == [3]


def test_validation_truncates(spark):
    df = trips(spark).data.withColumn("trip_weight", F.lit("many")).withColumn("movement_id", F.lit(None).cast("string"))
    _, report = validate_trips(dataset(df), options=ValidationOptions(max_issues=1))
    assert report.codes() == ["VAL.REPORT.ISSUES_TRUNCATED"]


def test_fix(spark):
    t = trips(spark)
    out, report = fix_trips_correspondence(t, field_corrections={"purpose": "user_id"}, value_corrections={"mode": {"bus": "metro", "metro": "bus", "car": "x"}}, correspondence_context={"reason": "r", "odd": 1})
    assert report.summary["values_replaced"] == {"mode": 4} and not out.is_validated
    assert sorted(r[0] for r in rows(out.data, "mode")) == ["bus", "metro", "metro", "metro"]
    assert "FIX.CONTEXT.UNKNOWN_KEYS" in report.codes() and "FIX.VALUE.UNMATCHED" in report.codes()
    with pytest.raises(FixFailed, match="AMBIGUOUS"):
        fix_trips_correspondence(t, field_corrections={"a": "user_id", "b": "user_id"})
    same, _ = fix_trips_correspondence(t, value_corrections={"mode": {"tram": "bus"}})
    assert same.is_validated
    with pytest.raises(FixFailed):
        fix_trips_correspondence(t, field_corrections={"purpose": "nope"}, options=FixCorrespondenceOptions(strict=True))


IMPORT = TripSchema("1", {f.name: f for f in (FieldSpec("movement_id", "string", True), FieldSpec("user_id", "string", True), FieldSpec("origin_latitude", "float"), FieldSpec("origin_longitude", "float"), FieldSpec("mode", "categorical", domain=DomainSpec(["bus", "other"], False)), FieldSpec("n", "int"), FieldSpec("origin_time_utc", "datetime"))}, ["movement_id", "user_id"])


def raw(spark):
    return spark.createDataFrame([(" u1 ", "-33,45", "-70.6", "BUS", "1", "2026-01-01 10:00"), ("u2", "x", "-70.6", "boat", "1.5", "soon"), ("", "-33.4", "-70.5", None, None, None)], "who string, lat string, lon string, mode string, n string, start string")


def test_import(spark):
    t, report = import_trips_from_dataframe(raw(spark).coalesce(1), IMPORT, field_correspondence={"user_id": "who", "origin_latitude": "lat", "origin_longitude": "lon", "origin_time_utc": "start"}, value_correspondence={"mode": {"BUS": "bus"}}, options=ImportOptions(single_stage=True))
    got = {r["movement_id"]: r for r in t.data.collect()}
    assert set(got) == {"m0", "m1", "m2"}
    assert got["m0"]["user_id"] == "u1" and got["m2"]["user_id"] is None
    assert [got[f"m{i}"]["mode"] for i in range(3)] == ["bus", "other", None]
    assert got["m0"]["origin_latitude"] == -33.45 and got["m1"]["origin_latitude"] is None and got["m1"]["n"] is None
    assert got["m0"]["origin_h3_index"] and got["m1"]["origin_h3_index"] is None
    assert got["m0"]["trip_id"] == "m0" and got["m0"]["movement_seq"] == 0
    assert report.codes().count("IMP.TYPE.PARTIAL") == 3 and not t.is_validated
    assert t.value_correspondence == {"mode": {"BUS": "bus"}}


def test_domains_of_many_values(spark):
    n = MAX_DOMAIN + 5
    df = spark.range(n).select(F.col("id").cast("string").alias("movement_id"), F.lit("u").alias("user_id"), F.when(F.col("id") == 0, "bus").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("mode"))
    t, report = import_trips_from_dataframe(df, IMPORT)
    assert {r["mode"]: r["count"] for r in t.data.groupBy("mode").count().collect()} == {"bus": 1, "other": n - 1}
    assert "IMP.DOMAIN.OUT_OF_DOMAIN" in report.codes()
    with pytest.raises(ImportFailed, match="DOMAIN.STRICT"):
        import_trips_from_dataframe(df, IMPORT, options=ImportOptions(strict_domains=True))
    open_schema = TripSchema("1", {**IMPORT.fields, "mode": FieldSpec("mode", "categorical", domain=DomainSpec(["bus"], True))}, IMPORT.required)
    t, _ = import_trips_from_dataframe(df, open_schema)
    assert len(t.effective.domains["mode"]["values"]) == n and len(t.effective.domains["mode"]["extended"]) == n - 1
    fixed, _ = fix_trips_correspondence(t, value_corrections={"mode": {"v1": "v2"}})
    assert len(fixed.effective.domains["mode"]["values"]) == n - 1


def test_import_errors(spark):
    df = raw(spark)
    for kwargs, code in [
        (dict(field_correspondence={"nope": "who"}), "UNKNOWN_CANONICAL"),
        (dict(field_correspondence={"user_id": "absent"}), "SOURCE_MISSING"),
        (dict(), "REQUIRED.MISSING"),
        (dict(h3_resolution=16), "H3_RESOLUTION"),
        (dict(field_correspondence={"user_id": "who"}, options=ImportOptions(strict_domains=True)), "DOMAIN.STRICT"),
    ]:
        with pytest.raises(ImportFailed, match=code):
            import_trips_from_dataframe(df, IMPORT, **kwargs)
    with pytest.raises(ImportFailed):
        import_trips_from_dataframe(df, TripSchema("1", {}, []))


def test_selected_fields_and_profile(spark):
    profile = SourceProfile("s", preprocess=lambda d: d.withColumn("who", F.trim("who")), default_field_correspondence={"user_id": "who"}, default_options=ImportOptions(selected_fields=["n"], keep_extra_fields=False))
    t, _ = import_trips_from_profile(raw(spark), profile, IMPORT)
    assert t.data.columns == ["movement_id", "user_id", "n"]


def test_row_numbers_are_dense(spark):
    df = spark.range(1000, numPartitions=7).filter("id % 3 = 0")
    got = sorted(r["n"] for r in with_row_number(df, "n").collect())
    assert got == list(range(334))


def points(spark):
    r = []
    for u, minutes, lat in [("u1", [0, 2, 30, 32, 90, 91], [0, 0, 1, 1, 2, 2]), ("u2", [0, 60], [0, 1])]:
        for k, (m, y) in enumerate(zip(minutes, lat, strict=True)):
            r.append((f"{u}{k}", u, at(8) + dt.timedelta(minutes=m), -33.4 + 0.01 * y + 0.0001 * (k % 2), -70.6, f"place{y}"))
    return spark.createDataFrame(r, "point_id string, user_id string, time_utc timestamp, latitude double, longitude double, location_ref string")


def test_traces_to_trips(spark):
    t, _ = import_traces_from_dataframe(points(spark), TRACES)
    t, report = validate_traces(t, row_order=["time_utc", "point_id"])
    assert report.ok and t.is_validated
    out, r = infer_trips_from_traces(t, SCHEMA)
    assert r.summary["pairs"] == 6 and out.data.count() == 6 and not out.is_validated
    clusters, r = infer_trips_from_traces(t, SCHEMA, options=InferTripsOptions(infer_mode="consecutive_clusters", cluster_radius_m=100, cluster_max_time_gap_s=300, propagate_fields={"location_ref": "both"}))
    got = sorted(rows(clusters.data, "movement_id", "user_id", "origin_location_ref", "destination_location_ref"))
    assert got == [("m0", "u1", "place0", "place1"), ("m1", "u1", "place1", "place2"), ("m2", "u2", "place0", "place1")]
    times = sorted(r[0].minute for r in rows(clusters.data.filter("user_id = 'u1'"), "origin_time_utc"))
    assert times == [2, 32]  # origins are the last points of clusters


def test_inference_thresholds_and_errors(spark):
    t, _ = import_traces_from_dataframe(points(spark), TRACES)
    with pytest.raises(InferenceFailed, match="NOT_VALIDATED"):
        infer_trips_from_traces(t, SCHEMA)
    out, r = infer_trips_from_traces(t, SCHEMA, options=InferTripsOptions(require_validated_traces=False, min_time_delta_s=300, drop_same_place=True))
    assert r.summary["reasons"] == {"min_time": 3, "same_place": 3} and r.summary["trips"] == 3 and out.data.count() == 3
    with pytest.raises(InferenceFailed, match="CLUSTER"):
        infer_trips_from_traces(t, SCHEMA, options=InferTripsOptions(require_validated_traces=False, infer_mode="consecutive_clusters"))


def test_trace_regressions_and_times(spark):
    df = points(spark).withColumn("n", F.monotonically_increasing_id())
    t, _ = import_traces_from_dataframe(df, TRACES)
    _, report = validate_traces(t, row_order=["latitude", "point_id"])
    assert "VAL.MONOTONICITY.REGRESSION" not in report.codes() or report.ok
    with pytest.raises(ImportFailed, match="UNPARSEABLE"):
        import_traces_from_dataframe(df.withColumn("time_utc", F.lit("soon")), TRACES)


def test_artefacts(spark, tmp_path):
    t = trips(spark)
    at_, _ = artifacts.write_trips(t, f"{tmp_path}/a")
    assert at_.endswith(artifacts.SUFFIX)
    with pytest.raises(StorageFailed, match="EXISTS"):
        artifacts.write_trips(t, f"{tmp_path}/a")
    artifacts.write_trips(t, f"{tmp_path}/a", options=artifacts.WriteOptions(mode="overwrite", storage_format="feather"))
    back, _ = artifacts.read_trips(spark, f"{tmp_path}/a")
    assert not back.is_validated and back.schema.to_dict() == SCHEMA.to_dict()
    assert sorted(map(tuple, back.data.collect())) == sorted(map(tuple, t.data.collect()), key=lambda r: r[0])
    f, _ = build_flows(t, options=FlowBuildOptions(keep_flow_to_trips=True, group_by=["mode"]))
    for backend in ("parquet", "feather"):
        artifacts.write_flows(f, f"{tmp_path}/f_{backend}", options=artifacts.WriteOptions(storage_format=backend, require_validated=False))
        g, _ = artifacts.read_flows(spark, f"{tmp_path}/f_{backend}")
        assert g.flows.count() == 3 and g.flow_to_trips.count() == 4 and g.aggregation_spec["group_by"] == ["mode"]
    found = artifacts.discover(spark, str(tmp_path))
    assert {(x["type"], x["format"]) for x in found} == {("trips", "feather"), ("flows", "parquet"), ("flows", "feather")}
    (tmp_path / "a.viaflux" / ".trips.metadata.json.crc").unlink(missing_ok=True)
    (tmp_path / "a.viaflux" / "trips.metadata.json").write_text("{")
    with pytest.raises(StorageFailed):
        artifacts.read_trips(spark, f"{tmp_path}/a", options=artifacts.ReadOptions(strict=True))
    again, report = artifacts.read_trips(spark, f"{tmp_path}/a")
    assert again.data.count() == 4 and not report.ok


def test_export(spark, tmp_path):
    f, _ = build_flows(trips(spark), options=FlowBuildOptions(group_by=["mode"]))
    result, _ = export_flows(f, str(tmp_path), options=ExportFlowsOptions(folder_name="my flows!", extra_flow_fields=["mode"]))
    lines = (tmp_path / "my_flows" / "flows.csv").read_text().splitlines()
    assert lines[0] == "origin,dest,count,mode" and len(lines) == 4
    places = (tmp_path / "my_flows" / "locations.csv").read_text().splitlines()
    assert places[0] == "id,name,lat,lon" and len(places) == 5 and set(result.artifacts) == {"flows.csv", "locations.csv", "metadata.json"}
    with pytest.raises(Exception, match="EXISTS"):
        export_flows(f, str(tmp_path), options=ExportFlowsOptions(folder_name="my flows!"))


def test_inputs_are_not_changed(spark):
    t = trips(spark)
    before = dict(t.metadata)
    validate_trips(t)
    clean_trips(t, options=CleanOptions(drop_duplicates=True))
    assert t.metadata == before


def test_filters_reach_the_scan(spark, tmp_path):
    t = trips(spark)
    t.data.write.parquet(f"{tmp_path}/trips")
    o = FilterOptions(where={"mode": "bus", "purpose": {"not_in": ["x"]}, "trip_weight": {"gt": 0.5}}, time=TimeFilter("2026-01-01", "2027-01-01"), bbox=(-71, -34, -70, -33))
    out, report = filter_trips(dataset(spark.read.parquet(f"{tmp_path}/trips")), o)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = out.data.select("movement_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    for part in ("EqualTo(mode,bus)", "GreaterThan(trip_weight,0.5)", "LessThan(origin_time_utc", "GreaterThanOrEqual(origin_longitude"):
        assert part in pushed, pushed
    assert "destination_h3_index" not in plan[plan.index("ReadSchema") :].splitlines()[0]
    assert out.data.count() == report.summary["rows_out"] == 2


def test_flow_aggregation_has_one_shuffle(spark):
    from viaflux.operators.flows import aggregate, with_keys

    keyed = with_keys(trips(spark).data, resolution=7, time_aggregation="day")
    plan = aggregate(keyed, ["origin_h3_index", "destination_h3_index", "window_start_utc", "window_end_utc"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_domains_of_many_rows_are_sampled_alike(spark):
    names = ["movement_id", "user_id", "mode", "purpose"]
    rows = [(f"m{i}", f"u{i % 50}", "x", "strange" if i % 10 == 0 else "1-URGENT") for i in range(60_000)]
    df = spark.createDataFrame(rows, names)
    schema = TripSchema("1.0", {n: FieldSpec(n, "categorical" if n in ("mode", "purpose") else "string", domain=DomainSpec(["1-URGENT"]) if n == "purpose" else None) for n in names}, names[:2])
    effective = EffectiveSchema({n: schema.fields[n].dtype for n in names}, temporal={"tier": "tier_3"}, fields=names)
    for frac in (0.01, 0.3):
        o = ValidationOptions(validate_constraints=False, validate_types_and_formats=False, validate_domains="sample", domains_sample_frac=frac, domains_min_in_domain_ratio=0.5)
        reports = [validate_trips(TripDataset(part, schema, effective=effective), options=o)[1] for part in (df.coalesce(1), df.repartition(5))]
        ratios = [r.summary["domains"]["purpose"] for r in reports]
        assert ratios[0] == ratios[1] and abs(ratios[0] - 0.9) < 0.04
        assert {i.code for i in reports[0].issues if i.field} == {"VAL.DOMAIN.MISSING_DOMAIN_INFO", "VAL.DOMAIN.PARTIAL_COVERAGE"}


def test_row_numbers_of_unordered_rows_are_dense(spark):
    df = spark.range(1000).repartition(7).withColumn("_part", F.lit(1)).drop("_part")
    out = with_row_number(df, "n")
    assert out.columns == ["id", "n"] and sorted(r["n"] for r in out.collect()) == list(range(1000))
