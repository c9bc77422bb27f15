"""Trips from traces: consecutive points, or consecutive stay clusters.

All steps share one partitioning by user: lead, lag, the running sum that
numbers the clusters, and the grouping of a cluster's points.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..datasets import TraceDataset, TripDataset, json_safe, new_id
from ..functions import coerce, geo, h3proj, timeutil
from ..issues import InferenceFailed, Issues, Report
from ..schema import TRIP_CORE, EffectiveSchema, TripSchema
from .importing import DOMAIN_SHARE, MAX_DOMAIN, ImportOptions, _domain_policy, dense_rank_id, extended_fields, normalise_domain, observed_values


@dataclass(frozen=True)
class InferTripsOptions:
    infer_mode: str = "consecutive_points"
    strict: bool = False
    strict_domains: bool = False
    require_validated_traces: bool = True
    drop_invalid: bool = True
    h3_resolution: int = 8
    max_time_delta_s: float | None = None
    min_time_delta_s: float | None = None
    min_distance_m: float | None = None
    cluster_radius_m: float | None = None
    cluster_max_time_gap_s: float | None = None
    drop_same_place: bool = False
    #: Trace fields to carry along, each as "origin", "destination" or "both".
    propagate_fields: Mapping[str, str] = field(default_factory=dict)
    value_correspondence: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


def _order() -> list[Column]:
    return [F.col("time_utc").asc_nulls_last(), F.col("point_id").asc_nulls_last()]


def prepared(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns(
        {
            "user_id": F.col("user_id").cast("string"),
            "point_id": F.col("point_id").cast("string"),
            "time_utc": timeutil.to_utc(F.col("time_utc"), kinds["time_utc"]),
            "latitude": coerce.number(F.col("latitude"), kinds["latitude"]),
            "longitude": coerce.number(F.col("longitude"), kinds["longitude"]),
        }
    )


def _place(df: DataFrame, extra: Sequence[str]) -> Column:
    names = ["point_id", "time_utc", "latitude", "longitude", *[c for c in dict.fromkeys(["location_ref", *extra]) if c in df.columns]]
    return F.struct(*[F.col(f"`{c}`") for c in names])


def point_pairs(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(user_id, o, d): each point and the same user's next one, as structs."""
    w = Window.partitionBy("user_id").orderBy(*_order())
    place = _place(df, extra)
    return df.select("user_id", place.alias("o"), F.lead(place).over(w).alias("d")).filter("d IS NOT NULL")


def with_clusters(df: DataFrame, radius_m: float, max_gap_s: float) -> DataFrame:
    """A cluster number per user: a point joins its predecessor's cluster if near to that point in time and space."""
    w = Window.partitionBy("user_id").orderBy(*_order())
    gap = timeutil.seconds_between(F.lag("time_utc").over(w), F.col("time_utc"))
    far = geo.haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    tagged = df.withColumn("_gap", gap).withColumn("_far", far)
    starts = (~F.coalesce((F.col("_gap") <= max_gap_s) & (F.col("_far") <= radius_m), F.lit(False))).cast("int")
    return tagged.withColumn("cluster", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_far")


def cluster_pairs(df: DataFrame, radius_m: float, max_gap_s: float, extra: Sequence[str] = ()) -> DataFrame:
    """(user_id, o, d): the last point of a cluster and the first of the next."""
    place = _place(df, extra)
    rank = F.struct(F.col("time_utc").isNull(), "time_utc", F.col("point_id").isNull(), "point_id")
    ends = with_clusters(df, radius_m, max_gap_s).groupBy("user_id", "cluster").agg(F.min_by(place, rank).alias("first"), F.max_by(place, rank).alias("last"))
    w = Window.partitionBy("user_id").orderBy("cluster")
    return ends.select("user_id", F.col("last").alias("o"), F.lead("first").over(w).alias("d")).filter("d IS NOT NULL")


def threshold_flags(pairs: DataFrame, o: InferTripsOptions) -> dict[str, Column]:
    """Why pairs are dropped; reasons don't exclude each other."""
    dt = timeutil.seconds_between(F.col("o.time_utc"), F.col("d.time_utc"))
    dist = geo.haversine_m(F.col("o.latitude"), F.col("o.longitude"), F.col("d.latitude"), F.col("d.longitude"))
    no = lambda c: F.coalesce(c, F.lit(False))
    out = {}
    if o.max_time_delta_s is not None:
        out["max_time"] = no(dt > o.max_time_delta_s)
    if o.min_time_delta_s is not None:
        out["min_time"] = no(dt < o.min_time_delta_s)
    if o.min_distance_m is not None:
        out["min_distance"] = no(dist < o.min_distance_m)
    if o.drop_same_place and "location_ref" in pairs.schema["o"].dataType.names:
        out["same_place"] = no(F.col("o.location_ref") == F.col("d.location_ref"))
    return out


def infer_trips_from_traces(traces: TraceDataset, trip_schema: TripSchema, *, options: InferTripsOptions | None = None) -> tuple[TripDataset, Report]:
    """Trips of the twelve core columns and the carried fields; they are of tier_1 and not validated."""
    o = options or InferTripsOptions()
    issues = Issues(InferenceFailed, o.strict)
    if o.infer_mode not in ("consecutive_points", "consecutive_clusters"):
        issues.fatal("INF.CONFIG.MODE", f"mode {o.infer_mode!r} is unknown")
    if isinstance(o.h3_resolution, bool) or not 0 <= o.h3_resolution <= 15:
        issues.fatal("INF.CONFIG.H3_RESOLUTION", f"H3 resolution {o.h3_resolution!r} isn't in 0..15")
    if None not in (o.min_time_delta_s, o.max_time_delta_s) and o.min_time_delta_s > o.max_time_delta_s:
        issues.fatal("INF.CONFIG.TIME_THRESHOLDS", "min_time_delta_s is above max_time_delta_s")
    clusters = o.infer_mode == "consecutive_clusters"
    if clusters and not ((o.cluster_radius_m or 0) > 0 and (o.cluster_max_time_gap_s or 0) > 0):
        issues.fatal("INF.CONFIG.CLUSTER", "clusters need a positive radius and time gap")
    lacking = [c for c in TRIP_CORE if c not in trip_schema.fields]
    if lacking:
        issues.fatal("INF.SCHEMA.CORE_MISSING", f"the trip schema lacks {lacking}")
    if o.require_validated_traces and not traces.is_validated:
        issues.fatal("INF.VALIDATION.REQUIRED_NOT_VALIDATED", "the traces aren't validated")
    df = traces.data
    missing = [c for c in ("point_id", "user_id", "time_utc", "latitude", "longitude") if c not in df.columns]
    if missing:
        issues.fatal("INF.INPUT.CORE_MISSING", f"columns are missing: {missing}")
    targets: dict[str, tuple[str, str]] = {}
    for name, side in o.propagate_fields.items():
        if name not in df.columns:
            issues.fatal("INF.PROPAGATE.FIELD_MISSING", f"there is no column {name!r}", field=name)
        if side not in ("origin", "destination", "both"):
            issues.fatal("INF.PROPAGATE.SIDE", f"side {side!r} is unknown", field=name)
        for end in ("origin", "destination") if side == "both" else (side,):
            target = f"{end}_{name}"
            if target in TRIP_CORE or target in targets:
                issues.fatal("INF.PROPAGATE.TARGET_RESERVED", f"{target!r} can't be a target", field=target)
            targets[target] = end, name

    points = prepared(df)
    extra = list(o.propagate_fields)
    pairs = cluster_pairs(points, o.cluster_radius_m, o.cluster_max_time_gap_s, extra) if clusters else point_pairs(points, extra)
    flags = threshold_flags(pairs, o)
    dropped = F.lit(False)
    for f in flags.values():
        dropped = dropped | f
    usable = F.col("user_id").isNotNull()
    for end in ("o", "d"):
        for c in ("point_id", "time_utc", "latitude", "longitude"):
            usable = usable & F.col(f"{end}.{c}").isNotNull()
    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(dropped).alias("dropped"), F.count_if(~dropped & ~usable).alias("invalid"), *[F.count_if(f).alias(f"t_{n}") for n, f in flags.items()]).first()
    span = points.agg(F.count(F.lit(1)).alias("n"), F.min("time_utc").alias("start"), F.max("time_utc").alias("end")).first()
    if not span["n"]:
        issues.warn("INF.INPUT.EMPTY", "there are no points")
    if counts["invalid"]:
        issues.warn("INF.CANDIDATES.INVALID", f"{counts['invalid']} pairs lack a value", row_count=counts["invalid"])
    kept = counts["pairs"] - counts["dropped"] - counts["invalid"]
    if counts["pairs"] and not kept:
        issues.err("INF.CANDIDATES.NO_MATERIALIZABLE_CANDIDATES", "no pair is left")

    rows = pairs.filter(~dropped & usable)
    rows = dense_rank_id(rows, [F.col("user_id").asc_nulls_last(), F.col("o.time_utc").asc_nulls_last(), F.col("o.point_id").asc_nulls_last()], "_n")
    rows = rows.withColumn("movement_id", F.concat(F.lit("m"), F.col("_n").cast("string")))
    trips = rows.select(
        "movement_id",
        "user_id",
        F.col("o.longitude").alias("origin_longitude"),
        F.col("o.latitude").alias("origin_latitude"),
        F.col("d.longitude").alias("destination_longitude"),
        F.col("d.latitude").alias("destination_latitude"),
        F.col("o.time_utc").alias("origin_time_utc"),
        F.col("d.time_utc").alias("destination_time_utc"),
        h3proj.cell_of(F.col("o.latitude"), F.col("o.longitude"), o.h3_resolution).alias("origin_h3_index"),
        h3proj.cell_of(F.col("d.latitude"), F.col("d.longitude"), o.h3_resolution).alias("destination_h3_index"),
        F.col("movement_id").alias("trip_id"),
        F.lit(0).cast("long").alias("movement_seq"),
        *[F.col(f"{'o' if end == 'origin' else 'd'}.`{name}`").alias(t) for t, (end, name) in targets.items()],
    )
    failed = F.col("origin_h3_index").isNull() | F.col("destination_h3_index").isNull()
    lost = trips.agg(F.count_if(failed).alias("n")).first()["n"]
    if lost:
        issues.warn("INF.H3.DERIVATION_FAILED", f"{lost} trips lie off the earth", row_count=lost)
        trips = trips.filter(~failed)

    effective = EffectiveSchema({c: trip_schema.fields[c].dtype if c in trip_schema.fields else "string" for c in trips.columns}, temporal={"tier": "tier_1"}, fields=trips.columns)
    texts = [c for c in targets if c in trip_schema.fields and trip_schema.fields[c].dtype == "categorical"]
    for name in texts:
        aliases = trip_schema.fields[name].domain.aliases if trip_schema.fields[name].domain else None
        trips = trips.withColumn(name, normalise_domain(F.col(name), {**(aliases or {}), **o.value_correspondence.get(name, {})}))
    for name, seen in observed_values(trips, texts, whole=extended_fields(trip_schema.fields, texts, o.strict_domains)).items():
        spec = trip_schema.fields[name]
        if not (spec.domain and spec.domain.values) and 0 < seen["distinct"] <= min(MAX_DOMAIN, max(1, int(DOMAIN_SHARE * seen["rows"]))):
            effective.domains[name] = {"values": seen["values"], "extended": seen["values"], "bootstrapped": True}
        else:
            trips = _domain_policy(trips, spec, seen, ImportOptions(strict_domains=o.strict_domains), effective, issues)
    summary = {"points": span["n"], "pairs": counts["pairs"], "dropped": counts["dropped"], "invalid": counts["invalid"], "trips": kept - lost, "reasons": {n: counts[f"t_{n}"] for n in flags}}
    parameters = json_safe(asdict(o))
    provenance = {"derived_from": [{"dataset_id": traces.metadata.get("dataset_id"), "type": "traces", "time_range": json_safe([span["start"], span["end"]])}]}
    base = TripDataset(trips, trip_schema, provenance, metadata={"dataset_id": new_id("tripds"), "is_validated": False, "temporal": {"tier": "tier_1"}, "h3": {"resolution": o.h3_resolution}, "domains_effective": effective.domains}, effective=effective)
    out = base.after("infer_trips", parameters, summary, issues)
    issues.raise_if_strict()
    return out, Report(issues.ok, issues.all, summary, parameters)


def summary_of(report: Report) -> dict[str, Any]:
    return report.summary
