"""Aggregation of trips into weighted origin-destination flows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..datasets import FlowDataset, TripDataset, json_safe, new_id
from ..functions import coerce, h3bits, timeutil
from ..issues import BuildFailed, Issues, Report
from ..session import cut
from .importing import dense_rank_id

TIME_AGGREGATIONS = ("none", "hour", "day", "week")


@dataclass(frozen=True)
class FlowBuildOptions:
    h3_resolution: int = 8
    group_by: Sequence[str] | None = None
    time_aggregation: str = "none"
    time_basis: str = "origin"
    min_trips_per_flow: int = 1
    keep_flow_to_trips: bool = False
    require_validated: bool = True
    strict: bool = False


def flow_keys(group_by: Sequence[str], time_aggregation: str) -> list[str]:
    """Key columns in their order."""
    window = [] if time_aggregation == "none" else ["window_start_utc", "window_end_utc"]
    return ["origin_h3_index", "destination_h3_index", *window, *group_by]


def with_keys(df: DataFrame, *, resolution: int, time_aggregation: str = "none", time_basis: str = "origin") -> DataFrame:
    """Cells rolled up to `resolution`, and the time window; invalid and null cells stay as they are."""
    for end in ("origin", "destination"):
        c = F.lower(F.trim(F.col(f"{end}_h3_index")))
        df = df.withColumn(f"{end}_h3_index", F.coalesce(h3bits.parent(c, resolution), c))
    if time_aggregation != "none":
        start, stop = timeutil.bucket(F.col(f"{time_basis}_time_utc"), time_aggregation)
        df = df.withColumn("window_start_utc", start).withColumn("window_end_utc", stop)
    return df


def aggregate(df: DataFrame, keys: Sequence[str], min_trips: int = 1) -> DataFrame:
    """Count and summed weight of each key in one aggregation; null keys are groups. Weights that aren't numbers count 0."""
    weight = F.lit(1.0)
    if "trip_weight" in df.columns:
        weight = F.coalesce(coerce.number(F.col("trip_weight"), df.schema["trip_weight"].dataType), F.lit(0.0))
    out = df.groupBy(*[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias("flow_count"), F.sum(weight).alias("flow_value"))
    return out.filter(F.col("flow_count") >= min_trips) if min_trips > 1 else out


def numbered(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """flow_id by the order of all keys, nulls last: a range sort, and ids from the counts of its parts."""
    ranked = dense_rank_id(flows, [F.col(f"`{k}`").asc_nulls_last() for k in keys], "_n")
    return ranked.withColumn("flow_id", F.format_string("flow_%07d", F.col("_n"))).drop("_n")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def bridge(df: DataFrame, flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(flow_id, movement_id): trips meet the flows of their keys, null being equal to null."""
    named = flows.select("flow_id", *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(named, on).select("flow_id", "movement_id")


def build_flows(trips: TripDataset, *, options: FlowBuildOptions | None = None, max_issues: int = 1000) -> tuple[FlowDataset, Report]:
    """Flows of trips by cell pair, time window and segments.

    The trips are read once, into groups of their own cells; checks of cells,
    resolutions and times and the roll-up work on those groups.
    Rows without an origin or destination cell are left out. Invalid cells,
    mixed resolutions and a finer target than the data are fatal.
    """
    options = options or FlowBuildOptions()
    issues = Issues(BuildFailed, options.strict, max_issues)
    df = trips.data
    group_by = list(options.group_by or ())
    res, grain, basis = options.h3_resolution, options.time_aggregation, options.time_basis
    if isinstance(res, bool) or not isinstance(res, int) or not 0 <= res <= 15:
        issues.fatal("FLOW.CONFIG.INVALID_H3_RESOLUTION", f"H3 resolution {res!r} isn't in 0..15")
    if grain not in TIME_AGGREGATIONS:
        issues.fatal("FLOW.CONFIG.INVALID_TIME_AGGREGATION", f"time aggregation {grain!r} is unknown")
    if basis not in ("origin", "destination"):
        issues.fatal("FLOW.CONFIG.INVALID_TIME_BASIS", f"time basis {basis!r} is unknown")
    if isinstance(options.min_trips_per_flow, bool) or not isinstance(options.min_trips_per_flow, int) or options.min_trips_per_flow < 1:
        issues.fatal("FLOW.CONFIG.INVALID_MIN_TRIPS_PER_FLOW", "min_trips_per_flow is a positive integer")
    if max_issues < 1:
        issues.fatal("FLOW.CONFIG.INVALID_MAX_ISSUES", "max_issues is a positive integer")
    if options.require_validated and not trips.is_validated:
        issues.fatal("FLOW.VALIDATION.REQUIRED_NOT_VALIDATED", "the trips aren't validated")
    missing = [c for c in ("origin_h3_index", "destination_h3_index") if c not in df.columns]
    if missing:
        issues.fatal("FLOW.INPUT.REQUIRED_FIELDS_MISSING", f"columns are missing: {missing}")
    unknown = [c for c in group_by if c not in df.columns]
    if unknown or len(set(group_by)) != len(group_by):
        issues.fatal("FLOW.CONFIG.GROUP_BY_INVALID_FIELDS", f"group_by has unknown or repeated fields: {unknown or group_by}")
    if options.keep_flow_to_trips and "movement_id" not in df.columns:
        issues.fatal("FLOW.BACKLINK.MOVEMENT_ID_REQUIRED", "the bridge needs movement_id")
    time_column = f"{basis}_time_utc"
    if grain != "none":
        tier = (trips.metadata.get("temporal") or {}).get("tier", "tier_3")
        if tier != "tier_1":
            issues.fatal("FLOW.TEMPORAL.TIER_NOT_SUPPORTED", f"time aggregation needs tier_1, not {tier}")
        if time_column not in df.columns:
            issues.fatal("FLOW.TEMPORAL.REQUIRED_TIME_FIELDS_MISSING", f"{time_column} is missing")

    # one pass over the trips: groups of their own cells, which the checks and the roll-up then see
    keys = flow_keys(group_by, grain)
    own = df.withColumns({f"{e}_h3_index": F.lower(F.trim(F.col(f"{e}_h3_index"))) for e in ("origin", "destination")})
    if grain != "none":
        start, stop = timeutil.bucket(F.col(time_column), grain)
        own = own.withColumn("window_start_utc", start).withColumn("window_end_utc", stop)
    groups = cut(aggregate(own, keys))
    cells = {e: F.col(f"_{e}") for e in ("origin", "destination")}
    full = F.col("origin_h3_index").isNotNull() & F.col("destination_h3_index").isNotNull()
    valid = {e: h3bits.long_valid(v) for e, v in cells.items()}
    parsed = groups.withColumns({f"_{e}": h3bits.to_long(F.col(f"{e}_h3_index")) for e in cells})
    trips_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("flow_count"))), F.lit(0))
    checks = parsed.agg(
        trips_if(F.lit(True)).alias("rows"),
        trips_if(full).alias("full"),
        *[trips_if(F.col(f"{e}_h3_index").isNotNull() & ~valid[e]).alias(f"bad_{e}") for e in cells],
        *[F.collect_set(F.when(valid[e], h3bits.long_resolution(v))).alias(f"res_{e}") for e, v in cells.items()],
        *([trips_if(full & F.col("window_start_utc").isNull()).alias("untimed")] if grain != "none" else []),
    ).first()
    if not checks["rows"]:
        issues.fatal("FLOW.INPUT.NO_TRIPS", "there are no trips")
    bad = checks["bad_origin"] + checks["bad_destination"]
    seen = sorted({*checks["res_origin"], *checks["res_destination"]})
    if bad or len(seen) > 1:
        issues.fatal("FLOW.AGG.H3_INVALID_OR_MIXED", f"{bad} cells are invalid, resolutions are {seen}", row_count=bad or None, details={"resolutions": seen})
    if seen and res > seen[0]:
        issues.fatal("FLOW.AGG.H3_RESOLUTION_TOO_FINE", f"resolution {res} is finer than the data's {seen[0]}")
    dropped = checks["rows"] - checks["full"]
    if dropped:
        issues.warn("FLOW.OUTPUT.MOVEMENTS_DROPPED_MISSING_OD_H3", f"{dropped} trips lack a cell", row_count=dropped)
    if not checks["full"]:
        issues.fatal("FLOW.OUTPUT.NO_BUILDABLE_MOVEMENTS", "no trip has both cells")
    if grain != "none" and checks["untimed"]:
        issues.fatal("FLOW.TEMPORAL.REQUIRED_TIME_FIELDS_MISSING", f"{checks['untimed']} trips lack {time_column}", row_count=checks["untimed"])

    rolled = with_keys(groups.filter(full), resolution=res).groupBy(*[f"`{k}`" for k in keys]).agg(F.sum("flow_count").alias("flow_count"), F.sum("flow_value").alias("flow_value"))
    flows = numbered(rolled.filter(F.col("flow_count") >= options.min_trips_per_flow), keys)
    flows = flows.select("flow_id", "origin_h3_index", "destination_h3_index", "flow_count", "flow_value", *keys[2:])
    links = None
    if options.keep_flow_to_trips:
        keyed = with_keys(df.filter(full), resolution=res, time_aggregation=grain, time_basis=basis)
        links = bridge(keyed, flows, keys)
    events = trips.metadata.get("events")
    if not events:
        issues.warn("FLOW.PROV.PRIOR_EVENTS_MISSING", "the trips have no event log")
    n_flows = flows.count()
    if not n_flows:
        issues.warn("FLOW.OUTPUT.EMPTY_AFTER_THRESHOLD", "no flow reaches the threshold")
    spec = {"h3_resolution": res, "group_by": group_by, "time_aggregation": grain, "time_basis": basis, "min_trips_per_flow": options.min_trips_per_flow, "keys": keys}
    summary = {"trips_in": checks["rows"], "trips_used": checks["full"], "trips_dropped": dropped, "flows_out": n_flows}
    parameters = json_safe(asdict(options))
    provenance = {"derived_from": [{"dataset_id": trips.metadata.get("dataset_id"), "type": "trips"}], "prior_events": [e["op"] for e in events or ()]}
    base = FlowDataset(flows, links, spec, trips, provenance, {"dataset_id": new_id("flowds"), "is_validated": False})
    out = base.after("build_flows", parameters, summary, issues)
    issues.raise_if_strict()
    return out, Report(issues.ok, issues.kept("FLOW.REPORT.ISSUES_TRUNCATED"), summary, parameters)
