"""From flows back to their trips. A pure query: no event is logged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..datasets import FlowDataset, TripDataset
from ..issues import Issues, QueryFailed, Report
from .flows import bridge, flow_keys, with_keys


def get_trips_from_flows(flows: FlowDataset, trips: TripDataset | None = None, *, max_issues: int = 1000) -> tuple[DataFrame, Report]:
    """Distinct (flow_id, movement_id), from the bridge, else by deriving the keys of `trips` or of the flows' source trips."""
    issues = Issues(QueryFailed, max_issues=max_issues)
    df = flows.flows
    if "flow_id" not in df.columns:
        issues.fatal("TFF.INPUT.FLOW_ID_MISSING", "the flows have no flow_id")
    if flows.flow_to_trips is not None:
        source = "flow_to_trips"
        if not {"flow_id", "movement_id"} <= set(flows.flow_to_trips.columns):
            issues.fatal("TFF.SOURCE.BRIDGE_INVALID", "the bridge needs flow_id and movement_id")
        pairs = flows.flow_to_trips.select("flow_id", "movement_id")
    else:
        origin = trips or flows.source_trips
        source = "trips" if trips is not None else "source_trips"
        if origin is None:
            issues.fatal("TFF.SOURCE.NONE", "there is neither a bridge nor trips to derive one from")
        pairs = _derived(flows, origin, issues)
    live = df.select("flow_id").distinct()
    pairs = pairs.filter(F.col("flow_id").isNotNull() & F.col("movement_id").isNotNull()).join(live, "flow_id", "left_semi").dropDuplicates(["flow_id", "movement_id"])
    return pairs.orderBy("flow_id", "movement_id"), Report(True, issues.all, {"source": source})


def _derived(flows: FlowDataset, trips: TripDataset, issues: Issues) -> DataFrame:
    spec = flows.aggregation_spec
    grain = spec.get("time_aggregation", "none")
    keys = flow_keys(spec.get("group_by") or [], grain)
    basis = spec.get("time_basis", "origin")
    needed = {"movement_id", "origin_h3_index", "destination_h3_index", *keys[2 + 2 * (grain != "none") :]} | ({f"{basis}_time_utc"} if grain != "none" else set())
    missing = sorted((needed - set(trips.data.columns)) | (set(keys) - set(flows.flows.columns)))
    if missing:
        issues.fatal("TFF.KEYS.MISSING", f"columns are missing: {missing}")
    if flows.flows.groupBy(*[f"`{k}`" for k in keys]).count().filter("count > 1").limit(1).count():
        issues.fatal("TFF.KEYS.NOT_UNIQUE", "several flows have the same keys")
    keyed = with_keys(trips.data, resolution=spec.get("h3_resolution", 8), time_aggregation=grain, time_basis=basis)
    return bridge(keyed, flows.flows, keys)


def unmatched_movements(pairs: DataFrame, trips: TripDataset) -> DataFrame:
    """The movement_ids of trips that no flow has."""
    return trips.data.select("movement_id").join(pairs.select("movement_id").distinct(), "movement_id", "left_anti")


def coverage(flows: FlowDataset, pairs: DataFrame, trips: TripDataset | None = None, sample: int = 10) -> dict:
    """How many flows and movements are matched, and bounded samples of those that aren't."""
    lost = flows.flows.select("flow_id").join(pairs.select("flow_id").distinct(), "flow_id", "left_anti")
    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("flow_id").alias("flows"), F.countDistinct("movement_id").alias("movements")).first().asDict()
    out = {"matched": counts, "unmatched_flows": lost.count(), "unmatched_flow_sample": [r[0] for r in lost.orderBy("flow_id").limit(sample).collect()]}
    if trips is not None:
        free = unmatched_movements(pairs, trips)
        out |= {"unmatched_movements": free.count(), "unmatched_movement_sample": [r[0] for r in free.orderBy("movement_id").limit(sample).collect()]}
    return out
