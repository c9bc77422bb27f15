"""Filters of trips and flows: attributes, time, box, polygon and cells.

Predicates are columns, so those that compare plain columns reach the Parquet
scan. Axes are applied in a fixed order, and how many rows each drops is
counted in one aggregate.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import FlowDataset, TripDataset, json_safe
from ..functions import coerce, geo, h3bits
from ..issues import FilterFailed, Issues, Report

ORDERED = ("gt", "gte", "lt", "lte", "between")
#: Operators that a dtype allows.
OPERATORS = {
    "string": ("eq", "ne", "in", "not_in", "is_null", "not_null"),
    "categorical": ("eq", "ne", "in", "not_in", "is_null", "not_null"),
    "bool": ("eq", "ne", "is_null", "not_null"),
    "int": ("eq", "ne", "in", "not_in", "is_null", "not_null", *ORDERED),
    "float": ("eq", "ne", "in", "not_in", "is_null", "not_null", *ORDERED),
    "datetime": ("eq", "ne", "in", "not_in", "is_null", "not_null", *ORDERED),
}
KNOWN = {o for ops in OPERATORS.values() for o in ops}
TIME_PREDICATES = ("overlaps", "starts_within", "ends_within", "contains")
SPATIAL_PREDICATES = ("origin", "destination", "both", "either")
#: From so many cells on, membership is a semi-join instead of a literal list.
MANY_CELLS = 1000
FLOW_CORE = {"flow_id": "string", "origin_h3_index": "string", "destination_h3_index": "string", "flow_count": "int", "flow_value": "float", "window_start_utc": "datetime", "window_end_utc": "datetime"}


@dataclass(frozen=True)
class TimeFilter:
    start: Any
    end: Any
    predicate: str = "overlaps"


@dataclass(frozen=True)
class FilterOptions:
    where: Mapping[str, Any] | None = None
    time: TimeFilter | None = None
    bbox: Sequence[float] | None = None
    polygon: Sequence[Sequence[float]] | None = None
    h3_cells: Iterable[str] | None = None
    spatial_predicate: str = "origin"
    keep_metadata: bool = True
    strict: bool = False


@dataclass(frozen=True)
class FlowFilterOptions:
    where: Mapping[str, Any] | None = None
    h3_cells: Iterable[str] | None = None
    spatial_predicate: str = "origin"
    keep_flow_to_trips: bool = True
    keep_metadata: bool = True
    strict: bool = False


def logical_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if coerce.is_numeric(kind):
        return "float"
    return "datetime" if coerce.is_time(kind) else "string"


def utc_literal(value: Any) -> Column:
    """A bound as a timestamp; without a zone it is UTC."""
    if isinstance(value, dt.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=dt.UTC)
    else:
        at = dt.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
        at = at if at.tzinfo else at.replace(tzinfo=dt.UTC)
    micros = (at - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def _clause(value: Any, allow_set: bool) -> dict[str, Any] | None:
    if isinstance(value, Mapping):
        return dict(value)
    if isinstance(value, (set, frozenset)):
        return {"in": sorted(value, key=str)} if allow_set else None
    if isinstance(value, (list, tuple)):
        return {"in": list(value)}
    return {"eq": value}


def predicate(c: Column, dtype: str, kind: T.DataType, op: str, value: Any) -> Column:
    """One comparison; null stands for no, so that a filter can hand it to the scan as it is.

    `ne` keeps nulls of floats and times and drops others; `not_in` keeps them.
    """
    lit = utc_literal if dtype == "datetime" else F.lit
    if dtype in ("int", "float") and not coerce.is_numeric(kind):
        c = coerce.number(c, kind)
    if op == "eq":
        return c == lit(value)
    if op == "ne":
        return (c != lit(value)) | c.isNull() if dtype in ("float", "datetime") else c != lit(value)
    if op in ("in", "not_in"):
        listed = [v for v in value if v is not None]
        member = c.isin([lit(v) for v in listed]) if listed else F.lit(False)
        return member if op == "in" else ~member | c.isNull()
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "between":
        return (c >= lit(value[0])) & (c <= lit(value[1]))
    x = lit(value)
    return {"gt": c > x, "gte": c >= x, "lt": c < x, "lte": c <= x}[op]


def surely(mask: Column) -> Column:
    """A predicate that is never null."""
    return F.coalesce(mask, F.lit(False))


def _shape_problem(dtype: str, op: str, value: Any) -> str | None:
    if op in ("is_null", "not_null"):
        return None if value is True else "the value has to be True"
    if op in ("in", "not_in"):
        if isinstance(value, (str, bytes)) or not isinstance(value, (list, tuple, set, frozenset)):
            return "a list is needed"
        return None
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            return "two bounds are needed"
    elif isinstance(value, (list, tuple, set, dict)) or value is None:
        return "one value is needed"
    values = value if isinstance(value, (list, tuple)) else [value]
    if dtype == "datetime":
        try:
            for v in values:
                utc_literal(v)
        except (ValueError, TypeError):
            return "it isn't a time"
    if op in ORDERED and dtype in ("int", "float") and not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return "a number is needed"
    return None


def where_mask(df: DataFrame, where: Mapping[str, Any], dtypes: Mapping[str, str], issues: Issues, prefix: str, allow_set: bool = False) -> list[tuple[str, Column]]:
    """The predicates of all usable clauses; others are left out with an issue."""
    out: list[tuple[str, Column]] = []
    for name, value in where.items():
        if name not in df.columns:
            issues.err(f"{prefix}.WHERE.FIELD_NOT_FOUND", f"there is no column {name!r}", field=name)
            continue
        kind = df.schema[name].dataType
        dtype = dtypes.get(name) or logical_type(kind)
        clause = _clause(value, allow_set)
        if not clause:
            issues.err(f"{prefix}.WHERE.INVALID_VALUE_SHAPE", "a set or an empty clause can't be used", field=name)
            continue
        for op, v in clause.items():
            if op not in KNOWN:
                issues.err(f"{prefix}.WHERE.OP_UNKNOWN", f"operator {op!r} is unknown", field=name)
            elif op not in OPERATORS.get(dtype, OPERATORS["string"]):
                issues.err(f"{prefix}.WHERE.OP_INCOMPATIBLE", f"operator {op!r} isn't for dtype {dtype}", field=name)
            elif problem := _shape_problem(dtype, op, v):
                issues.err(f"{prefix}.WHERE.INVALID_VALUE_SHAPE", f"{op}: {problem}", field=name)
            elif allow_set and op in ("in", "not_in") and not list(v):
                issues.err(f"{prefix}.WHERE.EMPTY_SEQUENCE", f"{op} has no values", field=name)
            else:
                out.append((f"{name}.{op}", predicate(F.col(f"`{name}`"), dtype, kind, op, v)))
    return out


def time_mask(t: TimeFilter) -> Column:
    """Half-open for starts and ends, open for overlaps, and `contains` is a trip inside the interval."""
    start, end = utc_literal(t.start), utc_literal(t.end)
    o, d = F.col("origin_time_utc"), F.col("destination_time_utc")
    return {
        "starts_within": (o >= start) & (o < end),
        "ends_within": (d >= start) & (d < end),
        "contains": (o >= start) & (d <= end),
        "overlaps": (o < end) & (d > start),
    }[t.predicate]


def by_ends(make, which: str) -> Column:
    """A predicate on origin, destination, both or either."""
    if which == "both":
        return make("origin") & make("destination")
    if which == "either":
        return make("origin") | make("destination")
    return make(which)


def cells_mask(cells: Sequence[str], which: str) -> Column:
    return by_ends(lambda e: F.col(f"{e}_h3_index").isin(list(cells)), which)


def in_cells(df: DataFrame, cells: Sequence[str], which: str) -> DataFrame:
    """Rows whose cells are listed; long lists are joined."""
    if len(cells) < MANY_CELLS:
        return df.filter(cells_mask(cells, which))
    table = df.sparkSession.createDataFrame([(c,) for c in cells], "cell string")
    for end in ("origin", "destination"):
        marks = table.select(F.col("cell").alias(f"_{end}"))
        df = df.join(marks, df[f"{end}_h3_index"] == marks[f"_{end}"], "left")
    mask = by_ends(lambda e: F.col(f"_{e}").isNotNull(), which)
    return df.filter(mask).drop("_origin", "_destination")


def axis_counts(df: DataFrame, axes: Sequence[tuple[str, Column]]) -> dict[str, int]:
    """Rows in, and rows that each axis drops of those left by the ones before; one aggregate."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("rows_in")]
    for name, mask in axes:
        mask = surely(mask)
        aggs.append(F.count_if(passed & ~mask).alias(name))
        passed = passed & mask
    return df.agg(*aggs).first().asDict()


def _check_cells(cells: Iterable[str] | None, issues: Issues, prefix: str, fatal: bool) -> list[str]:
    """Distinct usable cells, lower-case."""
    if cells is None:
        return []
    listed = [cells] if isinstance(cells, str) else list(cells)
    good, bad = [], []
    for c in listed:
        if c is None:
            continue
        (good if _cell_text_valid(str(c)) else bad).append(str(c).strip().lower())
    if bad:
        (issues.fatal if fatal else issues.err)(f"{prefix}.H3.INVALID_CELL_VALUES", f"{len(bad)} cells are invalid", details={"cells": bad[:10]})
    return sorted(set(good))


def _cell_text_valid(text: str) -> bool:
    try:
        v = int(text.strip(), 16)
    except ValueError:
        return False
    if v >> 63 or (v >> 59) != 1 or (v >> 56) & 7 or (v >> 45) & 127 > 121:
        return False
    res = (v >> 52) & 15
    digits = [(v >> 3 * (15 - r)) & 7 for r in range(1, 16)]
    leading = next((d for d in digits[:res] if d), 0)
    return all(d < 7 for d in digits[:res]) and all(d == 7 for d in digits[res:]) and not ((v >> 45) & 127 in h3bits.PENTAGONS and leading == 1)


def filter_trips(trips: TripDataset, options: FilterOptions | None = None, *, max_issues: int = 1000, sample_rows_per_issue: int = 20) -> tuple[TripDataset, Report]:
    """Trips that pass all axes, in the order where, time, bbox, polygon, cells."""
    options = options or FilterOptions()
    issues = Issues(FilterFailed, options.strict, max_issues)
    df = trips.data
    if options.spatial_predicate not in SPATIAL_PREDICATES:
        issues.fatal("FLT.CONFIG.SPATIAL_PREDICATE", f"spatial predicate {options.spatial_predicate!r} is unknown")
    which = options.spatial_predicate
    dtypes = {n: f.dtype for n, f in trips.schema.fields.items()} | dict(trips.effective.dtypes)
    axes: list[tuple[str, Column]] = []
    if options.where:
        parts = [m for _, m in where_mask(df, options.where, dtypes, issues, "FLT")]
        if parts:
            axes.append(("where", reduce(lambda a, b: a & b, parts)))
    if options.time is not None:
        t = options.time
        if t.predicate not in TIME_PREDICATES:
            issues.fatal("FLT.TIME.PREDICATE", f"time predicate {t.predicate!r} is unknown")
        start, end = _as_datetime(t.start, issues), _as_datetime(t.end, issues)
        if start >= end:
            issues.fatal("FLT.TIME.INTERVAL", "start has to be before end")
        if trips.tier != "tier_1":
            issues.err("FLT.TIME.UNSUPPORTED_TIER", f"times can't be compared in {trips.tier}")
        elif not {"origin_time_utc", "destination_time_utc"} <= set(df.columns):
            issues.err("FLT.TIME.MISSING_REQUIRED_COLUMNS", "the UTC times are missing")
        else:
            axes.append(("time", time_mask(t)))
    ends = [which] if which in ("origin", "destination") else ["origin", "destination"]
    located = all(f"{e}_{x}" in df.columns for e in ends for x in ("latitude", "longitude"))
    at = lambda e: (F.col(f"{e}_longitude"), F.col(f"{e}_latitude"))
    if options.bbox is not None:
        box = list(options.bbox)
        if len(box) != 4 or not all(isinstance(v, (int, float)) for v in box) or box[0] > box[2] or box[1] > box[3]:
            issues.fatal("FLT.BBOX.INVALID", "a box is min_lon, min_lat, max_lon, max_lat")
        if located:
            axes.append(("bbox", by_ends(lambda e: geo.in_bbox(*at(e), box), which)))
        else:
            issues.err("FLT.SPATIAL.MISSING_REQUIRED_COLUMNS", "coordinates are missing")
    if options.polygon is not None:
        ring = [tuple(p) for p in options.polygon]
        if len(set(ring)) < 3:
            issues.fatal("FLT.POLYGON.INVALID", "a polygon has three vertices or more")
        if located:
            axes.append(("polygon", by_ends(lambda e: geo.in_polygon(*at(e), ring), which)))
        else:
            issues.err("FLT.SPATIAL.MISSING_REQUIRED_COLUMNS", "coordinates are missing")
    cells = _check_cells(options.h3_cells, issues, "FLT", fatal=True)
    joined = None
    if options.h3_cells is not None:
        if not all(f"{e}_h3_index" in df.columns for e in ends):
            issues.err("FLT.SPATIAL.H3_FIELD_MISSING", "cell columns are missing")
        elif len(cells) < MANY_CELLS:
            axes.append(("h3_cells", cells_mask(cells, which)))
        else:
            joined = cells
    out = df
    for _, mask in axes:
        out = out.filter(mask)
    counts = axis_counts(df, axes)
    rows_in = counts.pop("rows_in")
    if joined is not None:
        before = rows_in - sum(counts.values())
        out = in_cells(out, joined, which)
        counts["h3_cells"] = before - out.count()
    rows_out = rows_in - sum(counts.values())
    if rows_in and not rows_out:
        issues.warn("FLT.OUTPUT.EMPTY", "no row is left")
    summary = {"rows_in": rows_in, "rows_out": rows_out, "dropped_total": rows_in - rows_out, "dropped_by_axis": counts}
    parameters = {"where": json_safe(options.where), "time": json_safe(vars(options.time)) if options.time else None, "bbox": json_safe(options.bbox), "polygon": json_safe(options.polygon), "h3_cells": cells[:100] or None, "spatial_predicate": which}
    result = trips.after("filter_trips", parameters, summary, issues, data=out)
    if not options.keep_metadata:
        result = TripDataset(out, trips.schema, trips.provenance, metadata={"is_validated": trips.is_validated}, effective=trips.effective)
    samples = {n: df.filter(~surely(m)).limit(sample_rows_per_issue) for n, m in axes}
    report = Report(issues.ok, issues.kept("FLT.REPORT.ISSUES_TRUNCATED"), summary, parameters, {"dropped_samples": samples})
    issues.raise_if_strict()
    return result, report


def _as_datetime(value: Any, issues: Issues) -> dt.datetime:
    try:
        at = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    except ValueError:
        issues.fatal("FLT.TIME.BOUND", f"{value!r} isn't a time")
        raise
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


def filter_flows(flows: FlowDataset, options: FlowFilterOptions | None = None, *, max_issues: int = 1000, sample_rows_per_issue: int = 20) -> tuple[FlowDataset, Report]:
    """Flows that pass attributes and cells; the bridge to trips is kept in step by a semi-join, long lists of cells by joins."""
    options = options or FlowFilterOptions()
    issues = Issues(FilterFailed, options.strict, max_issues)
    df = flows.flows
    missing = [c for c in ("flow_id", "origin_h3_index", "destination_h3_index", "flow_count", "flow_value") if c not in df.columns]
    if missing:
        issues.fatal("FLT.INPUT.CORE_COLUMNS_MISSING", f"columns are missing: {missing}")
    which = options.spatial_predicate
    if which not in SPATIAL_PREDICATES:
        issues.fatal("FLT.CONFIG.SPATIAL_PREDICATE", f"spatial predicate {which!r} is unknown")
    axes: list[tuple[str, Column]] = []
    if options.where:
        parts = [m for _, m in where_mask(df, options.where, FLOW_CORE, issues, "FLT", allow_set=True)]
        if parts:
            axes.append(("where", reduce(lambda a, b: a & b, parts)))
    joined = None
    if options.h3_cells is not None:
        listed = [c for c in ([options.h3_cells] if isinstance(options.h3_cells, str) else options.h3_cells) if c is not None]
        if not listed:
            issues.fatal("FLT.H3.EMPTY", "the list of cells is empty")
        cells = _check_cells(listed, issues, "FLT", fatal=False)
        if len(cells) >= MANY_CELLS:
            joined = cells
        elif cells:
            axes.append(("h3_cells", cells_mask(cells, which)))
    out = df
    for _, mask in axes:
        out = out.filter(mask)
    counts = axis_counts(df, axes)
    rows_in = counts.pop("rows_in")
    samples = {n: df.filter(~surely(m)).limit(sample_rows_per_issue) for n, m in axes}
    if joined is not None:
        before = rows_in - sum(counts.values())
        samples["h3_cells"] = out.join(in_cells(out, joined, which).select("flow_id"), "flow_id", "left_anti").limit(sample_rows_per_issue)
        out = in_cells(out, joined, which)
        counts["h3_cells"] = before - out.count()
    rows_out = rows_in - sum(counts.values())
    bridge = None
    if options.keep_flow_to_trips and flows.flow_to_trips is not None:
        if {"flow_id", "movement_id"} <= set(flows.flow_to_trips.columns):
            bridge = flows.flow_to_trips.join(out.select("flow_id"), "flow_id", "left_semi") if axes or joined else flows.flow_to_trips
        else:
            issues.err("FLT.AUX.FLOW_TO_TRIPS_INVALID", "the bridge needs flow_id and movement_id")
    if rows_in and not rows_out:
        issues.warn("FLT.OUTPUT.EMPTY", "no flow is left")
    summary = {"rows_in": rows_in, "rows_out": rows_out, "dropped_total": rows_in - rows_out, "dropped_by_axis": counts}
    parameters = {"where": json_safe(options.where), "h3_cells": json_safe(list(options.h3_cells))[:100] if options.h3_cells else None, "spatial_predicate": which, "keep_flow_to_trips": options.keep_flow_to_trips}
    result = flows.after("filter_flows", parameters, summary, issues, flows=out, flow_to_trips=bridge)
    if not options.keep_metadata:
        result = FlowDataset(out, bridge, flows.aggregation_spec, flows.source_trips, flows.provenance, {})
    report = Report(issues.ok, issues.kept("FLT.REPORT.ISSUES_TRUNCATED"), summary, parameters, {"dropped_samples": samples})
    issues.raise_if_strict()
    return result, report
