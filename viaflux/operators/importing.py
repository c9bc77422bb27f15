"""Import of raw tables as canonical trips or traces.

Everything but three things stays one lazy projection: observed values of
categorical fields, counts for the report, and unique row ids are needed before
the plan is final. Categorical values are read in one aggregate over all such
fields, counts in another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import TraceDataset, TripDataset, json_safe, new_id
from ..functions import coerce, h3proj, timeutil
from ..issues import ImportFailed, Issues, Report
from ..session import cut
from ..schema import OD_COORDINATES, TRACE_CORE, DomainSpec, EffectiveSchema, FieldSpec, TraceSchema, TripSchema, lint, tier_of

SOFT_COLUMNS, HARD_COLUMNS = 256, 1024
MAX_DOMAIN, DOMAIN_SHARE = 10_000, 0.05
#: Values that stand for "unknown", the first in a domain is used.
UNKNOWN = ("unknown", "other", "OTHER", "Unknown")
ROW = "_row"


@dataclass(frozen=True)
class ImportOptions:
    keep_extra_fields: bool = True
    selected_fields: Sequence[str] | None = None
    strict: bool = False
    strict_domains: bool = False
    single_stage: bool = False
    source_timezone: str | None = None


@dataclass(frozen=True)
class ImportTraceOptions:
    keep_extra_fields: bool = True
    selected_fields: Sequence[str] | None = None
    strict: bool = False
    source_timezone: str | None = None


def known_zone(name: str) -> bool:
    import zoneinfo

    try:
        zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return False
    return True


def with_row_number(df: DataFrame, column: str = ROW, order: Sequence[str | Column] | None = None) -> DataFrame:
    """A dense row number from 0 without collecting rows into one task.

    In the order of `order` if given, else as partitions are read. Partition
    sizes (one number for each) are all that reaches the driver. Rows are
    written once, so the sizes are those of the rows that are numbered.
    """
    df = cut(df.orderBy(*order) if order else df)
    tagged = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    start, before = [], 0
    for r in sizes:
        start.append((r["_part"], before))
        before += r["n"]
    # a row for each partition: small enough to broadcast
    offsets = df.sparkSession.createDataFrame(start, "_part long, _before long")
    numbered = tagged.join(F.broadcast(offsets), "_part", "left")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(column))


def normalise_domain(c: Column, mapping: Mapping[str, str] | None) -> Column:
    """Trimmed text, recoded by exact pairs, all at once."""
    t = coerce.text(c)
    if not mapping:
        return t
    pairs = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (str(k), str(v))])
    return F.coalesce(F.element_at(pairs, t), t)


def observed_values(df: DataFrame, fields: Sequence[str], limit: int = MAX_DOMAIN, whole: Sequence[str] = ()) -> dict[str, dict[str, Any]]:
    """Of each text field: non-null rows, distinct values, and the values where they are at most `limit` or the field is in `whole`, from one pass."""
    if not fields:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("v")) for f in fields])).alias("x")).select("x.*").filter("v IS NOT NULL")
    counts = long.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")).persist()  # read twice; computed anew if an executor is lost
    sizes = {r["f"]: r for r in counts.groupBy("f").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).collect()}
    small = [f for f in fields if f in sizes and (f in whole or sizes[f]["distinct"] <= limit)]
    values: dict[str, list[str]] = {f: [] for f in fields}
    if small:
        for r in counts.filter(F.col("f").isin(small)).select("f", "v").collect():
            values[r["f"]].append(r["v"])
    counts.unpersist()
    return {f: {"rows": sizes[f]["rows"] if f in sizes else 0, "distinct": sizes[f]["distinct"] if f in sizes else 0, "values": sorted(values[f])} for f in fields}


def extended_fields(specs: Mapping[str, FieldSpec], fields: Sequence[str], strict_domains: bool) -> list[str]:
    """The fields whose declared domain takes up all that is observed, so that their values are needed at any number."""
    return [f for f in fields if not strict_domains and (d := specs[f].domain) and d.values and d.extendable]


class _Rename:
    """The correspondence canonical -> source, checked against the columns."""

    def __init__(self, df: DataFrame, schema: TripSchema, pairs: Mapping[str, str] | None, issues: Issues, derivable: set[str]):
        self.map: dict[str, str] = {}
        used: dict[str, str] = {}
        for canonical, source in (pairs or {}).items():
            if canonical not in schema.fields:
                issues.fatal("IMP.MAP.UNKNOWN_CANONICAL", f"{canonical!r} isn't a field of the schema", field=canonical, source_field=source)
            if source not in df.columns:
                required = canonical in schema.required and canonical not in derivable
                (issues.fatal if required else issues.warn)("IMP.MAP.SOURCE_MISSING", f"source column {source!r} is missing", field=canonical, source_field=source)
                continue
            if source in used:
                issues.fatal("IMP.MAP.DUPLICATE_SOURCE", f"{source!r} is the source of {used[source]!r} and {canonical!r}", field=canonical, source_field=source)
            if canonical in df.columns and canonical != source:
                issues.fatal("IMP.MAP.CANONICAL_PRESENT", f"column {canonical!r} is there already", field=canonical, source_field=source)
            used[source] = canonical
            self.map[canonical] = source

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({s: c for c, s in self.map.items() if s != c})


def import_trips_from_dataframe(
    df: DataFrame,
    schema: TripSchema,
    *,
    source_name: str | None = None,
    options: ImportOptions | None = None,
    field_correspondence: Mapping[str, str] | None = None,
    value_correspondence: Mapping[str, Mapping[str, str]] | None = None,
    provenance: Mapping[str, Any] | None = None,
    h3_resolution: int = 8,
    row_order: Sequence[str] | None = None,
) -> tuple[TripDataset, Report]:
    """Canonical trips of a raw table.

    Order: schema, rename, tier, categoricals, dtypes, times, local times,
    coordinates, cells, ids, selection, caps. `row_order` names columns that
    fix the order behind generated ids; without it they follow the scan.
    """
    options = options or ImportOptions()
    issues = Issues(ImportFailed, options.strict)
    if isinstance(h3_resolution, bool) or not isinstance(h3_resolution, int) or not 0 <= h3_resolution <= 15:
        issues.fatal("IMP.OPT.H3_RESOLUTION", f"H3 resolution {h3_resolution!r} isn't in 0..15")
    for name in options.selected_fields or ():
        if name not in schema.fields:
            issues.fatal("IMP.OPT.SELECTED_UNKNOWN", f"selected field {name!r} isn't in the schema", field=name)
    zone = options.source_timezone
    if zone is not None and not known_zone(zone):
        issues.warn("IMP.OPT.TIMEZONE_INVALID", f"time zone {zone!r} is unknown and not used")
        zone = None
    effective = EffectiveSchema()
    for code, message, name, fatal in lint(schema):
        issues.add("error" if fatal else "warning", f"IMP.{code}", message, field=name, fatal=fatal)
    for name, f in schema.fields.items():
        effective.dtypes[name] = f.dtype if f.dtype in coerce_dtypes() else "string"
        if effective.dtypes[name] != f.dtype:
            effective.overrides[name] = {"from": f.dtype, "to": "string", "reason": "unknown dtype"}

    derivable = {"movement_id", "origin_h3_index", "destination_h3_index"} | ({"trip_id", "movement_seq"} if options.single_stage else set())
    rename = _Rename(df, schema, field_correspondence, issues, derivable)
    rows_raw = df
    df = rename.apply(df)
    missing = [c for c in schema.required if c not in df.columns and c not in derivable]
    if missing:
        issues.fatal("IMP.REQUIRED.MISSING", f"required fields are missing: {missing}", details={"missing": missing})
    tier = tier_of(df.columns)
    effective.temporal = {"tier": tier}

    # categoricals: one job for what is observed in all of them
    recodes = {f: dict(m) for f, m in (value_correspondence or {}).items()}
    for name in recodes:
        if name not in schema.fields or name not in df.columns:
            issues.warn("IMP.VALUE.FIELD_MISSING", f"values of {name!r} can't be mapped", field=name)
    texts = [c for c in df.columns if effective.dtypes.get(c) == "categorical" or c in recodes]
    mapped = [c for c in recodes if c in df.columns]
    domains = [c for c in texts if effective.dtypes.get(c) == "categorical"]
    # a mapping of values that don't occur changes nothing, so values before and after it come from one pass
    raw = {f"{c}\u2190raw": c for c in mapped}
    both = df.select(*[coerce.text(F.col(f"`{c}`")).alias(r) for r, c in raw.items()], *[normalise_domain(F.col(f"`{c}`"), recodes.get(c)).alias(c) for c in domains])
    seen = observed_values(both, [*raw, *domains], whole=extended_fields(schema.fields, domains, options.strict_domains))
    raw_values = {c: seen[r] for r, c in raw.items()}
    applied = {c: {k: v for k, v in recodes[c].items() if k in set(raw_values[c]["values"]) or raw_values[c]["distinct"] > MAX_DOMAIN} for c in raw_values}
    df = df.withColumns({c: normalise_domain(F.col(f"`{c}`"), applied.get(c)) for c in texts})
    for name in domains:
        df = _domain_policy(df, schema.fields[name], seen[name], options, effective, issues)

    # dtypes; a value that is lost is counted, all counts in one aggregate
    lost: dict[str, Column] = {}
    new: dict[str, Column] = {}
    kinds = {f.name: f.dataType for f in df.schema}
    for name in df.columns:
        dtype = effective.dtypes.get(name)
        c = F.col(f"`{name}`")
        if dtype is None or name in domains:
            continue
        if name in OD_COORDINATES:
            new[name] = coerce.coordinate(c, kinds[name])
        elif dtype == "datetime":
            new[name] = timeutil.to_utc(c, kinds[name], zone)
            if isinstance(kinds[name], (T.StringType, T.TimestampNTZType)) and zone is None:
                issues.info("IMP.TIME.NAIVE_AS_UTC", "times without a zone are read as UTC", field=name)
        elif name.endswith("_local_hhmm"):
            new[name] = coerce.hhmm(c)
        else:
            new[name] = coerce.to(dtype, c, kinds[name])
        had = coerce.text(c).isNotNull() if isinstance(kinds[name], T.StringType) else c.isNotNull()
        lost[name] = F.count_if(had & new[name].isNull())
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[x.alias(f"l_{k}") for k, x in lost.items()], *[F.count(new[k]).alias(f"u_{k}") for k in lost]).first()
    for name in lost:
        if not counts[f"l_{name}"]:
            continue
        if name in schema.required and not counts[f"u_{name}"]:
            issues.fatal("IMP.TYPE.REQUIRED_UNUSABLE", f"no value of {name!r} can be read", field=name, row_count=counts[f"l_{name}"])
        issues.warn("IMP.TYPE.PARTIAL", f"{counts[f'l_{name}']} values can't be read", field=name, row_count=counts[f"l_{name}"])
    df = df.withColumns(new)

    for end in ("origin", "destination"):
        lat, lon = f"{end}_latitude", f"{end}_longitude"
        if lat in df.columns and lon in df.columns:
            df = df.withColumn(f"{end}_h3_index", h3proj.cell_of(F.col(lat), F.col(lon), h3_resolution))
    rows = counts["_rows"]
    if "movement_id" not in df.columns:
        df = with_row_number(df, order=row_order).withColumn("movement_id", F.concat(F.lit("m"), F.col(ROW).cast("string"))).drop(ROW)
    else:
        twice = df.groupBy("movement_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND movement_id IS NOT NULL").agg(F.sum("n").alias("n")).first()["n"]
        if twice:
            issues.warn("IMP.ID.DUPLICATE_MOVEMENT_ID", f"{twice} rows share a movement_id", field="movement_id", row_count=twice)
    if options.single_stage:
        df = df.withColumn("trip_id", F.col("movement_id")).withColumn("movement_seq", F.lit(0).cast("long"))

    if options.selected_fields is None:
        wanted = list(schema.fields)
    else:
        wanted = [*schema.required, *[f for f in options.selected_fields if f not in schema.required]]
    columns = [c for c in wanted if c in df.columns]
    if options.keep_extra_fields:
        columns += [c for c in df.columns if c not in schema.fields]
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    if len(columns) > HARD_COLUMNS:
        issues.fatal("IMP.WIDTH.HARD_CAP", f"{len(columns)} columns are more than {HARD_COLUMNS}")
    if len(columns) > SOFT_COLUMNS:
        issues.warn("IMP.WIDTH.SOFT_CAP", f"{len(columns)} columns are more than {SOFT_COLUMNS}")
    missing = [c for c in schema.required if c not in columns]
    if missing:
        issues.fatal("IMP.REQUIRED.MISSING", f"required fields are missing: {missing}", details={"missing": missing})
    effective = effective.pruned(columns)
    parameters = {"source_name": source_name, "h3_resolution": h3_resolution, **json_safe(asdict(options))}
    summary = {"rows_in": rows, "rows_out": rows, "columns_in": len(rows_raw.columns), "columns_out": len(columns), "tier": tier}
    base = TripDataset(df, schema, dict(provenance or {}, source=source_name), dict(rename.map), applied, {"dataset_id": new_id("tripds"), "is_validated": False, "temporal": {"tier": tier}, "h3": {"resolution": h3_resolution}, "domains_effective": effective.domains}, effective)
    out = base.after("import_trips", parameters, summary, issues)
    issues.raise_if_strict()
    return out, Report(issues.ok, issues.all, summary, parameters, {"field_correspondence": dict(rename.map), "value_correspondence": applied})


def coerce_dtypes() -> tuple[str, ...]:
    return ("string", "int", "float", "datetime", "categorical", "bool")


def _domain_policy(df: DataFrame, spec: FieldSpec, seen: Mapping[str, Any], options: ImportOptions, effective: EffectiveSchema, issues: Issues) -> DataFrame:
    """Bootstrap an empty domain, extend an open one, or send strangers of a closed one to its unknown value."""
    name, domain = spec.name, spec.domain or DomainSpec()
    base = list(domain.values)
    if not base:
        if 0 < seen["distinct"] <= min(MAX_DOMAIN, DOMAIN_SHARE * seen["rows"]):
            effective.domains[name] = {"values": seen["values"], "extended": seen["values"], "bootstrapped": True}
            issues.info("IMP.DOMAIN.BOOTSTRAPPED", f"the domain is taken from {seen['distinct']} values", field=name)
        elif seen["distinct"]:
            effective.dtypes[name] = "string"
            effective.overrides[name] = {"from": "categorical", "to": "string", "reason": "too many values for a domain"}
            issues.warn("IMP.DOMAIN.DEGRADED", f"{seen['distinct']} values are too many for a domain", field=name)
        else:
            effective.domains[name] = {"values": [], "extended": []}
        return df
    c = F.col(f"`{name}`")
    strangers = sorted(set(seen["values"]) - set(base))
    count = len(strangers)
    if seen["distinct"] > len(seen["values"]):  # too many to be listed: counted, with a sample for the report
        outside = df.select(c.cast("string").alias("v")).filter(F.col("v").isNotNull() & ~F.col("v").isin(base)).distinct()
        count = outside.count()
        strangers = [r["v"] for r in outside.orderBy("v").limit(50).collect()]
    effective.domains[name] = {"values": base, "extended": []}
    if not strangers:
        return df
    if options.strict_domains:
        issues.fatal("IMP.DOMAIN.STRICT", f"values outside the domain: {strangers[:10]}", field=name, details={"values": strangers[:50]})
    if domain.extendable:
        effective.domains[name] = {"values": [*base, *strangers], "extended": strangers}
        issues.info("IMP.DOMAIN.EXTENDED", f"the domain is extended by {count} values", field=name, details={"values": strangers[:50]})
        return df
    unknown = next((u for u in UNKNOWN if u in base), UNKNOWN[0])
    if unknown not in base:
        effective.domains[name] = {"values": [*base, unknown], "extended": [unknown]}
    issues.warn("IMP.DOMAIN.OUT_OF_DOMAIN", f"{count} values become {unknown!r}", field=name, details={"values": strangers[:50]})
    return df.withColumn(name, F.when(c.isNull() | c.isin(base), c).otherwise(F.lit(unknown)))


def import_traces_from_dataframe(
    df: DataFrame,
    schema: TraceSchema,
    *,
    source_name: str | None = None,
    options: ImportTraceOptions | None = None,
    field_correspondence: Mapping[str, str] | None = None,
    provenance: Mapping[str, Any] | None = None,
    row_order: Sequence[str] | None = None,
) -> tuple[TraceDataset, Report]:
    """Canonical points of a raw table. A time that can't be read is fatal."""
    options = options or ImportTraceOptions()
    issues = Issues(ImportFailed, options.strict)
    if len(set(df.columns)) != len(df.columns):
        issues.fatal("IMP.INPUT.DUPLICATE_COLUMNS", "columns are named twice")
    if options.source_timezone is not None and not known_zone(options.source_timezone):
        issues.fatal("IMP.OPT.TIMEZONE_INVALID", f"time zone {options.source_timezone!r} is unknown")
    for code, message, name, fatal in lint(schema):
        worse = fatal or code.startswith("SCHEMA.CONSTRAINT")
        if code != "SCHEMA.DOMAIN_MISSING":
            issues.add("error" if worse else "warning", f"IMP.{code}", message, field=name, fatal=worse)
    for name, f in schema.fields.items():
        if f.dtype == "categorical":
            issues.fatal("IMP.SCHEMA.CATEGORICAL", "trace fields can't be categorical", field=name)
    zone = options.source_timezone
    if zone is None and schema.timezone is not None:
        if known_zone(schema.timezone):
            zone = schema.timezone
        else:
            issues.warn("IMP.SCHEMA.TIMEZONE_INVALID", f"the schema's time zone {schema.timezone!r} is unknown")
    sources: dict[str, str] = {}
    for canonical, source in (field_correspondence or {}).items():
        if canonical in sources.values():
            issues.fatal("IMP.MAP.TWO_SOURCES", f"{canonical!r} has two sources", field=canonical)
        if source not in df.columns:
            issues.warn("IMP.MAP.SOURCE_MISSING", f"source column {source!r} is missing", field=canonical, source_field=source)
            continue
        if canonical in df.columns and canonical != source:
            issues.fatal("IMP.MAP.TWO_SOURCES", f"{canonical!r} is there already", field=canonical, source_field=source)
        sources[source] = canonical
    columns_in = len(df.columns)
    df = df.withColumnsRenamed({s: c for s, c in sources.items() if s != c})
    missing = [c for c in dict.fromkeys([*TRACE_CORE[1:], *schema.required]) if c not in df.columns and c != "point_id"]
    if missing:
        issues.fatal("IMP.REQUIRED.MISSING", f"required fields are missing: {missing}", details={"missing": missing})
    kind = df.schema["time_utc"].dataType
    if zone is None and not isinstance(kind, T.TimestampType):
        issues.warn("IMP.TIME.ZONE_UNRESOLVED", "times without a zone are read as UTC", field="time_utc")
    time = timeutil.to_utc(F.col("time_utc"), kind, zone)
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("time_utc").isNotNull() & time.isNull()).alias("bad")).first()
    if counts["bad"]:
        issues.fatal("IMP.TIME.UNPARSEABLE", f"{counts['bad']} times can't be read", field="time_utc", row_count=counts["bad"])
    if not counts["n"]:
        issues.warn("IMP.INPUT.EMPTY", "there are no rows")
    df = df.withColumn("time_utc", time)
    if "point_id" not in df.columns:
        df = with_row_number(df, order=row_order).withColumn("point_id", F.concat(F.lit("p"), F.col(ROW).cast("string"))).drop(ROW)
        df = df.select("point_id", *[F.col(f"`{c}`") for c in df.columns if c != "point_id"])
    wanted = list(schema.fields) if options.selected_fields is None else [*schema.required, *options.selected_fields]
    keep = {*TRACE_CORE, *wanted}
    columns = [c for c in df.columns if c in keep or (options.keep_extra_fields and c not in schema.fields)]
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    parameters = {"source_name": source_name, **json_safe(asdict(options))}
    summary = {"rows_in": counts["n"], "rows_out": counts["n"], "columns_in": columns_in, "columns_out": len(columns)}
    base = TraceDataset(df, schema, dict(provenance or {}, source=source_name), {"dataset_id": new_id("traceds"), "is_validated": False})
    out = base.after("import_traces", parameters, summary, issues)
    issues.raise_if_strict()
    return out, Report(issues.ok, issues.all, summary, parameters)


def first_rows(df: DataFrame, keep: Column, limit: int) -> list[dict[str, Any]]:
    """A bounded sample of rows as evidence."""
    return [r.asDict() for r in df.filter(keep).limit(limit).collect()]


def dense_rank_id(df: DataFrame, order: Sequence[Column], column: str) -> DataFrame:
    """A row number from 0 over a total order: one range sort, written once, and the sizes of its ranges."""
    return with_row_number(df, column, order)


def by_window(partition: Sequence[str]) -> Any:
    return Window.partitionBy(*partition)
