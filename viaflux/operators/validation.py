"""Validation of trips and traces: one aggregate for all row checks, a shuffle for each uniqueness check."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import TraceDataset, TripDataset, json_safe
from ..functions import coerce, h3bits, timeutil
from ..issues import Issues, Report, ValidationFailed
from ..schema import OD_COORDINATES, FieldSpec, TripSchema, payload_problem
from .filtering import utc_literal


@dataclass(frozen=True)
class ValidationOptions:
    strict: bool = False
    max_issues: int = 500
    sample_rows_per_issue: int = 5
    validate_required_fields: bool = True
    validate_types_and_formats: bool = True
    validate_constraints: bool = True
    validate_domains: str = "off"  # off, full or sample
    domains_sample_frac: float = 0.01
    domains_min_in_domain_ratio: float = 1.0
    validate_temporal_consistency: bool = False
    validate_duplicates: bool = False
    duplicates_subset: Sequence[str] | None = None
    allow_partial_od_spatial: bool = True


@dataclass(frozen=True)
class TraceValidationOptions:
    strict: bool = False
    sample_rows_per_issue: int = 5
    validate_required_fields: bool = True
    validate_types_and_formats: bool = True
    validate_constraints: bool = True
    validate_monotonic_time_per_user: bool = True


def uninterpretable(df: DataFrame, name: str, dtype: str) -> Column:
    """Non-null values that the dtype can't read; text fields never fail."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if dtype == "int":
        v = coerce.number(c, kind)
        return c.isNotNull() & (v.isNull() | (F.abs(v - F.round(v)) > 1e-8))
    if dtype == "float":
        return c.isNotNull() & coerce.number(c, kind).isNull()
    if dtype == "bool":
        return c.isNotNull() & coerce.boolean(c, kind).isNull()
    if dtype == "datetime":
        return c.isNotNull() & timeutil.to_utc(c, kind).isNull()
    return F.lit(False)


def violation(df: DataFrame, name: str, key: str, payload: Any, full_match: bool = False) -> Column | None:
    """Rows that break a constraint; None for those that aren't row checks. Nulls never break one but nullable."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    no = lambda x: F.coalesce(x, F.lit(False))
    if key == "nullable":
        return c.isNull() if payload is False else F.lit(False)
    if key in ("range", "datetime"):
        if coerce.is_time(kind) or key == "datetime":
            v, lit = timeutil.to_utc(c, kind), utc_literal
        else:
            v, lit = coerce.number(c, kind), F.lit
        out = F.lit(False)
        if payload.get("min") is not None:
            out = out | no(v < lit(payload["min"]))
        if payload.get("max") is not None:
            out = out | no(v > lit(payload["max"]))
        if key == "datetime" and payload.get("allow_naive") is False and kind.typeName() == "timestamp_ntz":
            out = out | c.isNotNull()
        return out
    if key == "pattern":
        p = f"^(?:{payload})$" if full_match else f"^(?:{payload})"
        return no(~c.cast("string").rlike(p))
    if key == "length":
        n = F.char_length(c.cast("string"))
        low, high = payload.get("min"), payload.get("max")
        return no((n < low if low is not None else F.lit(False)) | (n > high if high is not None else F.lit(False)))
    if key == "h3":
        rule = {"require_valid": payload} if isinstance(payload, bool) else payload
        out = F.lit(False)
        v = F.col(f"_v_{name}") if f"_v_{name}" in df.columns else h3bits.to_long(c)
        if rule.get("require_valid", True):
            out = out | (c.isNotNull() & ~h3bits.long_valid(v))
        if rule.get("resolution") is not None:
            out = out | no(h3bits.long_resolution(v) != rule["resolution"])
        return out
    return None


def with_parsed_cells(df: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    """The ids of fields with cell constraints as columns `_v_<field>`, parsed once for all checks."""
    return df.withColumns({f"_v_{f.name}": h3bits.to_long(F.col(f"`{f.name}`")) for f in fields if f.name in df.columns and "h3" in (f.constraints or {})})


def repeated(df: DataFrame, subset: Sequence[str], drop_nulls: bool) -> int:
    """Members of groups of two or more equal rows; nulls are left out or equal."""
    rows = df.dropna(subset=list(subset)) if drop_nulls else df
    n = rows.groupBy(*[f"`{c}`" for c in subset]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.sum("n").alias("n")).first()["n"]
    return int(n or 0)


def _exact_text(df: DataFrame, name: str) -> Column:
    """A text that is equal where the column's values are; zeros lose their sign, as they do in a grouping."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    return c.cast("string")


def repeated_all(df: DataFrame, subsets: Sequence[tuple[Sequence[str], bool]]) -> list[int]:
    """`repeated` for several subsets of plain columns, from one pass over the rows and one shuffle."""
    if len(subsets) < 2 or any(isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for names, _ in subsets for c in names):
        return [repeated(df, names, drop) for names, drop in subsets]
    keys = []
    for i, (names, drop) in enumerate(subsets):
        key = F.struct(F.lit(i).alias("check"), F.array(*[_exact_text(df, c) for c in names]).alias("key"))
        whole = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in names])
        keys.append(F.when(whole, key) if drop else key)
    each = df.select(F.explode(F.array_compact(F.array(*keys))).alias("x")).select("x.check", "x.key")
    groups = each.groupBy("check", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = {r["check"]: r["n"] for r in groups.groupBy("check").agg(F.sum("n").alias("n")).collect()}
    return [int(found.get(i, 0)) for i in range(len(subsets))]


def partial_od_applies(columns: Sequence[str]) -> bool:
    pair = lambda e: {f"{e}_latitude", f"{e}_longitude"} <= set(columns)
    return pair("origin") or pair("destination")


def effective_nullable(spec: FieldSpec, required: Sequence[str], relaxed: bool) -> bool:
    if relaxed and spec.name in OD_COORDINATES:
        return True
    given = (spec.constraints or {}).get("nullable")
    return bool(given) if isinstance(given, bool) else spec.name not in required and not spec.required


def domain_of(trips: TripDataset, name: str) -> list[str] | None:
    """Effective domain, then that of the metadata, then the declared one."""
    for source in (trips.effective.domains, trips.metadata.get("domains_effective") or {}):
        if source.get(name, {}).get("values"):
            return list(source[name]["values"])
    spec = trips.schema.fields[name].domain
    return list(spec.values) if spec and spec.values else None


#: Rows that a sample orders to take an exact number; larger samples take what a threshold of the hash passes.
EXACT_SAMPLE = 10_000


def sampled(df: DataFrame, frac: float, rows: int) -> DataFrame:
    """About rows * frac rows, one at least, by a hash of all their columns, so reruns agree and equal values don't go together."""
    key = F.xxhash64(F.lit("sample"), *[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "map"])
    n = max(1, math.ceil(rows * frac))
    if n <= EXACT_SAMPLE:
        return df.orderBy(key).limit(n)
    return df.filter(F.pmod(key, F.lit(1 << 40)) < int(frac * (1 << 40)))


def validate_trips(trips: TripDataset, *, options: ValidationOptions | None = None) -> tuple[TripDataset, Report]:
    """The dataset with its verdict in metadata, and a report. Row checks are one aggregate over one scan."""
    o = options or ValidationOptions()
    issues = Issues(ValidationFailed, o.strict, o.max_issues)
    schema = trips.schema
    df = with_parsed_cells(trips.data, list(schema.fields.values()))
    if not 0 < o.domains_sample_frac <= 1:
        issues.fatal("VAL.CONFIG.SAMPLE_FRAC", "domains_sample_frac is in (0, 1]")
    if not 0 <= o.domains_min_in_domain_ratio <= 1:
        issues.fatal("VAL.CONFIG.MIN_RATIO", "domains_min_in_domain_ratio is in [0, 1]")
    if o.validate_domains not in ("off", "full", "sample"):
        issues.fatal("VAL.CONFIG.DOMAINS_MODE", f"domains mode {o.validate_domains!r} is unknown")
    if o.validate_duplicates:
        if not o.duplicates_subset or set(o.duplicates_subset) - set(df.columns):
            issues.fatal("VAL.CONFIG.DUPLICATES_SUBSET", "duplicates need a subset of existing columns")
    relaxed = o.allow_partial_od_spatial and partial_od_applies(df.columns)
    required = [r for r in schema.required if not (relaxed and r in OD_COORDINATES)]
    checks: list[tuple[str, str, str | None, Column]] = []  # code, message, field, rows
    if o.validate_required_fields:
        missing = [c for c in required if c not in df.columns]
        if missing:
            issues.err("VAL.CORE.REQUIRED_COLUMNS_MISSING", f"required columns are missing: {missing}", details={"missing": missing})
    fields = [f for f in schema.fields.values() if f.name in df.columns]
    if o.validate_constraints:
        if relaxed:
            ends = []
            for e in ("origin", "destination"):
                names = [f"{e}_latitude", f"{e}_longitude"]
                ends.append(F.lit(False) if not set(names) <= set(df.columns) else F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())
            checks.append(("VAL.CORE.OD_SPATIAL_BOTH_MISSING", "neither endpoint has coordinates", None, ~ends[0] & ~ends[1]))
        for f in fields:
            constraints = dict(f.constraints or {})
            if f.name in schema.required and constraints.get("nullable") is True and not (relaxed and f.name in OD_COORDINATES):
                issues.fatal("VAL.SCHEMA.REQUIRED_NULLABLE", f"{f.name!r} is required and nullable", field=f.name)
            if not effective_nullable(f, schema.required, relaxed):
                checks.append(("VAL.CORE.NULLABILITY_VIOLATION", "there are nulls", f.name, F.col(f"`{f.name}`").isNull()))
            for key, payload in constraints.items():
                if key == "nullable":
                    continue
                if problem := payload_problem(key, payload):
                    issues.warn("VAL.CONSTRAINT.SKIPPED", f"constraint {key!r}: {problem}", field=f.name)
                elif (bad := violation(df, f.name, key, payload)) is not None:
                    checks.append(("VAL.CORE.CONSTRAINT_VIOLATION", f"constraint {key!r} is broken", f.name, bad))
    if o.validate_types_and_formats:
        for f in fields:
            checks.append(("VAL.CORE.TYPE_OR_FORMAT_INVALID", f"values aren't {f.dtype}", f.name, uninterpretable(df, f.name, trips.effective.dtypes.get(f.name, f.dtype))))
    temporal = o.validate_temporal_consistency and trips.tier == "tier_1" and {"origin_time_utc", "destination_time_utc"} <= set(df.columns)
    if temporal:
        checks.append(("VAL.TEMPORAL.ORIGIN_AFTER_DESTINATION", "trips end before they start", None, F.coalesce(F.col("origin_time_utc") > F.col("destination_time_utc"), F.lit(False))))
    elif o.validate_temporal_consistency:
        issues.warn("VAL.TEMPORAL.NOT_EVALUATED", f"times can't be compared in {trips.tier}")
    domains = {f.name: domain_of(trips, f.name) for f in fields if trips.effective.dtypes.get(f.name, f.dtype) == "categorical"} if o.validate_domains != "off" else {}
    for name, values in domains.items():
        if not values:
            issues.warn("VAL.DOMAIN.MISSING_DOMAIN_INFO", "there is no domain to check the values by", field=name)
    member = {n: F.col(f"`{n}`").cast("string").isin(v) for n, v in domains.items() if v}
    in_scan = {} if o.validate_domains == "sample" else member
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(m).alias(f"c{i}") for i, (_, _, _, m) in enumerate(checks)],
        *[x for n, m in in_scan.items() for x in (F.count(F.col(f"`{n}`")).alias(f"d_{n}"), F.count_if(m).alias(f"i_{n}"))],
    ).first()
    rows = counts["rows"]
    for i, (code, message, name, mask) in enumerate(checks):
        if counts[f"c{i}"]:
            sample = [json_safe(r.asDict()) for r in df.filter(mask).drop(*[c for c in df.columns if c.startswith("_v_")]).limit(o.sample_rows_per_issue).collect()] if o.sample_rows_per_issue else []
            issues.err(code, message, field=name, row_count=counts[f"c{i}"], details={"sample": sample})
    alone = [f.name for f in fields if o.validate_constraints and (f.constraints or {}).get("unique") is True]
    subsets = [([name], True) for name in alone] + ([(list(o.duplicates_subset), False)] if o.validate_duplicates else [])
    groups = repeated_all(df, subsets)
    unique = dict(zip(alone, groups, strict=False))
    for name, n in unique.items():
        if n:
            issues.err("VAL.CORE.CONSTRAINT_VIOLATION", "constraint 'unique' is broken", field=name, row_count=n)
    ratios: dict[str, float] = {}
    if member:
        seen = counts if in_scan else sampled(trips.data, o.domains_sample_frac, rows).agg(*[x for n, m in member.items() for x in (F.count(F.col(f"`{n}`")).alias(f"d_{n}"), F.count_if(m).alias(f"i_{n}"))]).first()
        for name in member:
            total = seen[f"d_{name}"]
            ratios[name] = seen[f"i_{name}"] / total if total else 1.0
            if ratios[name] < o.domains_min_in_domain_ratio:
                issues.err("VAL.DOMAIN.RATIO_BELOW_MIN", f"{ratios[name]:.4f} of the values are in the domain", field=name)
            elif ratios[name] < 1:
                issues.warn("VAL.DOMAIN.PARTIAL_COVERAGE", f"{ratios[name]:.4f} of the values are in the domain", field=name)
    duplicates = groups[-1] if o.validate_duplicates else 0
    if duplicates:
        issues.err("VAL.DUPLICATES.ROWS_FOUND", f"{duplicates} rows are repeated", row_count=duplicates)
    summary = {"rows": rows, "ok": issues.ok, "domains": ratios, "duplicates": duplicates, "temporal_checked": temporal}
    parameters = json_safe(asdict(o))
    out = trips.after("validate_trips", parameters, summary, issues, metadata={"is_validated": issues.ok})
    report = Report(issues.ok, issues.kept("VAL.REPORT.ISSUES_TRUNCATED"), summary, parameters)
    issues.raise_if_strict()
    return out, report


def time_regressions(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Points whose time is before that of the same user's previous one, in row order; null users and times are left out."""
    rows = df.filter(F.col("user_id").isNotNull() & F.col("time_utc").isNotNull())
    if order is None:
        rows, by = rows.withColumn("_order", F.monotonically_increasing_id()), ["_order"]
    else:
        by = list(order)
    before = F.lag("time_utc").over(Window.partitionBy("user_id").orderBy(*by))
    return rows.withColumn("_before", before).filter(F.col("_before") > F.col("time_utc")).drop("_before", "_order")


def validate_traces(traces: TraceDataset, *, options: TraceValidationOptions | None = None, row_order: Sequence[str] | None = None) -> tuple[TraceDataset, Report]:
    """The points with their verdict in metadata, and a report. Patterns have to match whole values here."""
    o = options or TraceValidationOptions()
    issues = Issues(ValidationFailed, o.strict)
    for name, value in vars(o).items():
        if name.startswith("validate_") and not isinstance(value, bool):
            issues.fatal("VAL.CONFIG.FLAG", f"{name} is a boolean")
    schema = traces.schema
    df = with_parsed_cells(traces.data, list(schema.fields.values()))
    fields = [f for f in schema.fields.values() if f.name in df.columns]
    checks: list[tuple[str, str, str | None, Column]] = []
    if o.validate_required_fields:
        for name in schema.required:
            if name not in df.columns:
                issues.err("VAL.REQUIRED.MISSING_COLUMN", f"column {name!r} is missing", field=name)
            else:
                checks.append(("VAL.REQUIRED.NULL_IN_REQUIRED", "there are nulls", name, F.col(f"`{name}`").isNull()))
    if o.validate_types_and_formats:
        for f in fields:
            checks.append(("VAL.TYPES.UNPARSEABLE_VALUE", f"values aren't {f.dtype}", f.name, uninterpretable(df, f.name, f.dtype)))
    unique = {}
    if o.validate_constraints:
        for f in fields:
            for key, payload in (f.constraints or {}).items():
                if problem := payload_problem(key, payload):
                    issues.warn("VAL.CONSTRAINTS.SKIPPED", f"constraint {key!r}: {problem}", field=f.name)
                elif key == "unique" and payload:
                    unique[f.name] = repeated(df, [f.name], True)
                elif (bad := violation(df, f.name, key, payload, full_match=True)) is not None:
                    checks.append(("VAL.CONSTRAINTS.VIOLATION", f"constraint {key!r} is broken", f.name, bad))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(m).alias(f"c{i}") for i, (_, _, _, m) in enumerate(checks)]).first()
    for i, (code, message, name, mask) in enumerate(checks):
        if counts[f"c{i}"]:
            sample = [json_safe(r.asDict()) for r in df.filter(mask).drop(*[c for c in df.columns if c.startswith("_v_")]).limit(o.sample_rows_per_issue).collect()] if o.sample_rows_per_issue else []
            issues.err(code, message, field=name, row_count=counts[f"c{i}"], details={"sample": sample})
    for name, n in unique.items():
        if n:
            issues.err("VAL.CONSTRAINTS.VIOLATION", "constraint 'unique' is broken", field=name, row_count=n)
    backwards = 0
    if o.validate_monotonic_time_per_user and {"user_id", "time_utc"} <= set(df.columns):
        backwards = time_regressions(df, row_order).count()
        if backwards:
            issues.warn("VAL.MONOTONICITY.REGRESSION", f"{backwards} points are earlier than the one before", row_count=backwards)
    summary = {"rows": counts["rows"], "ok": issues.ok, "regressions": backwards}
    parameters = json_safe(asdict(o))
    out = traces.after("validate_traces", parameters, summary, issues, metadata={"is_validated": issues.ok})
    issues.raise_if_strict()
    return out, Report(issues.ok, issues.all, summary, parameters)


def with_schema(trips: TripDataset, schema: TripSchema) -> TripDataset:
    return replace(trips, schema=schema)


def declared_domains(schema: TripSchema) -> Mapping[str, list[str]]:
    return {n: list(f.domain.values) for n, f in schema.fields.items() if f.domain}
