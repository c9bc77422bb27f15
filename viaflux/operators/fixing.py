"""Corrections of field names and of categorical values."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..datasets import TripDataset, json_safe
from ..issues import FixFailed, Issues, Report
from .importing import observed_values

CONTEXT_KEYS = ("reason", "author", "source", "scope", "notes")


@dataclass(frozen=True)
class FixCorrespondenceOptions:
    strict: bool = False
    max_issues: int = 200
    sample_rows_per_issue: int = 50


def rename_fields(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(renames))


def recode(df: DataFrame, field: str, pairs: Mapping[Any, Any]) -> DataFrame:
    """All pairs at once: a value that one pair makes isn't changed by another."""
    if not pairs:
        return df
    table = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (str(k), None if v is None else str(v))])
    keys = [str(k) for k in pairs]
    c = F.col(f"`{field}`")
    return df.withColumn(field, F.when(c.isin(keys), F.element_at(table, c)).otherwise(c))


def clean_context(context: Mapping[str, Any] | None) -> tuple[dict[str, Any], list[str], list[str]]:
    """The known keys of a context as JSON-safe values; unknown keys and values that had to be turned to text."""
    if not context:
        return {}, [], []
    out, odd = {}, []
    for k in CONTEXT_KEYS:
        if k in context:
            try:
                json.dumps(context[k])
                out[k] = context[k]
            except (TypeError, ValueError):
                out[k] = str(context[k])
                odd.append(k)
    return out, sorted(set(context) - set(CONTEXT_KEYS)), odd


def fix_trips_correspondence(
    trips: TripDataset,
    *,
    field_corrections: Mapping[str, str] | None = None,
    value_corrections: Mapping[str, Mapping[Any, Any]] | None = None,
    options: FixCorrespondenceOptions | None = None,
    correspondence_context: Mapping[str, Any] | None = None,
) -> tuple[TripDataset, Report]:
    """Columns renamed (source -> canonical) and categorical values recoded; a real change clears the validated mark."""
    o = options or FixCorrespondenceOptions()
    issues = Issues(FixFailed, o.strict, o.max_issues)
    df, schema = trips.data, trips.schema
    if correspondence_context is not None and not isinstance(correspondence_context, Mapping):
        issues.fatal("FIX.CONTEXT.NOT_A_MAPPING", "the context has to be a mapping")
    context, unknown, odd = clean_context(correspondence_context)
    if unknown:
        issues.warn("FIX.CONTEXT.UNKNOWN_KEYS", f"keys are dropped: {unknown}")
    if odd:
        issues.warn("FIX.CONTEXT.NOT_SERIALIZABLE", f"values become text: {odd}")
    targets = list((field_corrections or {}).values())
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        issues.fatal("FIX.FIELD.AMBIGUOUS_TARGET", f"several sources have one target: {twice}")
    renames: dict[str, str] = {}
    for source, target in (field_corrections or {}).items():
        if source not in df.columns:
            issues.warn("FIX.FIELD.SOURCE_MISSING", f"there is no column {source!r}", source_field=source)
        elif target not in schema.fields:
            issues.err("FIX.FIELD.TARGET_NOT_IN_SCHEMA", f"{target!r} isn't in the schema", field=target, source_field=source)
        elif source == target or source in schema.fields:
            issues.warn("FIX.FIELD.ALREADY_CANONICAL", f"{source!r} is canonical already", source_field=source)
        elif target in df.columns:
            issues.err("FIX.FIELD.TARGET_ALREADY_EXISTS", f"column {target!r} is there already", field=target, source_field=source)
        else:
            renames[source] = target
    df = rename_fields(df, renames)
    correspondence = dict(trips.field_correspondence)
    for source, target in renames.items():
        correspondence[target] = next((o for c, o in trips.field_correspondence.items() if c == source), source)

    wanted: dict[str, Mapping[Any, Any]] = {}
    for name, pairs in (value_corrections or {}).items():
        if name not in df.columns:
            issues.warn("FIX.VALUE.FIELD_MISSING", f"there is no column {name!r}", field=name)
        elif name not in schema.fields or schema.fields[name].dtype != "categorical":
            issues.err("FIX.VALUE.FIELD_NOT_COMPATIBLE", f"{name!r} isn't a categorical field", field=name)
        elif not isinstance(pairs, Mapping):
            issues.err("FIX.VALUE.RULE_NOT_ALLOWED", "pairs of values are needed", field=name)
        else:
            wanted[name] = pairs
    replaced: dict[str, int] = {}
    domains = {k: dict(v) for k, v in trips.effective.domains.items()}
    changed: list[str] = []
    if wanted:
        counts = df.agg(*[F.count_if(F.col(f"`{n}`") == str(k)).alias(f"{i}_{j}") for i, (n, p) in enumerate(wanted.items()) for j, k in enumerate(p)]).first()
        for i, (name, pairs) in enumerate(wanted.items()):
            found = {k: counts[f"{i}_{j}"] for j, k in enumerate(pairs)}
            lost = [str(k) for k, n in found.items() if not n]
            if lost:
                issues.warn("FIX.VALUE.UNMATCHED", f"values don't occur: {lost[:10]}", field=name, details={"values": lost[: o.sample_rows_per_issue]})
            replaced[name] = sum(n for k, n in found.items() if str(k) != str(pairs[k]))
            if replaced[name]:
                df = recode(df, name, {k: pairs[k] for k, n in found.items() if n})
                changed.append(name)
        for name, seen in observed_values(df, changed, whole=changed).items():
            declared = schema.fields[name].domain
            base = [str(v) for v in declared.values] if declared else []
            domains[name] = {"values": [*base, *[v for v in seen["values"] if v not in base]], "extended": [v for v in seen["values"] if v not in base]}
    effective = trips.effective.pruned(df.columns)
    effective.domains = domains
    semantic = bool(renames or changed)
    summary = {"fields_renamed": dict(renames), "values_replaced": replaced, "changed": semantic}
    parameters = {"field_corrections": json_safe(field_corrections), "value_corrections": json_safe(value_corrections), "context": context, **json_safe(asdict(o))}
    metadata = {"is_validated": trips.is_validated and not semantic, "domains_effective": domains}
    values = {k: dict(v) for k, v in trips.value_correspondence.items()}
    for name in changed:
        values.setdefault(name, {}).update({str(k): str(v) for k, v in wanted[name].items()})
    out = trips.after("fix_trips_correspondence", parameters, summary, issues, metadata=metadata, data=df, field_correspondence=correspondence, value_correspondence=values, effective=effective)
    report = Report(issues.ok, issues.kept("FIX.REPORT.ISSUES_TRUNCATED"), summary, parameters)
    issues.raise_if_strict()
    return out, report
