"""Drop-only cleaning. Rules run in a fixed order on what earlier ones left; counts are incremental.

Stateless rules before and after the duplicates are one pass: each row gets the
first rule that it fails. Only duplicates need a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..datasets import TripDataset, json_safe
from ..functions import coerce, h3bits
from ..issues import CleanFailed, Issues, Report

RULES = ("nulls_required", "nulls_fields", "invalid_latlon", "invalid_h3", "origin_after_destination", "duplicates", "categorical_values")


@dataclass(frozen=True)
class CleanOptions:
    drop_rows_with_nulls_in_required_fields: bool = False
    drop_rows_with_nulls_in_fields: Sequence[str] | None = None
    drop_rows_with_invalid_latlon: bool = False
    drop_rows_with_invalid_h3: bool = False
    drop_rows_with_origin_after_destination: bool = False
    drop_duplicates: bool = False
    duplicates_subset: Sequence[str] | None = None
    drop_rows_by_categorical_values: Mapping[str, Sequence[Any]] | None = None


def any_null(fields: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{f}`").isNull() for f in fields], F.lit(False))


def invalid_latlon(df: DataFrame) -> Column:
    """An endpoint is half there, or not a place on earth, or both endpoints are missing."""
    bad, absent = [], []
    for end in ("origin", "destination"):
        names = f"{end}_latitude", f"{end}_longitude"
        there = [n in df.columns for n in names]
        raw = [F.col(f"`{n}`") if t else F.lit(None).cast("double") for n, t in zip(names, there, strict=True)]
        values = [coerce.number(c, df.schema[n].dataType) if t else c for c, n, t in zip(raw, names, there, strict=True)]
        full, none = raw[0].isNotNull() & raw[1].isNotNull(), raw[0].isNull() & raw[1].isNull()
        on_earth = F.coalesce(values[0].between(-90, 90) & values[1].between(-180, 180), F.lit(False))
        bad.append((~full & ~none) | (full & ~on_earth))
        absent.append(none)
    return bad[0] | bad[1] | (absent[0] & absent[1])


def invalid_h3() -> Column:
    return ~(h3bits.valid(F.col("origin_h3_index")) & h3bits.valid(F.col("destination_h3_index")))


def origin_after_destination() -> Column:
    return F.coalesce(F.col("origin_time_utc") > F.col("destination_time_utc"), F.lit(False))


def later_duplicate(subset: Sequence[str], order: Sequence[Column]) -> Column:
    """All but the first row of each group of equal values, nulls being equal."""
    return F.row_number().over(Window.partitionBy(*[f"`{c}`" for c in subset]).orderBy(*order)) > 1


def categorical_hit(drop: Mapping[str, Sequence[Any]]) -> Column:
    hits = []
    for name, values in drop.items():
        c = F.col(f"`{name}`")
        listed = [v for v in values if v is not None]
        hit = F.coalesce(c.isin(listed), F.lit(False)) if listed else F.lit(False)
        hits.append(hit | c.isNull() if any(v is None for v in values) else hit)
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def clean_trips(trips: TripDataset, *, options: CleanOptions | None = None, row_order: Sequence[str] | None = None) -> tuple[TripDataset, Report]:
    """Trips without the rows that the chosen rules drop; a validated dataset stays validated.

    Of duplicates the first by `row_order` stays (then by all columns' hash, so
    reruns agree). Rules whose columns are missing are skipped with a warning.
    """
    options = options or CleanOptions()
    issues = Issues(CleanFailed)
    df = trips.data
    columns = set(df.columns)
    for name in ("drop_rows_with_nulls_in_fields", "duplicates_subset"):
        value = getattr(options, name)
        if value is not None and (isinstance(value, str) or not all(isinstance(x, str) for x in value)):
            issues.fatal("CLN.CONFIG.INVALID_FIELD_LIST", f"{name} has to be a list of field names")
    rules: dict[str, Column] = {}

    def rule(name: str, wanted: bool, needed: Sequence[str], make) -> None:
        if not wanted:
            return
        missing = sorted(set(needed) - columns)
        if missing:
            issues.warn("CLN.RULE.SKIPPED", f"rule {name} needs {missing}", details={"rule": name, "missing": missing})
        else:
            rules[name] = make()

    required = list(trips.schema.required)
    rule("nulls_required", options.drop_rows_with_nulls_in_required_fields, required, lambda: any_null(required))
    listed = list(options.drop_rows_with_nulls_in_fields or ())
    rule("nulls_fields", bool(listed), listed, lambda: any_null(listed))
    rule("invalid_latlon", options.drop_rows_with_invalid_latlon, [], lambda: invalid_latlon(df))
    rule("invalid_h3", options.drop_rows_with_invalid_h3, ["origin_h3_index", "destination_h3_index"], invalid_h3)
    if options.drop_rows_with_origin_after_destination and trips.tier != "tier_1":
        issues.warn("CLN.RULE.TIER", f"times can't be compared in {trips.tier}")
    else:
        rule("origin_after_destination", options.drop_rows_with_origin_after_destination, ["origin_time_utc", "destination_time_utc"], origin_after_destination)
    subset: list[str] = []
    if options.drop_duplicates:
        if options.duplicates_subset is not None:
            subset = list(options.duplicates_subset)
            if not subset or set(subset) - columns:
                issues.fatal("CLN.DUPLICATES.SUBSET_MISSING", f"the subset has unknown columns: {sorted(set(subset) - columns)}")
        else:
            subset = [c for c in required if c in columns]
            if not subset:
                issues.warn("CLN.RULE.SKIPPED", "no required column is there to compare")
    drop = {}
    for name, values in (options.drop_rows_by_categorical_values or {}).items():
        dtype = trips.effective.dtypes.get(name) or (trips.schema.fields[name].dtype if name in trips.schema.fields else None)
        if name not in columns or dtype != "categorical":
            issues.warn("CLN.CATEGORICAL.SKIPPED", f"{name!r} isn't a categorical column", field=name)
        else:
            drop[name] = list(values)
    if drop:
        rules["categorical_values"] = categorical_hit(drop)

    early = [r for r in RULES[:5] if r in rules]
    label = F.lit(None).cast("string")
    for name in reversed(early):
        label = F.when(rules[name], F.lit(name)).otherwise(label)
    tagged = df.withColumn("_rule", label)
    if subset:
        order = [F.col(f"`{c}`").asc_nulls_last() for c in row_order or ()] + [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
        # rows that an earlier rule drops sort last and so never stand before a survivor
        own = Window.partitionBy(F.col("_rule").isNotNull(), *[F.col(f"`{c}`") for c in subset]).orderBy(*order)
        tagged = tagged.withColumn("_nth", F.row_number().over(own))
        tagged = tagged.withColumn("_rule", F.when(F.col("_rule").isNull() & (F.col("_nth") > 1), F.lit("duplicates")).otherwise(F.col("_rule"))).drop("_nth")
    if drop:
        tagged = tagged.withColumn("_rule", F.when(F.col("_rule").isNull() & rules["categorical_values"], F.lit("categorical_values")).otherwise(F.col("_rule")))
    counts = {r["_rule"]: r["n"] for r in tagged.groupBy("_rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = tagged.filter("_rule IS NULL").drop("_rule")
    rows_in, rows_out = sum(counts.values()), counts.get(None, 0)
    summary = {"rows_in": rows_in, "rows_out": rows_out, "dropped_total": rows_in - rows_out, "dropped_by_rule": {r: counts.get(r, 0) for r in RULES}}
    if rows_in and not rows_out:
        issues.warn("CLN.OUTPUT.EMPTY", "no row is left")
    parameters = json_safe(asdict(options)) | {"duplicates_subset_effective": subset}
    return trips.after("clean_trips", parameters, summary, issues, data=kept), Report(issues.ok, issues.all, summary, parameters, {"labelled": tagged})
