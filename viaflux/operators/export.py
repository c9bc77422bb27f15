"""Export of flows as the CSV layout of flow maps: flows.csv, locations.csv and metadata.json."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import FlowDataset, json_safe
from ..functions import coerce, h3bits, h3proj
from ..issues import ExportFailed, Issues, Report
from ..sources import files

RESERVED = ("origin", "dest", "count", "id", "name", "lat", "lon")


@dataclass(frozen=True)
class ExportFlowsOptions:
    format: str = "flowmap_blue"
    mode: str = "error_if_exists"
    folder_name: str | None = None
    extra_flow_fields: Sequence[str] | None = None


@dataclass(frozen=True)
class ExportResult:
    export_dir: str
    artifacts: dict[str, str]


def flow_rows(flows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """origin, dest, count and extra fields."""
    return flows.select(F.col("origin_h3_index").alias("origin"), F.col("destination_h3_index").alias("dest"), F.col("flow_value").alias("count"), *[F.col(f"`{c}`") for c in extra])


def locations(flows: DataFrame) -> DataFrame:
    """id, name, lat and lon of the distinct cells; centres are computed once for each."""
    cells = flows.select(F.col("origin_h3_index").alias("id")).union(flows.select("destination_h3_index")).distinct()
    at = cells.withColumn("c", h3proj.centre_of(F.col("id")))
    return at.select("id", F.col("id").alias("name"), F.col("c.latitude").alias("lat"), F.col("c.longitude").alias("lon"))


def export_flows(flows: FlowDataset, output_root: str, *, options: ExportFlowsOptions | None = None) -> tuple[ExportResult, Report]:
    """Writes the layout below `output_root` by way of a staging folder; the target is replaced only when that is complete."""
    o = options or ExportFlowsOptions()
    issues = Issues(ExportFailed)
    df = flows.flows
    spark = df.sparkSession
    if o.format != "flowmap_blue":
        issues.fatal("EXP.CONFIG.FORMAT", f"format {o.format!r} is unknown")
    if o.mode not in ("error_if_exists", "overwrite"):
        issues.fatal("EXP.CONFIG.MODE", f"mode {o.mode!r} is unknown")
    missing = [c for c in ("origin_h3_index", "destination_h3_index", "flow_value") if c not in df.columns]
    if missing:
        issues.fatal("EXP.INPUT.COLUMNS_MISSING", f"columns are missing: {missing}")
    extra = list(o.extra_flow_fields or ())
    for c in extra:
        if c not in df.columns:
            issues.fatal("EXP.EXTRA.MISSING", f"there is no column {c!r}", field=c)
        if c in RESERVED:
            issues.fatal("EXP.EXTRA.RESERVED", f"{c!r} is a reserved name", field=c)
        if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            issues.fatal("EXP.EXTRA.NOT_CSV", f"{c!r} can't be written as CSV", field=c)
    od_null = F.col("origin_h3_index").isNull() | F.col("destination_h3_index").isNull()
    bad_value = coerce.number(F.col("flow_value"), df.schema["flow_value"].dataType).isNull()
    bad_cell = ~od_null & ~(h3bits.valid(F.col("origin_h3_index")) & h3bits.valid(F.col("destination_h3_index")))
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(od_null).alias("null"), F.count_if(bad_value).alias("value"), F.count_if(bad_cell).alias("cell")).first()
    for key, code, what in (("null", "EXP.PREFLIGHT.NULL_OD", "flows lack a cell"), ("value", "EXP.PREFLIGHT.VALUE", "values aren't numbers"), ("cell", "EXP.PREFLIGHT.CELL", "cells are invalid")):
        if n[key]:
            issues.fatal(code, f"{n[key]} {what}", row_count=n[key])
    if not n["n"]:
        issues.warn("EXP.INPUT.EMPTY", "there are no flows")
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", o.folder_name).strip("._") if o.folder_name else ""
    name = name or f"flows_{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S}"
    target = f"{output_root.rstrip('/')}/{name}"
    fs = files.FileSystem(spark, target)
    if o.mode == "error_if_exists" and fs.exists(target):
        issues.fatal("EXP.TARGET.EXISTS", f"{target} exists")
    staging = files.staging_of(target)
    files.write_single_csv(fs, flow_rows(df, extra).orderBy("origin", "dest"), f"{staging}/flows.csv")
    files.write_single_csv(fs, locations(df).orderBy("id"), f"{staging}/locations.csv")
    summary = {"flows": n["n"]}
    sidecar = {"format": o.format, "options": json_safe(asdict(o)), "aggregation_spec": flows.aggregation_spec, "provenance": flows.provenance, "metadata": flows.metadata, "issues": issues.summary()}
    fs.write_text(f"{staging}/metadata.json", files.dumps(sidecar))
    fs.swap(staging, target)
    result = ExportResult(target, {k: f"{target}/{k}" for k in ("flows.csv", "locations.csv", "metadata.json")})
    return result, Report(issues.ok, issues.all, summary, json_safe(asdict(o)))
