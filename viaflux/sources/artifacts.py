"""Artefacts: a folder with Parquet or Feather data and a JSON sidecar, for trips and for flows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..datasets import FlowDataset, TripDataset, json_safe
from ..issues import Issues, Report, StorageFailed
from ..schema import EffectiveSchema, TripSchema
from . import feather, files

SUFFIX = ".viaflux"
LAYOUT = 1
PARQUET_CODECS = ("snappy", "gzip", "zstd", "brotli", "none", None)
FEATHER_CODECS = ("lz4", "zstd", "uncompressed", None)


@dataclass(frozen=True)
class WriteOptions:
    mode: str = "error_if_exists"
    require_validated: bool = True
    storage_format: str = "parquet"
    parquet_compression: str | None = "snappy"
    feather_compression: str | None = "lz4"
    normalize_artifact_dir: bool = True
    write_flow_to_trips: bool = True


@dataclass(frozen=True)
class ReadOptions:
    schema: TripSchema | None = None
    strict: bool = False
    keep_metadata: bool = True
    read_flow_to_trips: bool = True


WriteTripsOptions = WriteFlowsOptions = WriteOptions
ReadTripsOptions = ReadFlowsOptions = ReadOptions


def artifact_path(path: str, normalise: bool = True) -> str:
    path = path.rstrip("/")
    return path if not normalise or path.endswith(SUFFIX) else path + SUFFIX


def _check(o: WriteOptions, issues: Issues) -> None:
    if o.mode not in ("error_if_exists", "overwrite"):
        issues.fatal("IO.CONFIG.MODE", f"mode {o.mode!r} is unknown")
    if o.storage_format not in ("parquet", "feather"):
        issues.fatal("IO.CONFIG.FORMAT", f"format {o.storage_format!r} is unknown")
    if o.storage_format == "parquet" and o.parquet_compression not in PARQUET_CODECS:
        issues.fatal("IO.CONFIG.COMPRESSION", f"Parquet can't be compressed with {o.parquet_compression!r}")
    if o.storage_format == "feather" and o.feather_compression not in FEATHER_CODECS:
        issues.fatal("IO.CONFIG.COMPRESSION", f"Feather can't be compressed with {o.feather_compression!r}")


def _write(fs: files.FileSystem, df: DataFrame, path: str, o: WriteOptions, categorical: Sequence[str]) -> None:
    if o.storage_format == "parquet":
        df.write.option("compression", o.parquet_compression or "none").parquet(path)
    else:
        feather.write(fs, df, path, o.feather_compression or "uncompressed", categorical)


def _categorical(trips: TripDataset) -> list[str]:
    """Fields that are written with a dictionary: by declaration, by import, or with a domain."""
    names = {n for n, f in trips.schema.fields.items() if f.dtype == "categorical"} | {n for n, t in trips.effective.dtypes.items() if t == "categorical"} | set(trips.effective.domains)
    return sorted(names & set(trips.data.columns))


def write_trips(trips: TripDataset, path: str, *, options: WriteOptions | None = None) -> tuple[str, Report]:
    """Writes data and sidecar into a staging folder and puts that in place."""
    o = options or WriteOptions()
    issues = Issues(StorageFailed)
    _check(o, issues)
    if o.require_validated and not trips.is_validated:
        issues.fatal("IO.VALIDATION.REQUIRED_NOT_VALIDATED", "the trips aren't validated")
    target = artifact_path(path, o.normalize_artifact_dir)
    fs = files.FileSystem(trips.data.sparkSession, target)
    if o.mode == "error_if_exists" and fs.exists(target):
        issues.fatal("IO.TARGET.EXISTS", f"{target} exists")
    staging = files.staging_of(target)
    name = f"trips.{o.storage_format}"
    _write(fs, trips.data, f"{staging}/{name}", o, _categorical(trips))
    sidecar = {
        "dataset_type": "trips", "layout_version": LAYOUT, "storage": {"format": o.storage_format, "options": json_safe(asdict(o))}, "files": {"data": name},
        "schema": trips.schema.to_dict(), "effective": asdict(trips.effective), "categorical": _categorical(trips), "provenance": trips.provenance,
        "field_correspondence": trips.field_correspondence, "value_correspondence": trips.value_correspondence, "metadata": trips.metadata,
    }
    fs.write_text(f"{staging}/trips.metadata.json", files.dumps(sidecar))
    fs.swap(staging, target)
    return target, Report(issues.ok, issues.all, {"path": target, "format": o.storage_format}, json_safe(asdict(o)))


def _sidecar(fs: files.FileSystem, path: str, kind: str, o: ReadOptions, issues: Issues) -> dict[str, Any]:
    name = f"{path}/{kind}.metadata.json"
    if not fs.exists(name):
        issues.fatal("IO.SIDECAR.MISSING", f"{name} is missing")
    try:
        side = json.loads(fs.read_text(name))
    except ValueError:
        (issues.fatal if o.strict else issues.err)("IO.SIDECAR.NOT_JSON", f"{name} isn't JSON")
        side = {}
    if side.get("dataset_type", kind) != kind:
        issues.fatal("IO.SIDECAR.TYPE", f"{name} is of {side['dataset_type']}")
    if side and side.get("layout_version") != LAYOUT:
        issues.fatal("IO.SIDECAR.LAYOUT", f"layout {side.get('layout_version')!r} is unknown")
    return side


def _locate(spark: SparkSession, path: str) -> tuple[str, files.FileSystem]:
    """The given folder, or the same with the suffix."""
    plain = path.rstrip("/")
    fs = files.FileSystem(spark, plain)
    return (plain if fs.is_dir(plain) or not fs.is_dir(plain + SUFFIX) else plain + SUFFIX), fs


def _read(spark: SparkSession, fs: files.FileSystem, path: str, kind: str, side: dict, issues: Issues) -> DataFrame:
    backend = (side.get("storage") or {}).get("format")
    names = [f"{kind}.{b}" for b in ([backend] if backend else ["parquet", "feather"])]
    name = next((n for n in names if fs.exists(f"{path}/{n}")), None)
    if name is None:
        issues.fatal("IO.DATA.MISSING", f"there is none of {names} in {path}")
    return spark.read.parquet(f"{path}/{name}") if name.endswith(".parquet") else feather.read(spark, f"{path}/{name}")


def read_trips(spark: SparkSession, path: str, *, options: ReadOptions | None = None) -> tuple[TripDataset, Report]:
    """Trips of an artefact; never validated. A broken sidecar is an error with `strict`, else schema and metadata are rebuilt as far as possible."""
    o = options or ReadOptions()
    issues = Issues(StorageFailed, o.strict)
    at, fs = _locate(spark, path)
    side = _sidecar(fs, at, "trips", o, issues)
    df = _read(spark, fs, at, "trips", side, issues)
    schema = o.schema
    if schema is None:
        if side.get("schema"):
            schema = TripSchema.from_dict(side["schema"])
        else:
            issues.warn("IO.SCHEMA.MISSING", "there is no schema; an empty one is used")
            schema = TripSchema()
    metadata = dict(side.get("metadata") or {}) if o.keep_metadata else {}
    metadata["is_validated"] = False
    effective = EffectiveSchema(**side["effective"]) if side.get("effective") else EffectiveSchema()
    base = TripDataset(df, schema, side.get("provenance") or {}, side.get("field_correspondence") or {}, side.get("value_correspondence") or {}, metadata, effective)
    summary = {"path": at, "columns": len(df.columns)}
    return base.after("read_trips", {"path": path}, summary, issues), Report(issues.ok, issues.all, summary)


def write_flows(flows: FlowDataset, path: str, *, options: WriteOptions | None = None) -> tuple[str, Report]:
    """Writes flows, the bridge if there is one, and the sidecar."""
    o = options or WriteOptions(require_validated=False)
    issues = Issues(StorageFailed)
    _check(o, issues)
    target = artifact_path(path, o.normalize_artifact_dir)
    fs = files.FileSystem(flows.flows.sparkSession, target)
    if o.mode == "error_if_exists" and fs.exists(target):
        issues.fatal("IO.TARGET.EXISTS", f"{target} exists")
    staging = files.staging_of(target)
    texts = [c for c in flows.aggregation_spec.get("group_by") or [] if c in flows.flows.columns and flows.flows.schema[c].dataType.typeName() == "string"]
    names = {"flows": f"flows.{o.storage_format}"}
    _write(fs, flows.flows, f"{staging}/{names['flows']}", o, texts)
    if o.write_flow_to_trips and flows.flow_to_trips is not None:
        names["flow_to_trips"] = f"flow_to_trips.{o.storage_format}"
        _write(fs, flows.flow_to_trips, f"{staging}/{names['flow_to_trips']}", o, [])
    sidecar = {"dataset_type": "flows", "layout_version": LAYOUT, "storage": {"format": o.storage_format, "options": json_safe(asdict(o))}, "files": names, "categorical": texts, "aggregation_spec": flows.aggregation_spec, "provenance": flows.provenance, "metadata": flows.metadata}
    fs.write_text(f"{staging}/flows.metadata.json", files.dumps(sidecar))
    fs.swap(staging, target)
    return target, Report(issues.ok, issues.all, {"path": target, "tables": names}, json_safe(asdict(o)))


def read_flows(spark: SparkSession, path: str, *, options: ReadOptions | None = None) -> tuple[FlowDataset, Report]:
    """Flows of an artefact, with the bridge if it was written; never validated and without source trips."""
    o = options or ReadOptions()
    issues = Issues(StorageFailed, o.strict)
    at, fs = _locate(spark, path)
    side = _sidecar(fs, at, "flows", o, issues)
    df = _read(spark, fs, at, "flows", side, issues)
    links = None
    if o.read_flow_to_trips and (side.get("files") or {}).get("flow_to_trips"):
        if fs.exists(f"{at}/{side['files']['flow_to_trips']}"):
            links = _read(spark, fs, at, "flow_to_trips", side, issues)
        else:
            (issues.fatal if o.strict else issues.err)("IO.AUX.MISSING", "the bridge is missing")
    metadata = dict(side.get("metadata") or {}) if o.keep_metadata else {}
    metadata["is_validated"] = False
    base = FlowDataset(df, links, side.get("aggregation_spec") or {}, None, side.get("provenance") or {}, metadata)
    summary = {"path": at, "bridge": links is not None}
    return base.after("read_flows", {"path": path}, summary, issues), Report(issues.ok, issues.all, summary)


def discover(spark: SparkSession, root: str) -> list[dict[str, Any]]:
    """Artefacts and flow-map exports directly below a folder, known by their files; only schemas and sidecars are read."""
    fs = files.FileSystem(spark, root)
    out = []
    for name in fs.names(root) if fs.exists(root) else []:
        at = f"{root.rstrip('/')}/{name}"
        if not fs.is_dir(at) or "._staging_" in name or "._old_" in name:
            continue
        inside = set(fs.names(at))
        for kind in ("trips", "flows"):
            if f"{kind}.metadata.json" in inside:
                side = json.loads(fs.read_text(f"{at}/{kind}.metadata.json"))
                data = (side.get("files") or {}).get("data") or (side.get("files") or {}).get("flows")
                out.append({"name": name, "path": at, "type": kind, "format": (side.get("storage") or {}).get("format"), "data": data, "bridge": "flow_to_trips" in (side.get("files") or {})})
        if {"flows.csv", "locations.csv"} <= inside:
            out.append({"name": name, "path": at, "type": "flow_map", "format": "csv", "data": "flows.csv", "bridge": False})
    return out
