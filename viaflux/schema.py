"""Declared and effective schemas of trips and traces, and their Spark types."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

DTYPES = ("string", "int", "float", "datetime", "categorical", "bool")
#: Constraints that a dtype allows.
CONSTRAINTS = {
    "string": {"nullable", "pattern", "length", "unique", "h3"},
    "int": {"nullable", "range", "unique"},
    "float": {"nullable", "range", "unique"},
    "bool": {"nullable", "unique"},
    "datetime": {"nullable", "datetime", "unique"},
    "categorical": {"nullable", "unique"},
}
#: Constraint keys with the payload keys they know.
PAYLOADS = {"range": {"min", "max"}, "datetime": {"min", "max", "allow_naive"}, "h3": {"require_valid", "resolution", "allow_mixed_resolution"}, "length": {"min", "max"}}
SPARK_TYPES = {"string": T.StringType(), "categorical": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType()}

#: The core fields of trips.
TRIP_CORE = (
    "movement_id", "user_id", "origin_longitude", "origin_latitude", "destination_longitude", "destination_latitude",
    "origin_time_utc", "destination_time_utc", "origin_h3_index", "destination_h3_index", "trip_id", "movement_seq",
)
TRACE_CORE = ("point_id", "user_id", "time_utc", "latitude", "longitude")
OD_COORDINATES = TRIP_CORE[2:6]


@dataclass(frozen=True)
class DomainSpec:
    """Allowed values of a categorical field, whether data may extend them, and aliases of values."""

    values: Sequence[str] = ()
    extendable: bool = True
    aliases: Mapping[str, str] | None = None


@dataclass(frozen=True)
class FieldSpec:
    name: str
    dtype: str
    required: bool = False
    constraints: Mapping[str, Any] | None = None
    domain: DomainSpec | None = None


@dataclass
class TripSchema:
    version: str = "0.1.0"
    fields: dict[str, FieldSpec] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    semantic_rules: dict[str, Any] | None = None

    def get_field(self, name: str) -> FieldSpec:
        return self.fields[name]

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(asdict(self), default=str))

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]):
        fields = {}
        for name, f in (d.get("fields") or {}).items():
            domain = DomainSpec(**f["domain"]) if f.get("domain") else None
            fields[name] = FieldSpec(f.get("name", name), f["dtype"], bool(f.get("required")), f.get("constraints"), domain)
        known = {k: v for k, v in d.items() if k in cls.__dataclass_fields__ and k != "fields"}
        return cls(fields=fields, **known)

    def struct(self) -> T.StructType:
        """Spark's type of the declared fields; domain and constraints travel as column metadata."""
        out = T.StructType()
        for f in self.fields.values():
            meta = {"logical": f.dtype, "constraints": json.dumps(f.constraints or {}, default=str), "domain": json.dumps(list(f.domain.values) if f.domain else None)}
            out = out.add(f.name, SPARK_TYPES.get(f.dtype, T.StringType()), f.name not in self.required, meta)
        return out


@dataclass
class TraceSchema(TripSchema):
    crs: str | None = "EPSG:4326"
    timezone: str | None = None


@dataclass
class EffectiveSchema:
    """What the import made of a schema: dtypes, why they were overridden, domains, and the temporal tier."""

    dtypes: dict[str, str] = field(default_factory=dict)
    overrides: dict[str, dict[str, Any]] = field(default_factory=dict)
    domains: dict[str, dict[str, Any]] = field(default_factory=dict)
    temporal: dict[str, Any] = field(default_factory=dict)
    fields: list[str] = field(default_factory=list)

    def pruned(self, columns: Sequence[str]) -> EffectiveSchema:
        keep = lambda d: {k: v for k, v in d.items() if k in columns}
        return EffectiveSchema(keep(self.dtypes), keep(self.overrides), keep(self.domains), dict(self.temporal), list(columns))


def payload_problem(key: str, payload: Any) -> str | None:
    """Why the payload of a known constraint can't be used, or None."""
    if key in ("nullable", "unique"):
        return None if isinstance(payload, bool) else "a boolean is needed"
    if key == "pattern":
        try:
            re.compile(payload)
        except (re.error, TypeError) as e:
            return str(e)
        return None
    if key in PAYLOADS:
        if key == "h3" and isinstance(payload, bool):
            return None
        if not isinstance(payload, Mapping):
            return "a mapping is needed"
        unknown = set(payload) - PAYLOADS[key]
        if unknown or not payload:
            return f"unknown keys {sorted(unknown)}" if unknown else "it is empty"
        if key in ("range", "length") and None not in (payload.get("min"), payload.get("max")) and payload["min"] > payload["max"]:
            return "min is above max"
        return None
    return "it is unknown"


def lint(schema: TripSchema) -> list[tuple[str, str, str | None, bool]]:
    """(code, message, field, fatal) of what is wrong with a schema's declaration."""
    out: list[tuple[str, str, str | None, bool]] = []
    if not schema.version or not isinstance(schema.version, str):
        out.append(("SCHEMA.VERSION_MISSING", "the schema has no version", None, True))
    if not schema.fields:
        out.append(("SCHEMA.FIELDS_EMPTY", "the schema has no fields", None, True))
    if not schema.required:
        out.append(("SCHEMA.REQUIRED_EMPTY", "the schema requires no field", None, True))
    for name in schema.required:
        if name not in schema.fields:
            out.append(("SCHEMA.REQUIRED_UNKNOWN", f"required field {name!r} isn't declared", name, True))
    for name, f in schema.fields.items():
        if f.dtype not in DTYPES:
            out.append(("SCHEMA.DTYPE_UNKNOWN", f"dtype {f.dtype!r} is read as string", name, False))
        if f.dtype == "categorical" and f.domain is None:
            out.append(("SCHEMA.DOMAIN_MISSING", "a categorical field has no domain", name, False))
        for key, payload in (f.constraints or {}).items():
            if key not in CONSTRAINTS.get(f.dtype, CONSTRAINTS["string"]):
                out.append(("SCHEMA.CONSTRAINT_NOT_ALLOWED", f"constraint {key!r} isn't for dtype {f.dtype}", name, False))
            elif problem := payload_problem(key, payload):
                out.append(("SCHEMA.CONSTRAINT_INVALID", f"constraint {key!r}: {problem}", name, False))
    return out


def tier_of(columns: Sequence[str]) -> str:
    """tier_1 with both UTC times, tier_2 with both local HH:MM, else tier_3; from columns alone, so without a job."""
    if {"origin_time_utc", "destination_time_utc"} <= set(columns):
        return "tier_1"
    if {"origin_time_local_hhmm", "destination_time_local_hhmm"} <= set(columns):
        return "tier_2"
    return "tier_3"
