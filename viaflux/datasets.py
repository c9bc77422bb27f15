"""Datasets: immutable wrappers of lazy DataFrames with driver-side metadata.

Operations return new datasets; they never change the metadata of their input.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .issues import Issues
from .schema import EffectiveSchema, TraceSchema, TripSchema, tier_of


def new_id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def json_safe(value: Any) -> Any:
    return json.loads(json.dumps(value, default=str))


class _WithEvents:
    metadata: dict[str, Any]

    def after(self, op: str, parameters: dict, summary: dict, issues: Issues, **changes: Any):
        """A copy with changes and an event at the end of its log."""
        metadata = copy.deepcopy({**self.metadata, **changes.pop("metadata", {})})
        event = {"op": op, "ts_utc": dt.datetime.now(dt.UTC).isoformat(), "parameters": json_safe(parameters), "summary": json_safe(summary), "issues_summary": issues.summary()}
        metadata["events"] = [*metadata.get("events", []), event]
        return replace(self, metadata=metadata, **changes)

    @property
    def is_validated(self) -> bool:
        return bool(self.metadata.get("is_validated"))


@dataclass(frozen=True)
class TripDataset(_WithEvents):
    data: DataFrame
    schema: TripSchema
    provenance: dict[str, Any] = field(default_factory=dict)
    field_correspondence: dict[str, str] = field(default_factory=dict)
    value_correspondence: dict[str, dict[str, str]] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    effective: EffectiveSchema = field(default_factory=EffectiveSchema)

    @property
    def schema_version(self) -> str:
        return self.schema.version

    @property
    def tier(self) -> str:
        """The temporal tier: metadata first, else what the columns show."""
        return (self.metadata.get("temporal") or {}).get("tier") or self.effective.temporal.get("tier") or tier_of(self.data.columns)


@dataclass(frozen=True)
class TraceDataset(_WithEvents):
    data: DataFrame
    schema: TraceSchema
    provenance: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class FlowDataset(_WithEvents):
    flows: DataFrame
    flow_to_trips: DataFrame | None = None
    aggregation_spec: dict[str, Any] = field(default_factory=dict)
    #: The trips that the flows were built from: a lazy plan, never persisted.
    source_trips: TripDataset | None = None
    provenance: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
