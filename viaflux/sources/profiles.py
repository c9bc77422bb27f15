"""Source profiles: defaults of an import and a preprocessing step for one kind of source."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..datasets import TripDataset
from ..issues import ImportFailed, Report
from ..operators.importing import ImportOptions, import_trips_from_dataframe
from ..schema import TripSchema


@dataclass(frozen=True)
class SourceProfile:
    name: str
    description: str = ""
    default_field_correspondence: Mapping[str, str] = field(default_factory=dict)
    default_value_correspondence: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    default_options: ImportOptions | None = None
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    schema_override: TripSchema | None = None


def merged(base: Mapping[str, Any], override: Mapping[str, Any] | None) -> dict[str, Any]:
    """Entries of `override` replace those of `base`."""
    return {**base, **(override or {})}


def import_trips_from_profile(
    df: DataFrame,
    profile: SourceProfile,
    schema: TripSchema | None = None,
    *,
    options: ImportOptions | None = None,
    field_correspondence: Mapping[str, str] | None = None,
    value_correspondence: Mapping[str, Mapping[str, str]] | None = None,
    provenance: Mapping[str, Any] | None = None,
    h3_resolution: int = 8,
) -> tuple[TripDataset, Report]:
    """The profile's step and defaults, then the import; given options replace the profile's as a whole, mappings per field."""
    schema = profile.schema_override or schema
    if schema is None:
        raise ImportFailed("neither the profile nor the caller has a schema")
    if profile.preprocess is not None:
        df = df.transform(profile.preprocess)
        if not isinstance(df, DataFrame):
            raise ImportFailed(f"the preprocessing of {profile.name!r} doesn't return a DataFrame")
    return import_trips_from_dataframe(
        df,
        schema,
        source_name=profile.name,
        options=options or profile.default_options,
        field_correspondence=merged(profile.default_field_correspondence, field_correspondence),
        value_correspondence=merged(profile.default_value_correspondence, value_correspondence),
        provenance=provenance,
        h3_resolution=h3_resolution,
    )
