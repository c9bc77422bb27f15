"""The public operations and their option types, in one place."""

from .datasets import FlowDataset, TraceDataset, TripDataset
from .functions.prep import project_xy_to_latlon
from .issues import Issue, OperationError, Report
from .operators.cleaning import CleanOptions, clean_trips
from .operators.drilldown import get_trips_from_flows
from .operators.export import ExportFlowsOptions, export_flows
from .operators.filtering import FilterOptions, FlowFilterOptions, TimeFilter, filter_flows, filter_trips
from .operators.fixing import FixCorrespondenceOptions, fix_trips_correspondence
from .operators.flows import FlowBuildOptions, build_flows
from .operators.importing import ImportOptions, ImportTraceOptions, import_traces_from_dataframe, import_trips_from_dataframe
from .operators.inference import InferTripsOptions, infer_trips_from_traces
from .operators.validation import TraceValidationOptions, ValidationOptions, validate_traces, validate_trips
from .schema import DomainSpec, EffectiveSchema, FieldSpec, TraceSchema, TripSchema
from .sources.artifacts import ReadFlowsOptions, ReadTripsOptions, WriteFlowsOptions, WriteTripsOptions, discover, read_flows, read_trips, write_flows, write_trips
from .sources.profiles import SourceProfile, import_trips_from_profile

__all__ = [
    "CleanOptions", "DomainSpec", "EffectiveSchema", "ExportFlowsOptions", "FieldSpec", "FilterOptions", "FixCorrespondenceOptions", "FlowBuildOptions", "FlowDataset", "FlowFilterOptions",
    "ImportOptions", "ImportTraceOptions", "InferTripsOptions", "Issue", "OperationError", "ReadFlowsOptions", "ReadTripsOptions", "Report", "SourceProfile", "TimeFilter",
    "TraceDataset", "TraceSchema", "TraceValidationOptions", "TripDataset", "TripSchema", "ValidationOptions", "WriteFlowsOptions", "WriteTripsOptions",
    "build_flows", "clean_trips", "discover", "export_flows", "filter_flows", "filter_trips", "fix_trips_correspondence", "get_trips_from_flows",
    "import_traces_from_dataframe", "import_trips_from_dataframe", "import_trips_from_profile", "infer_trips_from_traces", "project_xy_to_latlon",
    "read_flows", "read_trips", "validate_traces", "validate_trips", "write_flows", "write_trips",
]
