"""Urban-mobility analytics on Spark: trips, traces and origin-destination flows as DataFrames."""
