"""Table profiling, preprocessing, auditing and synthesis as functions from DataFrames to DataFrames."""
