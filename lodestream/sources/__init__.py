"""Files and their formats as DataFrames."""
