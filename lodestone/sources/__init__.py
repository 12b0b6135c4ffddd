"""Files, repositories and result files as DataFrames."""
