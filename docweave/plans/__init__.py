"""From query objects to columns and DataFrames."""
