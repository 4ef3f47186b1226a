"""Pipeline specifications, SQL rewriting and compilation to DataFrames."""
