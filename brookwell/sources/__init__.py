"""Where rows come from: Python rows, columns, DataFrames, CSV files, Parquet and JSON."""
