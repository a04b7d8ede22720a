"""Query text to DataFrames."""
