"""Review analytics on Spark: every report takes and returns DataFrames."""
