"""Document knowledge-base jobs for Spark: every operator takes and returns DataFrames."""
