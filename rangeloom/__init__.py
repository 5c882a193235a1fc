"""Range sort, coded exchange, phase-log and tuning jobs as Spark DataFrames."""
