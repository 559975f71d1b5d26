"""Market analytics as Spark jobs: every operator maps DataFrames to DataFrames, for all symbols at once."""
