"""Analytics on moving-object trajectories with Spark DataFrames."""
