"""Point-in-time event research and corpus preparation on Spark DataFrames."""
