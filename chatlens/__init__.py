"""Chat-message analytics as lazy Spark DataFrames."""
