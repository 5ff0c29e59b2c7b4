"""Finding wrong facts in knowledge graphs with Spark DataFrames."""
