"""rasterlake: image analytics over Spark DataFrames."""
