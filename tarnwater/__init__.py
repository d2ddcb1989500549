"""Surface-water analytics over long observation tables, on Spark DataFrames."""
