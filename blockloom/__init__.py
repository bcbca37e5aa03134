"""Block-structured data and operation logs as ordinary Spark DataFrames."""
