"""Vector similarity analytics on Spark DataFrames."""
