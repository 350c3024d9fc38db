"""Set-at-a-time logistics risk analytics on Spark DataFrames."""
