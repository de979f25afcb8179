"""Distribution-shift analytics on Spark DataFrames."""
