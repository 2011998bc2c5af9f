"""Choice-consistency analytics on Spark DataFrames."""
