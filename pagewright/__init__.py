"""pagewright: document analytics on Spark DataFrames."""
