"""Panel-factor research on Spark DataFrames."""
