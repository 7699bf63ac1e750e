"""Document analytics on PySpark DataFrames."""
