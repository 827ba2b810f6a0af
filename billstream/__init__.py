"""Invoice analytics on PySpark DataFrames."""
