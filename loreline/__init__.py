"""loreline: versioned, text-derived knowledge on PySpark DataFrames."""
