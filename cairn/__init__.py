"""Content-curation analytics on PySpark DataFrames."""
