"""pagemill: document and page processing on PySpark DataFrames."""
