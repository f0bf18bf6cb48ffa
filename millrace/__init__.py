"""millrace: typed virtual tables, graph navigation, text and vector search and
change-log processing as PySpark DataFrames."""
