"""Document-text analytics on PySpark: word layers with geometry, their comparison, search, tables and exports."""
