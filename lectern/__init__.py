"""Document-extraction quality analytics on PySpark."""
