"""Fleet feature-adoption analytics on PySpark."""
