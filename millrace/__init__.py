"""millrace: catalog analytics and corpus preparation on PySpark."""
