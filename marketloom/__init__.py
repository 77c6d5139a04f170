"""marketloom: catalog analytics and multi-criteria ranking as Spark DataFrame jobs."""
