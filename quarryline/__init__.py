"""Self-service lakehouse analytics as PySpark DataFrame functions."""
