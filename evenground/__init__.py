"""Common-geography analytics as lazy PySpark plans."""
