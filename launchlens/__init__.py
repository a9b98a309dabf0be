"""Launch-and-trade analytics as plain PySpark DataFrame functions."""
