"""statloom: sports-analytics operators as PySpark DataFrame functions."""
