"""Table and stream analytics for traffic cameras on PySpark."""
