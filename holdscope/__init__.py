"""Portfolio-holdings analytics as PySpark DataFrame operators."""
