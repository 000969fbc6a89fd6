"""City-sensor analytics as Spark DataFrame operators."""
