"""Building-energy analytics as Spark DataFrame operators."""
