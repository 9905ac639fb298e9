"""Forum text analytics as PySpark DataFrame operators."""
