"""Trial-pattern analytics as PySpark DataFrame operators."""
