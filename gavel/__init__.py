"""Market-listing and transaction analytics as PySpark DataFrame operators."""
