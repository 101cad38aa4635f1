"""Evidence ranking and relationship analytics as PySpark DataFrame operators."""
