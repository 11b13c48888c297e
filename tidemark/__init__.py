"""Trade-flow analytics and hybrid text search as PySpark DataFrame operators."""
