"""corpuslens: corpus search and entity graphs as PySpark DataFrame operators."""
