"""Media-catalogue analytics as PySpark DataFrame jobs."""
