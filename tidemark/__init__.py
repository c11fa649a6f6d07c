"""Topic analytics over encyclopaedia pageviews, written as PySpark DataFrame jobs."""
