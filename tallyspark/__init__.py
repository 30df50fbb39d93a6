"""Sales analytics and data quality as Spark jobs."""
