from tallyspark.sources.tables import Tables, load

__all__ = ["Tables", "load"]
