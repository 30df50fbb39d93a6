"""All named queries. Importing the modules registers them."""

from tallyspark.catalog import (  # noqa: F401
    aggregates,
    commission,
    facts,
    json,
    procedures,
    relational,
    sales,
    scalars,
    windows,
)
from tallyspark.catalog.registry import callables, checks

__all__ = ["callables", "checks"]
