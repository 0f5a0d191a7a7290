"""adinsight: paid-search analytics as plain PySpark DataFrame operators."""

from adinsight.config import ClientConfig

__all__ = ["ClientConfig"]
