"""Compositional panels and exposure surfaces as PySpark DataFrame operators."""

from simplexspark.session import get_session

__all__ = ["get_session"]
