"""Derived test relations and registered queries."""

from . import queries  # noqa: I001
from . import media

__all__ = ["media", "queries"]
