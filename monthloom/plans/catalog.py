"""All registered queries of the panel."""

from . import features, ingest, matching, panel, scalars, survival, tables  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
