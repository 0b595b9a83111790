"""All named queries: importing this module registers them."""

from . import assembly_queries, file_queries, hit_queries, interval_queries, mapping_queries, scalar_queries, sequence_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
