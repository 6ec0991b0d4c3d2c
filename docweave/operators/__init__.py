"""Joins, unions and aggregates as DataFrame operations."""

from .aggregates import count_rows, group_rows
from .joins import band_join, contains_join, hinted, overlap_join, spread_join
from .unions import union_all, union_by_path, union_distinct

__all__ = ["band_join", "contains_join", "count_rows", "group_rows", "hinted", "overlap_join", "spread_join", "union_all", "union_by_path", "union_distinct"]
