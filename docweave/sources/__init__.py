"""Collections of documents as DataFrames."""

from .catalog import PATH, Catalog
from .layout import Index, IndexMatch, Indexes

__all__ = ["PATH", "Catalog", "Index", "IndexMatch", "Indexes"]
