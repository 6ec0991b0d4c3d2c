"""A query engine for collections of documents on Spark."""

from .functions import add, apply, concatenate, divide, lowercase, multiply, subtract, uppercase
from .model import (
    Aggregate,
    Projection,
    and_,
    array_contains,
    array_contains_any,
    collection,
    collection_group,
    compare,
    constant,
    eq,
    field,
    gt,
    gte,
    in_list,
    like,
    literal,
    lt,
    lte,
    ne,
    not_,
    not_in_list,
    or_,
    param,
    projection,
)
from .session import Prepared, Session, run_query
from .sources import Catalog, Index, Indexes

__all__ = [
    "Aggregate", "Catalog", "Index", "Indexes", "Prepared", "Projection", "Session", "add", "and_", "apply", "array_contains",
    "array_contains_any", "collection", "collection_group", "compare", "concatenate", "constant", "divide", "eq", "field", "gt",
    "gte", "in_list", "like", "literal", "lowercase", "lt", "lte", "multiply", "ne", "not_", "not_in_list", "or_", "param",
    "projection", "run_query", "subtract", "uppercase",
]
