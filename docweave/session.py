"""Sessions, prepared queries, and how to run them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .model import Projection
from .plans.normalize import constraints
from .plans.planner import Planner, bind_query, inequality_guard
from .sources import Catalog, Indexes


class Session:
    """A Spark session with a catalog of collections.

    ``semantics`` is "sql" (NULL as in SQL) or "two_valued" (a comparison with NULL
    is false and its negation true). Without ``strict``, unknown fields are NULL.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, indexes: Indexes | None = None, semantics: str = "sql", strict: bool = True):
        if semantics not in ("sql", "two_valued"):
            raise ValueError(f"Unknown semantics {semantics!r}")
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.indexes = indexes or Indexes()
        self.planner = Planner(self.catalog, semantics == "two_valued", strict)

    def prepare(self, query: Projection) -> Prepared:
        return Prepared(self, query)

    def run(self, query: Projection, parameters: dict[str, Any] | None = None) -> DataFrame:
        """The result as a DataFrame; nothing runs until it is read or materialised."""
        return self.prepare(query).bind(parameters)

    def explain(self, query: Projection, parameters: dict[str, Any] | None = None) -> str:
        """The normalised predicate, how scans match declared indexes, and Spark's plan."""
        bound = bind_query(query, {**query.params, **(parameters or {})})
        where = self.planner.where(bound)
        lines = [f"where: {where}"]
        for alias, collection in bound.sources.items():
            own = [(f, op) for f, op in constraints(_only(where, alias))]
            order = next(((".".join(o.by.path), o.direction) for o in bound.order_by if getattr(o.by, "source", None) == alias), None)
            match = self.indexes.match(str(collection.path[-1]), own, order if len(bound.sources) == 1 else None)
            lines.append(f"scan {alias}: index {match.type}, cost {self.indexes.cost(match)}")
        plan = self.planner.plan(query, parameters)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join([*lines, plan])

    def check_limits(self, query: Projection, parameters: dict[str, Any] | None = None) -> None:
        """Raise where a document store would refuse the query; Spark itself has no such limits."""
        bound = bind_query(query, {**query.params, **(parameters or {})})
        inequality_guard(bound, self.planner.where(bound))


def _only(where: Any, alias: str) -> Any:
    from .model import And, aliases
    from .plans.normalize import conjuncts

    return And(tuple(p for p in conjuncts(where) if aliases(p) == {alias}))


class Prepared:
    """A query that can be bound to many sets of parameters."""

    def __init__(self, session: Session, query: Projection):
        self.session, self.query = session, query

    def bind(self, parameters: dict[str, Any] | None = None) -> DataFrame:
        out = self.session.planner.plan(self.query, parameters)
        if self.query.materialize_to:
            out.write.mode("overwrite").parquet(self.query.materialize_to)
            out = self.session.spark.read.parquet(self.query.materialize_to)
        return out


def run_query(query: Projection, session: Session, parameters: dict[str, Any] | None = None) -> DataFrame:
    return session.run(query, parameters)
