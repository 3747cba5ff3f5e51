"""Named queries over the adapter views, each with the SQL that states the same result where there is one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsloom.sources import adapters
from opsloom.sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of a Catalog. The oracle may use the adapter views and is completed here."""

    def register(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = adapters.duckdb(oracle)
        return f

    return register


def load() -> None:
    from opsloom.plans import aggregates, filters, graphs, joined, lifecycle, ranked, scalars, stateful, writes  # noqa: F401
