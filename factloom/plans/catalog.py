"""The registered queries: a Spark callable per operator and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.views import view
from factloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Bodies of the checks; views are put in front when all of them are known.
ORACLES: dict[str, str] = {}


class Inputs:
    """The views of one data folder, by attribute: ``inputs.v_items``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def keep(self, name: str) -> DataFrame:
        """The view, written once; views on top of it read it too."""
        return view(self.spark, self.sf_dir, name, keep=True)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``, with its check in SQL."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
