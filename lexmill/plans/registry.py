"""How a plan module registers a query with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        """Decorates a function of a function that reads tables by name; without sql the query has no SQL form."""

        def register(build):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            query.__name__ = build.__name__
            query.__doc__ = build.__doc__
            self.queries[build.__name__] = query
            if sql:
                self.sql[build.__name__] = sql
            return build

        return register
