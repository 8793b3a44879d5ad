"""Registration of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidegate.catalog.oracle_views import with_views
from tidegate.plans.views import Warehouse


@dataclass(frozen=True)
class Entry:
    """A registered query; ``body`` is None when the semantics do not fit SQL."""

    name: str
    build: Callable[[Warehouse], DataFrame]
    body: str | None
    views: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        return None if self.body is None else with_views(list(self.views), self.body)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Warehouse(spark, sf_dir))


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register ``build`` under ``name``; ``views`` lists the SQL views ``sql`` reads."""

    def register(build: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        if name in ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        ENTRIES[name] = Entry(name, build, sql, tuple(views.split()))
        return build

    return register
