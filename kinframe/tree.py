"""The bundle of record tables that every operator takes."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Tree:
    """One DataFrame per record type; absent types are None. ``handle`` is the key of each."""

    person: DataFrame | None = None
    family: DataFrame | None = None
    event: DataFrame | None = None
    place: DataFrame | None = None
    source: DataFrame | None = None
    citation: DataFrame | None = None
    repository: DataFrame | None = None
    media: DataFrame | None = None
    note: DataFrame | None = None
    tag: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def with_tables(self, **tables: DataFrame) -> Tree:
        return replace(self, **tables)

    def write(self, path: str) -> None:
        """Each table to a Parquet folder of its own under ``path``, which must be new."""
        for name, df in self.tables().items():
            df.write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str, types: tuple[str, ...]) -> Tree:
        return Tree(**{t: spark.read.parquet(f"{path}/{t}") for t in types})
