"""Relations as views for ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(relations: dict[str, DataFrame]) -> None:
    for name, df in relations.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, args: list | dict | None = None) -> DataFrame:
    return spark.sql(sql, args=args)
