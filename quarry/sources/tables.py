"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.runtime import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def delivered_once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key; copies of a row differ in their arrival time only, so any one will do."""
    return df.dropDuplicates(list(keys))


def first_delivery(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row for each key, the earliest to arrive; hash-aggregated with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.coalesce(F.col(arrival), F.lit("9999-12-31").cast("timestamp")))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")
