"""The parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table <folder>/<name>.parquet, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_list(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The values of a small reference table's column; an error if the table isn't small."""
    rows = df.select(column).where(f"{column} is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values; it isn't a small reference table")
    return sorted(r[0] for r in rows)
