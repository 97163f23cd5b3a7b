"""Readers and writers of files, always through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, header: bool = True, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """A CSV file, folder or glob with a given schema; unread columns are pruned by the scan."""
    df = spark.read.csv(path, schema=schema, header=header, encoding=encoding, sep=sep, mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: read_csv(spark, path, schemas[name]) for name, path in paths.items()}


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=multi_line)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, compression: str | None = "gzip", encoding: str = "UTF-8", mode: str = "error") -> None:
    df.write.csv(path, header=True, compression=compression, encoding=encoding, mode=mode)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    df.write.parquet(path, partitionBy=partition_by, mode=mode)
