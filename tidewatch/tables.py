"""Readers of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings raw_content findings stage1 "
    "ioc_sightings entities edges sources labels generic_handles lang_names pack_targets"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the tables as temporary views for SQL."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
