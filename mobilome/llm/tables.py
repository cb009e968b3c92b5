"""The tables that the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mobilome.storage import deal_small


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whole; one that is smaller than a split is dealt over all cores."""
    return deal_small(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
