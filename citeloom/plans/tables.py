"""The driver's tables, read with only what a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bib_safe(text: Column) -> Column:
    """A text without characters that bibliography files give a meaning to; empty if null. translate goes character by character, so only over texts that hold one."""
    whole = F.coalesce(text, F.lit(""))
    held = F.contains(whole, F.lit("{")) | F.contains(whole, F.lit("}")) | F.contains(whole, F.lit("@")) | F.contains(whole, F.lit('"'))
    return F.when(held, F.translate(whole, '{}@"', "()a'")).otherwise(whole)
