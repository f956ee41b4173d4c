"""Session helpers: the shared folder, written tables and partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import shared_dir, ship, written

__all__ = ["crc32_mod", "shared_dir", "ship", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column: str, modulus: int):
    """crc32 of the decimal text of a column, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus

