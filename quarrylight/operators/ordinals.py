"""Consecutive numbers over a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.session import written


def numbered(df: DataFrame, order: list[Column], name: str = "numero", start: int = 1) -> DataFrame:
    """Rows numbered by ``order``: ranges are numbered inside and shifted by the sizes of those before.

    ``order`` should be total.  Sizes are one row a partition.  The ranges are written once: cut in two plans they
    would be merged by the sizes of other columns, or sampled anew, and rows would be lost or misnumbered.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("faixa", F.spark_partition_id()), "faixas")
    inside = ranged.withColumn("na_faixa", F.row_number().over(W.partitionBy("faixa").orderBy(*order)))
    sizes = ranged.groupBy("faixa").agg(F.count("*").alias("n"))
    before = sizes.select("faixa", F.coalesce(F.sum("n").over(W.orderBy("faixa").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("antes"))
    return inside.join(before, "faixa").withColumn(name, F.col("na_faixa") + F.col("antes") + (start - 1)).drop("faixa", "na_faixa", "antes")
