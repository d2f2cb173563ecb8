"""Global row numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[Column | str], path: str, name: str = "ord") -> DataFrame:
    """Rows with their place (from 0) in a global order.

    Rows are range-partitioned, sorted and stored at ``path``, which fixes their places within
    partitions; one row a partition then says how many came before. ``order`` has to tell rows apart.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    flat = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    parts = flat.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return flat.join(F.broadcast(parts), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
