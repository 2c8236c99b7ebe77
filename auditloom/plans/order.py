"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Rows of one partition are numbered below this bit.
PARTITION_BIT = 33


def placed(rows: DataFrame, *order: str | Column, within: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """rows with their place (from 0, long) in an order, among those that agree in the columns `within` (which hold no null).

    Rows are dealt by ranges of `within` and the order, sorted inside their partition and written with their number there.
    What comes before a partition follows from counts, of which there is one for each partition and value of `within` in
    it; so neither a value of `within` nor the table as a whole meets in a task. The order should be total but for rows
    that are equal in all columns: rows that tie get their places in any order, and many that tie meet in one partition.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "placed")
    ranged = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    numbered = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", PARTITION_BIT))
    numbered.write.parquet(f"{path}/rows")
    numbered = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    shift = counts.select(*within, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    shift.write.parquet(f"{path}/shift")
    shift = spark.read.schema(shift.schema).parquet(f"{path}/shift")
    return numbered.join(shift, [*within, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).select(*rows.columns, name)
