"""Numbers of rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of one partition of a monotonically increasing id.
SPAN = 1 << 33


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with a column name: 1, 2, ... in the order given, which should be total.

    A range sort, written once so that both passes see the same partitions; the rows before each partition come from their counts.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in rows.groupBy(F.floor(F.col("_at") / SPAN).alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    starts = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return rows.withColumn(name, F.element_at(starts, F.floor(F.col("_at") / SPAN)) + F.col("_at") % SPAN + 1).drop("_at")
