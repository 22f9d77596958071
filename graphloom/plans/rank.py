"""Row numbers over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.session import scratch_table as checkpoint


def row_numbers(df: DataFrame, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Adds 1, 2, ... in the given order, within the groups ``by`` if given; the order must be total for a defined result.

    Rows are range-partitioned by (by, order), numbered within their partition, and shifted by the rows of their group in
    the partitions before; only those counts, one for each partition and group in it, are gathered by group.
    """
    by, sort = by or [], [F.col(c) for c in by or []] + order
    at = df.repartitionByRange(*sort).withColumn("_p", F.spark_partition_id())
    own = W.partitionBy("_p", *by).orderBy(*order)
    # written once: partitions must not be cut anew between the two uses
    at = checkpoint(at.withColumn("_k", F.row_number().over(own)))
    counts = at.groupBy("_p", *by).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", *by, "_s")
    null_safe = at.withColumnsRenamed({c: f"_l_{c}" for c in by}) if by else at
    on = null_safe["_p"] == shift["_p"]
    for c in by:
        on &= null_safe[f"_l_{c}"].eqNullSafe(shift[c])
    out = null_safe.join(shift, on)
    return out.select(*[null_safe[f"_l_{c}"].alias(c) if c in by else null_safe[c] for c in df.columns], (F.col("_k") + F.col("_s")).alias(name))
