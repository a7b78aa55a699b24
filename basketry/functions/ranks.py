"""Ranks over all rows, or over a few large groups, without a task that gets them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import saved


def placed(df: DataFrame, order: list[Column | str], name: str, by: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """``df`` with the place from 1 of each row in ``order`` within ``by``, as a long; ``total`` names a column for the rows of the group.

    Rows are dealt into ranges of ``by`` and the whole ``order``, which should end in a unique key, so that a
    value shared by many rows is divided too. The ranges are written, as the two passes over them have to
    agree; places within ranges come in parallel, and a running sum gets a row a range and group.
    """
    taken = {c.lower() for c in df.columns}
    part, inner = ("_part", "_inner") if not {"_part", "_inner"} & taken else ("__part", "__inner")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(n, *by, *order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part, *by).agg(F.count(F.lit(1)).alias("_n"))
    every = W.partitionBy(*by)
    ahead = sizes.select(part, *by, (F.sum("_n").over(every.orderBy(part)) - F.col("_n")).alias("_ahead"), F.sum("_n").over(every).alias(total or "_total"))
    inside = dealt.withColumn(inner, F.row_number().over(W.partitionBy(part, *by).orderBy(*order)))
    out = inside.join(ahead, [part, *by]).withColumn(name, F.col(inner) + F.col("_ahead")).drop(part, inner, "_ahead")
    return out if total else out.drop("_total")


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], prefix: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group of ``by`` with exact quantiles ``prefix0, prefix1, ...``, between the two nearest values as ``percentile`` takes them.

    Nulls don't count. No task holds all distinct values.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_id"))
    known = placed(known, ["_v", "_id"], "_i", by, total="_n")
    out = []
    for k, s in enumerate(shares):
        at = F.lit(s) * (F.col("_n") - 1)
        low = F.floor(at)
        weight = F.when(F.col("_i") == low + 1, 1 - (at - low)).when(F.col("_i") == low + 2, at - low).otherwise(0.0)
        out.append(F.sum(F.when(weight > 0, F.col("_v") * weight)).alias(f"{prefix}{k}"))
    return known.groupBy(*by).agg(*out)
