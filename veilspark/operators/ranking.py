"""Ranks inside groups of any size.

``row_number`` over a window keeps one group in one task.  Here rows are
range-partitioned by (group, order), so a group that holds half of all rows is
cut by its order over many tasks; each task numbers its own rows, and what
stood before them in earlier tasks - one row per (group, task) that shares its
group with another task - is added by a join.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def with_rank(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str = "rank") -> DataFrame:
    """``df`` plus the place (from 1) of each row among the rows of its group, ordered
    by ``order_cols`` (which should tell a group's rows apart).  Null keys are a group."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/rank-{uuid.uuid4().hex}"
    keys = [*group_cols, *order_cols]
    # written once: the task's number and what it holds must not change on a retry
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__task", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    here = Window.partitionBy("__task", *group_cols).orderBy(*order_cols)
    rows = rows.withColumn("__here", F.row_number().over(here))
    per_task = rows.groupBy(*group_cols, "__task").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group_cols).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__g{i}" for i, c in enumerate(group_cols)}
    offset = per_task.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0") \
        .select(*[F.col(c).alias(n) for c, n in names.items()], F.col("__task").alias("__t"), "__before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], F.col("__task") == F.col("__t"))
    out = rows.join(offset, same, "left").withColumn(out_col, F.col("__here") + F.coalesce("__before", F.lit(0)))
    return out.drop("__here", "__task", "__t", "__before", *names.values())
