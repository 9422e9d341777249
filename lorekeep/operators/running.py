"""Running totals over a global order, and the CLEARs that an operation log has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, order: str, delta: str, ranges: int = 64) -> DataFrame:
    """``df`` with ``total``: the sum of ``delta`` up to each row in a global order, rows of equal place included, in two
    levels. Ranges of the order are summed first (a row each), so no task sees all rows."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = max(1, ((hi or 0) - (lo or 0)) // ranges + 1)
    cut = df.withColumn("_range", F.floor((F.col(order) - F.lit(lo or 0)) / width).cast("int"))
    sums = cut.groupBy("_range").agg(F.sum(delta).alias("_sum"))  # ranges + 1 rows at most
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(delta).over(Window.partitionBy("_range").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    joined = cut.join(F.broadcast(sums.withColumn("_before", before).drop("_sum")), "_range")
    return joined.withColumn("total", F.col("_before") + own).drop("_range", "_before")


def with_era(log: DataFrame, order: str = "lsn") -> DataFrame:
    """``log`` with ``era``: the number of CLEARs up to each row. A log without one, as most are, is not shuffled."""
    cleared = F.col("op") == "CLEAR"
    if log.where(cleared).isEmpty():
        return log.withColumn("era", F.lit(0).cast("long"))
    return running_total(log.withColumn("_clear", F.coalesce(cleared, F.lit(False)).cast("long")), order, "_clear").withColumnRenamed("total", "era").drop("_clear")
