"""Running sums and places over ordered strata, without a stratum in one task.

Rows are sorted by ranges of (stratum, order), so a stratum is spread over as many
partitions as its size asks for; what each partition adds to a stratum is a small table,
and running sums within a partition start from it. ``order`` should end in a column
that is unique in a stratum: rows equal in all of it share a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import saved


def cumulative(df: DataFrame, stratum: list[str], order: list, sums: dict[str, object], total: bool = False) -> DataFrame:
    """``df`` with a running sum (inclusive) of each expression of ``sums``, by stratum in order; with ``total``, also the strata's whole sums as ``<name>_all``.

    Null strata are one stratum. No rows give none.
    """
    keys = [F.col(c) for c in stratum]
    s = df.select("*", *[F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for n, v in sums.items()])
    s = saved(s.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    each = s.groupBy("_part", *stratum).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])  # a few rows a partition
    by = Window.partitionBy(*stratum)
    before = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_part", *[F.col(c).alias(f"_k_{c}") for c in stratum], *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_s_{n}").over(by).alias(f"{n}_all") for n in sums])
    j = s.join(each, [s["_part"] == each["_part"], *[s[c].eqNullSafe(each[f"_k_{c}"]) for c in stratum]]).drop(each["_part"])
    own = Window.partitionBy("_part", *stratum).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*[F.col(c) for c in df.columns], *[(F.sum(f"_v_{n}").over(own) + F.col(f"_b_{n}")).alias(n) for n in sums], *([F.col(f"{n}_all") for n in sums] if total else []))
