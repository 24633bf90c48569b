"""Running counts and percentiles over the order of a value, without a task that sees all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.operators.tables import saved


def in_ranges(counts: DataFrame, value: str, n: str, by: tuple[str, ...] = (), ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``counts`` dealt into ranges of (by, value), with __range; and a row for each range and group: __sum of ``n``, __before: that of the group's earlier ranges, __all: the group's.

    Spark samples the bounds of the ranges, so rows are saved with their range: all that is summed later sees the same.
    The second table has as many rows as there are ranges and groups together.
    """
    keys = [*by, value]
    dealt = counts.repartitionByRange(*keys) if ranges is None else counts.repartitionByRange(ranges, *keys)
    dealt = saved(dealt.withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range", *by).agg(F.sum(n).alias("__sum"))
    group = Window.partitionBy(*by or [F.lit(0)])
    upto = F.sum("__sum").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt, sums.select("*", (upto - F.col("__sum")).alias("__before"), F.sum("__sum").over(group).alias("__all"))


def inside(by: tuple[str, ...], value: str) -> Window:
    return Window.partitionBy("__range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(counts: DataFrame, value: str, n: str = "n", out: str = "up_to", by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``counts`` (a row for each distinct value of each group ``by``, with ``n``) and ``out``: the sum of n up to and with the value in its group.

    Each range is summed by itself and starts with the sum of the group's ranges before it.
    """
    dealt, sums = in_ranges(counts, value, n, by, ranges)
    joined = dealt.join(F.broadcast(sums.drop("__sum", "__all")), ["__range", *by])
    return joined.withColumn(out, F.sum(n).over(inside(by, value)) + F.col("__before")).select(*counts.columns, out)


def percentiles(df: DataFrame, column: str, at: dict[str, float], by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Exact percentiles of ``column``, between neighbours linear: a row for each group with a column for each of ``at`` (name: share from 0 to 1); one row without groups.

    Values that are null or NaN don't count; without any, percentiles are null, and groups have no row. Only the ranges
    that hold a wanted rank are put in order; all others are counted.
    """
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias("__v")).agg(F.count("*").alias("__n"))
    dealt, sums = in_ranges(counts, "__v", "__n", by, ranges)
    asks = []
    for name, share in at.items():
        place = F.lit(float(share)) * (F.col("__all") - 1)
        low = F.floor(place)
        asks += [F.struct(F.lit(name).alias("name"), low.alias("rank"), (low + 1 - place).alias("weight")), F.struct(F.lit(name).alias("name"), (low + 1).alias("rank"), (place - low).alias("weight"))]
    asked = sums.select("__range", *by, "__before", "__sum", F.explode(F.array(*asks)).alias("__ask")).where("__ask.weight > 0 and __ask.rank >= __before and __ask.rank < __before + __sum")
    asked = F.broadcast(asked.select("__range", *by, "__before", "__ask.*"))
    ordered = dealt.join(asked.select("__range", *by).distinct(), ["__range", *by], "left_semi").withColumn("__upto", F.sum("__n").over(inside(by, "__v")))
    found = ordered.join(asked, ["__range", *by]).where("rank - __before < __upto and rank - __before >= __upto - __n")
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == name, F.col("weight") * F.col("__v"))).alias(name) for name in at])
