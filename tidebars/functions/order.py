"""Positions, ranks and quantiles in one order over a whole table, without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def running_total(rows: DataFrame, order: str, value: str, out: str, ranges: int = 64) -> DataFrame:
    """out: the sum of value over all rows before this one in order (distinct numeric values of `order`).

    Rows fall into ranges between approximate quantiles, which are one row; a range sums its own rows, and the sums
    of the ranges before it, one short row each, are added. Bounds decide the ranges, so it doesn't matter if a
    lost task is run again.
    """
    qs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = rows.agg(F.percentile_approx(order, qs, F.lit(10 * ranges)).alias("_bounds"))
    dealt = rows.join(F.broadcast(bounds)).withColumn("_part", F.size(F.filter("_bounds", lambda b: b <= c(order)))).drop("_bounds")
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    dealt = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return dealt.join(before, "_part").withColumn(out, c("_inside") + c("_before")).drop("_part", "_inside", "_before")


def global_rank(rows: DataFrame, x: str, out: str) -> DataFrame:
    """out: the average rank of x over the whole table; NULL has none. Equal values are counted first, so ranks are
    worked out on distinct values and joined back."""
    counts = rows.where(c(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_n"))
    ranks = running_total(counts, x, "_n", "_below").select(x, (c("_below") + (c("_n") + 1) / 2).alias(out))
    return rows.join(ranks, x, "left")


def exact_quantiles(rows: DataFrame, x: str, qs: list[float]) -> DataFrame:
    """q, value: linear quantiles of x over the whole table, from running counts of its distinct values."""
    known = rows.where(c(x).isNotNull())
    counts = known.groupBy(c(x).alias("_x")).agg(F.count("*").alias("_n"))
    places = running_total(counts, "_x", "_n", "_below")
    total = counts.agg(F.sum("_n").alias("_total"))
    wanted = total.select(F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "_total").withColumn("_at", c("q") * (c("_total") - 1))
    # a few rows: the quantiles asked for
    wanted = wanted.withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")})
    inside = lambda p: (c(p) >= c("_below")) & (c(p) < c("_below") + c("_n"))
    hit = places.join(F.broadcast(wanted), inside("_lo") | inside("_hi"))
    pick = lambda p: F.max(F.when(inside(p), c("_x")))
    out = hit.groupBy("q", "_at", "_lo").agg(pick("_lo").alias("_a"), pick("_hi").alias("_b"))
    return out.select("q", (c("_a") + (c("_at") - c("_lo")) * (c("_b") - c("_a"))).alias("value"))


def edges_of(rows: DataFrame, x: str, qs: list[float], name: str = "edges") -> DataFrame:
    """One row, an array of the exact quantiles of x in the order of qs; an empty array where x has no value."""
    found = F.array_sort(F.collect_list(F.struct("q", "value")))
    return exact_quantiles(rows, x, qs).agg(F.transform(found, lambda t: t["value"]).alias(name))
