"""Grouped summaries, ranks and daily rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.order import edges_of
from tidebars.functions.windows import corr, safe_div

c = F.col
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Round-trip costs, in ticks, that moves are held against. Fixed values.
COSTS = (0, 1, 2, 3, 4, 5, 10)


def distribution(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Moments, quantiles, dispersion and sign rates of x by keys; population skewness and excess kurtosis.

    Two aggregates: the second needs the median and the 1 % tails of the first, which come back by an equi-join.
    """
    rows = rows.where(c(x).isNotNull())
    first = rows.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.array(*[F.lit(q) for q in QUANTILES])).alias("q"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), F.avg((c(x) > 0).cast("double")).alias("positive_rate"), F.avg((c(x) < 0).cast("double")).alias("negative_rate"),
    )
    first = first.withColumns({f"p{int(q * 100):02d}": c("q")[i] for i, q in enumerate(QUANTILES)}).drop("q")
    second = rows.join(first.select(*keys, "p50", "p01", "p99"), keys).groupBy(*keys).agg(F.median(F.abs(c(x) - c("p50"))).alias("mad"), F.avg(F.when(c(x).between(c("p01"), c("p99")), c(x))).alias("trimmed_mean"))
    return first.join(second, keys).withColumn("iqr", c("p75") - c("p25"))


def symmetry(rows: DataFrame, x: str, groups: list[str]) -> DataFrame:
    """Counts, means, sign rates and the ratio of mean gain to mean loss over all rows and by each group: grouping sets, one pass."""
    sets = [[], *[[c(g)] for g in groups]]
    out = rows.groupingSets(sets, *[c(g) for g in groups]).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((c(x) > 0).cast("double")).alias("up_rate"), F.avg(F.when(c(x) > 0, c(x))).alias("mean_up"), F.avg(F.when(c(x) < 0, -c(x))).alias("mean_down")
    )
    return out.where("n > 0").withColumn("tail_ratio", safe_div(c("mean_up"), c("mean_down")))


def cost_thresholds(rows: DataFrame, ticks: str, keys: list[str]) -> DataFrame:
    """Share of moves beyond each cost: conditional counts in one aggregate, then unpivoted."""
    wide = rows.where(c(ticks).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.abs(ticks) > k).alias(f"c{k}") for k in COSTS])
    long = wide.unpivot([*keys, "n"], [f"c{k}" for k in COSTS], "cost", "beyond")
    return long.withColumns({"cost": F.substring("cost", 2, 9).cast("int"), "share": c("beyond") / c("n")})


def average_rank(x: Column, over: list[str]) -> Column:
    """Average rank of x within the groups; NULL values have no rank and are kept apart."""
    apart = x.isNull()
    w = Window.partitionBy(*over, apart)
    return F.when(~apart, F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*over, apart, x)) - 1) / 2)


def daily_rank_z(rows: DataFrame, x: str, day: str = "trade_date") -> DataFrame:
    """rank and z of x within the day; z with n - 1, NULL where nothing varies."""
    rows = rows.withColumn("rank", average_rank(c(x), [day]))
    w = Window.partitionBy(day)
    return rows.withColumn("z", safe_div(c("rank") - F.avg("rank").over(w), F.stddev_samp("rank").over(w)))


def daily_ic(rows: DataFrame, x: str, y: str, day: str = "trade_date", least: int = 10) -> DataFrame:
    """Mean product of daily rank z-scores, of days with enough pairs; that is (n - 1) / n of the rank correlation."""
    pairs = rows.where(c(x).isNotNull() & c(y).isNotNull())
    pairs = daily_rank_z(daily_rank_z(pairs, x, day).withColumnRenamed("z", "zx").drop("rank"), y, day)
    return pairs.groupBy(day).agg(F.count("*").alias("pairs"), F.avg(c("zx") * c("z")).alias("ic")).where(c("pairs") >= least)


def daily_spearman(rows: DataFrame, x: str, y: str, day: str = "trade_date", least: int = 10) -> DataFrame:
    pairs = rows.where(c(x).isNotNull() & c(y).isNotNull()).withColumns({"rx": average_rank(c(x), [day]), "ry": average_rank(c(y), [day])})
    out = pairs.groupBy(day).agg(F.count("*").alias("pairs"), corr(c("rx"), c("ry")).alias("rho"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return out.where((c("pairs") >= least) & (c("sx") > 0) & (c("sy") > 0)).drop("sx", "sy")


def partial_ic(rows: DataFrame, x: str, y: str, z: str, day: str = "trade_date", least: int = 10) -> DataFrame:
    """Rank correlation of x and y given z, from the three daily correlations."""
    pairs = rows.where(c(x).isNotNull() & c(y).isNotNull() & c(z).isNotNull()).withColumns({f"r{n}": average_rank(c(n), [day]) for n in (x, y, z)})
    out = pairs.groupBy(day).agg(F.count("*").alias("pairs"), corr(c(f"r{x}"), c(f"r{y}")).alias("xy"), corr(c(f"r{x}"), c(f"r{z}")).alias("xz"), corr(c(f"r{y}"), c(f"r{z}")).alias("yz"))
    rest = (1 - c("xz") * c("xz")) * (1 - c("yz") * c("yz"))
    return out.where(c("pairs") >= least).withColumn("partial_ic", F.when(rest > 1e-12, (c("xy") - c("xz") * c("yz")) / F.sqrt(rest)))


def dev_buckets(rows: DataFrame, x: str, n: int = 5) -> DataFrame:
    """bucket: how many distinct interior Development quantiles are at most x; the edges are one row."""
    edges = edges_of(rows.where(c("research_partition") == "Development"), x, [i / n for i in range(1, n)]).select(F.array_distinct("edges").alias("edges"))
    return rows.join(F.broadcast(edges)).withColumn("bucket", F.when(c(x).isNotNull(), F.size(F.filter("edges", lambda e: e <= c(x)))))


def benjamini_hochberg(cells: DataFrame, p: str, family: list[str]) -> DataFrame:
    """q: step-up q-values within each family; NULL p-values stay out."""
    known = cells.where(c(p).isNotNull())
    order = Window.partitionBy(*family).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*family))
    rows = known.withColumn("_raw", c(p) * m / F.row_number().over(order))
    down = Window.partitionBy(*family).orderBy(F.desc(p), F.col("_raw").asc()).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def holm(cells: DataFrame, p: str, family: list[str], ties: list[str]) -> DataFrame:
    """p_holm: step-down adjusted p-values within each family."""
    order = Window.partitionBy(*family).orderBy(p, *ties)
    m = F.count("*").over(Window.partitionBy(*family))
    rows = cells.withColumn("_raw", c(p) * (m - F.row_number().over(order) + 1))
    return rows.withColumn("p_holm", F.least(F.lit(1.0), F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def drawdown(rows: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    """equity and drawdown (peak so far, at least zero, less equity) along each group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", F.sum(x).over(w))
    return rows.withColumn("drawdown", F.greatest(F.lit(0.0), F.max("equity").over(w)) - c("equity"))


def performance(rows: DataFrame, r: str, keys: list[str], order: list[str], day: str) -> DataFrame:
    """Trades, days, win rate, mean, profit factor and worst drawdown of each group."""
    rows = drawdown(rows, r, keys, order)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_distinct(day).alias("days"), F.avg((c(r) > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_r"), F.median(r).alias("median_r"),
        F.sum(F.when(c(r) > 0, c(r)).otherwise(0.0)).alias("won"), F.sum(F.when(c(r) < 0, -c(r)).otherwise(0.0)).alias("lost"), F.max("drawdown").alias("max_drawdown"),
    )
    return out.withColumn("profit_factor", safe_div(c("won"), c("lost"))).drop("won", "lost")


def positive_concentration(daily: DataFrame, x: str, keys: list[str], top: int = 10) -> DataFrame:
    """Share of the positive days' sum that the top days make."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(x), "trade_date"))
    rows = daily.where(c(x) > 0).withColumn("place", rank)
    return rows.groupBy(*keys).agg(F.sum(x).alias("positive"), F.sum(F.when(c("place") <= top, c(x))).alias("top")).withColumn("concentration", safe_div(c("top"), c("positive")))


def order_statistic(rows: DataFrame, x: str, q: float, keys: list[str]) -> DataFrame:
    """The ceil(q n)-th smallest value: no interpolation."""
    w = Window.partitionBy(*keys)
    rows = rows.where(c(x).isNotNull()).withColumns({"place": F.row_number().over(w.orderBy(x)), "n": F.count("*").over(w)})
    return rows.where(c("place") == F.greatest(F.lit(1), F.ceil(F.lit(q) * c("n")))).select(*keys, "n", c(x).alias("value"))


def bucket_summary(rows: DataFrame, x: str, y: str, n: int = 5) -> DataFrame:
    """Means, counts and pooled spread of y by Development bucket of x and partition."""
    return dev_buckets(rows, x, n).groupBy("research_partition", "bucket").agg(F.count(y).alias("n"), F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("sd_y"), F.min(x).alias("x_lo"), F.max(x).alias("x_hi"))


def exact_duplicate_columns(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """name, digest: columns of equal content have equal digests; one aggregate over all columns."""
    wide = rows.agg(*[F.sum(F.xxhash64(*key, F.col(n).cast("string")).cast("decimal(38,0)")).cast("string").alias(n) for n in names])
    return wide.unpivot([], names, "name", "digest")


def year_coverage(rows: DataFrame, day: str) -> DataFrame:
    return rows.groupBy(F.year(day).alias("year")).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count_distinct(day).alias("dates"), F.count("*").alias("rows")).withColumn("status", F.when(c("dates") >= 300, "full").otherwise("partial"))


def auc(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney AUC by rank sums."""
    ranked = rows.where(c(score).isNotNull() & c(label).isNotNull()).withColumn("_rank", average_rank(c(score), keys))
    out = ranked.groupBy(*keys).agg(F.sum(F.when(c(label), c("_rank"))).alias("s"), F.count_if(c(label)).alias("pos"), F.count_if(~c(label)).alias("neg"))
    return out.withColumn("auc", safe_div(c("s") - c("pos") * (c("pos") + 1) / 2, (c("pos") * c("neg")).cast("double"))).drop("s")


def gram(rows: DataFrame, xs: list[str], y: str, keys: list[str]) -> DataFrame:
    """i, j, value of the normal equations of y on xs and a constant: k * k / 2 sums in one aggregate."""
    names = ["one", *xs, y]
    rows = rows.withColumn("one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = rows.groupBy(*keys).agg(*[F.sum(c(a) * c(b)).alias(f"{a}*{b}") for a, b in pairs])
    return wide.unpivot(keys, [f"`{a}*{b}`" for a, b in pairs], "term", "value")
