"""Queries of summaries, ranks and daily statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.windows import log_ratio
from tidebars.operators import aggregates as a
from tidebars.operators import features, labels
from tidebars.plans import sql
from tidebars.plans.label_queries import _path
from tidebars.plans.sql import r, rounded
from tidebars.sources.bars import cross_section, daily_prices, event_bars, table

c = F.col


def _section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_section(spark, sf_dir)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.labelled(features.prepared(event_bars(spark, sf_dir)), 8)
    return rows.where("entry_session IS NOT NULL AND reason = 'available'").select("bar_ts", "trade_date", "entry_session", "research_partition", "return_ticks", "return_atr", "range_atr", F.dayofweek("trade_date").alias("weekday"))


STATS = ("mean", "sd", "min", "max", "p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "skew", "kurt", "positive_rate", "negative_rate", "mad", "trimmed_mean", "iqr")


def baseline_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.distribution(_labels(spark, sf_dir), "return_atr", ["entry_session", "research_partition"])
    return out.select("entry_session", "research_partition", "n", *[rounded(s).alias(s) for s in STATS])


def symmetry_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.symmetry(_labels(spark, sf_dir), "return_atr", ["entry_session", "weekday", "research_partition"])
    return out.select("entry_session", "weekday", "research_partition", "n", *[rounded(s).alias(s) for s in ("mean", "up_rate", "mean_up", "mean_down", "tail_ratio")])


def cost_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.cost_thresholds(_labels(spark, sf_dir), "return_ticks", ["entry_session"]).withColumn("share", rounded("share"))


def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _section(spark, sf_dir).groupBy("research_partition").agg(F.avg("target").alias("mean_target"), F.min("target").alias("min_target"), F.max("target").alias("max_target"), F.avg("feature").alias("mean_feature"))
    return wide.unpivot("research_partition", ["mean_target", "min_target", "max_target", "mean_feature"], "metric", "value").withColumn("value", rounded("value", 4))


def year_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.year_coverage(_section(spark, sf_dir), "trade_date")


def daily_rank_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.daily_rank_z(_section(spark, sf_dir), "feature")
    return out.select("trade_date", "l_orderkey", "l_linenumber", c("rank").cast("double").alias("rank"), rounded("z").alias("z"))


def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.daily_ic(_section(spark, sf_dir), "feature", "target").withColumn("ic", rounded("ic"))


def daily_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.daily_spearman(_section(spark, sf_dir), "feature", "target").withColumn("rho", rounded("rho"))


def partial_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.partial_ic(_section(spark, sf_dir), "feature", "target", "feature_b").select("trade_date", "pairs", rounded("partial_ic").alias("partial_ic"))


def dev_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.bucket_summary(_section(spark, sf_dir), "feature_b", "target")
    return out.select("research_partition", c("bucket").cast("int").alias("bucket"), "n", rounded("mean_y", 4).alias("mean_y"), rounded("sd_y", 4).alias("sd_y"), rounded("x_lo").alias("x_lo"), rounded("x_hi").alias("x_hi"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month, flag, t of the mean daily move, and a p-value by the tail 1 / (1 + t * t)."""
    days = daily_prices(spark, sf_dir).withColumn("month", F.date_format("trade_date", "yyyy-MM")).withColumn("move", log_ratio(c("close"), c("open")))
    cells = days.groupBy("l_returnflag", "month").agg(F.count("*").alias("n"), F.avg("move").alias("m"), F.stddev_samp("move").alias("s"))
    t = c("m") / c("s") * F.sqrt("n")
    return cells.where("n >= 5 AND s > 0").withColumn("p", F.round(1 / (1 + t * t), 9))


def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.benjamini_hochberg(_monthly(spark, sf_dir), "p", ["l_returnflag"])
    return out.select("l_returnflag", "month", rounded("p").alias("p"), rounded("q").alias("q"))


def holm_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.holm(_monthly(spark, sf_dir), "p", ["l_returnflag"], ["month"])
    return out.select("l_returnflag", "month", rounded("p_holm").alias("p_holm"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long position a day and flag, in units of the day's range."""
    days = daily_prices(spark, sf_dir).where("high > low")
    return days.withColumn("r", F.round((c("close") - c("open")) / (c("high") - c("low")), 9))


def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.performance(_trades(spark, sf_dir), "r", ["l_returnflag"], ["trade_date"], "trade_date")
    return out.select("l_returnflag", "trades", "days", *[rounded(n).alias(n) for n in ("win_rate", "mean_r", "median_r", "max_drawdown", "profit_factor")])


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.drawdown(_trades(spark, sf_dir), "r", ["l_returnflag"], ["trade_date"])
    return out.select("l_returnflag", "trade_date", rounded("equity").alias("equity"), rounded("drawdown").alias("drawdown"))


def daily_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trades(spark, sf_dir).groupBy("trade_date").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("r")).na.fill(0.0)
    return rows.select("trade_date", *[rounded(n).alias(f"r_{n.lower()}") for n in ("A", "N", "R")])


def daily_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir).groupBy("trade_date").agg(rounded(F.sum("r")).alias("net_r"), F.count("*").alias("trades"))


def positive_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.positive_concentration(_trades(spark, sf_dir), "r", ["l_returnflag"])
    return out.select("l_returnflag", rounded("positive").alias("positive"), rounded("top").alias("top"), rounded("concentration").alias("concentration"))


def quantile_noninterp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.order_statistic(_section(spark, sf_dir), "target", 0.9, ["research_partition"])
    return out.select("research_partition", "n", rounded("value", 4).alias("value"))


def duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of lineitem with equal content: groups of names with one digest."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"quantity_again": c("l_quantity"), "discount_again": c("l_discount")})
    names = ["l_quantity", "quantity_again", "l_discount", "discount_again", "l_tax"]
    found = a.exact_duplicate_columns(rows, ["l_orderkey", "l_linenumber"], names)
    return found.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("columns")).drop("digest")


def auc_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _section(spark, sf_dir).withColumn("label", c("target") > 40000)
    return a.auc(rows, "feature", "label", ["research_partition"]).select("research_partition", "pos", "neg", rounded("auc").alias("auc"))


def ridge_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _section(spark, sf_dir).withColumns({"x1": c("feature") / 50, "x2": c("feature_b") * 5, "y": c("target") / 1e5})
    return a.gram(rows, ["x1", "x2"], "y", ["research_partition"]).withColumn("value", rounded("value", 4))


def missing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each partition lack a value of the long-window columns, with coverage."""
    bars = features.prepared(event_bars(spark, sf_dir))
    names = ["atr20", "atr60", "rv30", "bps60", "relvol20"]
    wide = bars.groupBy("research_partition").agg(F.count("*").alias("n"), *[F.count_if(c(n).isNull()).alias(n) for n in names])
    return wide.unpivot(["research_partition", "n"], names, "feature", "missing").withColumn("coverage", rounded(1 - c("missing") / c("n")))


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, median, spread, t and quantiles of moves by declared groups, as grouping sets."""
    rows = _labels(spark, sf_dir)
    groups = ["entry_session", "research_partition", "weekday"]
    sets = [[c("entry_session")], [c("entry_session"), c("research_partition")], [c("weekday")]]
    out = rows.groupingSets(sets, *[c(g) for g in groups]).agg(F.count("*").alias("n"), F.avg("return_atr").alias("mean"), F.median("return_atr").alias("median"), F.stddev_samp("return_atr").alias("sd"), F.count_distinct("trade_date").alias("dates"))
    return out.select(*groups, "n", "dates", rounded("mean").alias("mean"), rounded("median").alias("median"), rounded("sd").alias("sd"), rounded(F.try_divide(c("mean"), c("sd")) * F.sqrt("n")).alias("t"))


def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups ranked by mean move, sample weight and agreement of sign between partitions."""
    rows = _labels(spark, sf_dir)
    cells = rows.groupBy("entry_session", "weekday").pivot("research_partition", ["Development", "Validation"]).agg(F.avg("return_atr").alias("m"), F.count(F.lit(1)).alias("n"))
    agree = F.coalesce(F.signum("Development_m") == F.signum("Validation_m"), F.lit(False))
    cells = cells.where("coalesce(Development_n, 0) > 0").withColumn("score", F.round(F.abs("Development_m") * F.log1p("Development_n") * F.when(agree, 1.0).otherwise(0.5), 6))
    return cells.select("entry_session", "weekday", "score", F.row_number().over(Window.orderBy(F.desc("score"), "entry_session", "weekday")).alias("place"))


QUERIES: dict[str, sql.Query] = {
    f.__name__: f
    for f in (
        baseline_distribution, symmetry_grouping_sets, cost_thresholds, unpivot_metrics, year_coverage, daily_rank_z, daily_ic, daily_spearman, partial_ic, dev_buckets, bh_qvalues, holm_pvalues, perf_summary, drawdown,
        daily_matrix_pivot, daily_net, positive_concentration, quantile_noninterp, duplicate_columns, auc_by_partition, ridge_gram, missing_audit, event_groups, rank_groups,
    )
}

SECTION = """s AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, l_orderkey, l_linenumber, CASE WHEN year(l_shipdate) <= 1999 THEN 'Development' WHEN year(l_shipdate) = 2000 THEN 'Validation' ELSE 'Final' END AS research_partition,
  l_quantity AS feature, l_tax + l_discount AS feature_b, l_extendedprice * (1 - l_discount) AS target FROM lineitem)"""
DAYS = """days AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS trade_date, first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"""
TRADES = f"{DAYS}, t AS (SELECT *, round((close - open) / (high - low), 9) AS r FROM days WHERE high > low)"
_LABELS = f"WITH {sql.features()}, {_path(8)}, x AS (SELECT *, CAST(dayofweek(trade_date) + 1 AS INTEGER) AS weekday FROM l WHERE entry_session IS NOT NULL AND reason = 'available')"


def rank(x: str, over: str) -> str:
    """Average rank of a column without NULLs."""
    return f"rank() OVER (PARTITION BY {over} ORDER BY {x}) + (count(*) OVER (PARTITION BY {over}, {x}) - 1) / 2.0"


_MONTHLY = f"""{DAYS}, mv AS (SELECT l_returnflag, strftime(trade_date, '%Y-%m') AS month, {sql.log_ratio('close', 'open')} AS move FROM days),
cells AS (SELECT l_returnflag, month, count(*) AS n, avg(move) AS m, stddev_samp(move) AS s FROM mv GROUP BY ALL),
p AS (SELECT *, round(1 / (1 + pow(m / s * sqrt(n), 2)), 9) AS p FROM cells WHERE n >= 5 AND s > 0)"""
_Q = {f"p{int(q * 100):02d}": f"quantile_cont(return_atr, {q})" for q in a.QUANTILES}
_COSTS = " UNION ALL ".join(f"SELECT entry_session, count(*) AS n, {k} AS cost, count(*) FILTER (abs(return_ticks) > {k}) AS beyond FROM x GROUP BY entry_session" for k in a.COSTS)
_GRAM = [("one", "one"), ("one", "x1"), ("one", "x2"), ("one", "y"), ("x1", "x1"), ("x1", "x2"), ("x1", "y"), ("x2", "x2"), ("x2", "y"), ("y", "y")]
_MISSING = " UNION ALL ".join(f"SELECT research_partition, count(*) AS n, '{n}' AS feature, count(*) FILTER ({n} IS NULL) AS missing FROM f GROUP BY 1" for n in ("atr20", "atr60", "rv30", "bps60", "relvol20"))

ORACLE_SQL: dict[str, str] = {
    "baseline_distribution": f"""{_LABELS},
a1 AS (SELECT entry_session, research_partition, count(return_atr) AS n, avg(return_atr) AS mean, stddev_samp(return_atr) AS sd, min(return_atr) AS min, max(return_atr) AS max, {', '.join(f'{x} AS {n}' for n, x in _Q.items())},
  avg(CASE WHEN return_atr > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate, avg(CASE WHEN return_atr < 0 THEN 1.0 ELSE 0.0 END) AS negative_rate, kurtosis_pop(return_atr) AS kurt FROM x WHERE return_atr IS NOT NULL GROUP BY ALL),
a2 AS (SELECT entry_session, research_partition, median(abs(return_atr - p50)) AS mad, avg(return_atr) FILTER (return_atr BETWEEN p01 AND p99) AS trimmed_mean,
  avg(pow(return_atr - mean, 3)) / pow(avg(pow(return_atr - mean, 2)), 1.5) AS skew FROM x JOIN a1 USING (entry_session, research_partition) WHERE return_atr IS NOT NULL GROUP BY ALL)
SELECT entry_session, research_partition, n, {', '.join(f'{r(s if s != "iqr" else "p75 - p25")} AS {s}' for s in STATS)} FROM a1 JOIN a2 USING (entry_session, research_partition)""",
    "symmetry_grouping_sets": f"""{_LABELS}, g AS (SELECT entry_session, weekday, research_partition, count(return_atr) AS n, avg(return_atr) AS mean, avg(CASE WHEN return_atr > 0 THEN 1.0 WHEN return_atr <= 0 THEN 0.0 END) AS up_rate,
avg(return_atr) FILTER (return_atr > 0) AS mean_up, avg(-return_atr) FILTER (return_atr < 0) AS mean_down FROM x GROUP BY GROUPING SETS ((), (entry_session), (weekday), (research_partition)) HAVING count(return_atr) > 0)
SELECT entry_session, weekday, research_partition, n, {', '.join(f'{r(s)} AS {s}' for s in ("mean", "up_rate", "mean_up", "mean_down"))}, {r('mean_up / nullif(mean_down, 0)')} AS tail_ratio FROM g""",
    "cost_thresholds": f"{_LABELS}, u AS ({_COSTS}) SELECT entry_session, n, cost, beyond, {r('beyond / n')} AS share FROM u",
    "unpivot_metrics": f"WITH {SECTION}, g AS (SELECT research_partition, avg(target) AS mean_target, min(target) AS min_target, max(target) AS max_target, avg(feature) AS mean_feature FROM s GROUP BY 1) SELECT research_partition, metric, {r('value', 4)} AS value FROM (UNPIVOT g ON mean_target, min_target, max_target, mean_feature INTO NAME metric VALUE value)",
    "year_coverage": f"WITH {SECTION} SELECT CAST(year(trade_date) AS INTEGER) AS year, min(trade_date) AS first_date, max(trade_date) AS last_date, count(DISTINCT trade_date) AS dates, count(*) AS rows, CASE WHEN count(DISTINCT trade_date) >= 300 THEN 'full' ELSE 'partial' END AS status FROM s GROUP BY 1",
    "daily_rank_z": f"WITH {SECTION}, k AS (SELECT *, {rank('feature', 'trade_date')} AS rank FROM s) SELECT trade_date, l_orderkey, l_linenumber, CAST(rank AS DOUBLE) AS rank, {r('(rank - avg(rank) OVER w) / nullif(stddev_samp(rank) OVER w, 0)')} AS z FROM k WINDOW w AS (PARTITION BY trade_date)",
    "daily_ic": f"""WITH {SECTION}, k AS (SELECT trade_date, {rank('feature', 'trade_date')} AS rx, {rank('target', 'trade_date')} AS ry FROM s),
z AS (SELECT trade_date, (rx - avg(rx) OVER w) / nullif(stddev_samp(rx) OVER w, 0) AS zx, (ry - avg(ry) OVER w) / nullif(stddev_samp(ry) OVER w, 0) AS zy FROM k WINDOW w AS (PARTITION BY trade_date))
SELECT trade_date, count(*) AS pairs, {r('avg(zx * zy)')} AS ic FROM z GROUP BY 1 HAVING count(*) >= 10""",
    "daily_spearman": f"WITH {SECTION}, k AS (SELECT trade_date, {rank('feature', 'trade_date')} AS rx, {rank('target', 'trade_date')} AS ry FROM s) SELECT trade_date, count(*) AS pairs, {r('corr(rx, ry)')} AS rho FROM k GROUP BY 1 HAVING count(*) >= 10 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0",
    "partial_ic": f"""WITH {SECTION}, k AS (SELECT trade_date, {rank('feature', 'trade_date')} AS rx, {rank('target', 'trade_date')} AS ry, {rank('feature_b', 'trade_date')} AS rz FROM s),
g AS (SELECT trade_date, count(*) AS pairs, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM k GROUP BY 1 HAVING count(*) >= 10)
SELECT trade_date, pairs, {r('CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-12 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END')} AS partial_ic FROM g""",
    "dev_buckets": f"""WITH {SECTION}, q AS (SELECT list_distinct(quantile_cont(feature_b, [0.2, 0.4, 0.6, 0.8])) AS edges FROM s WHERE research_partition = 'Development'),
b AS (SELECT s.*, CAST(len(list_filter(edges, lambda e: e <= feature_b)) AS INTEGER) AS bucket FROM s, q)
SELECT research_partition, bucket, count(target) AS n, {r('avg(target)', 4)} AS mean_y, {r('stddev_samp(target)', 4)} AS sd_y, {r('min(feature_b)')} AS x_lo, {r('max(feature_b)')} AS x_hi FROM b GROUP BY 1, 2""",
    "bh_qvalues": f"""WITH {_MONTHLY}, w AS (SELECT *, p * count(*) OVER (PARTITION BY l_returnflag) / row_number() OVER (PARTITION BY l_returnflag ORDER BY p) AS raw FROM p)
SELECT l_returnflag, month, {r('p')} AS p, {r('least(1.0, (SELECT min(v.raw) FROM w v WHERE v.l_returnflag = w.l_returnflag AND v.p >= w.p))')} AS q FROM w""",
    "holm_pvalues": f"""WITH {_MONTHLY}, w AS (SELECT *, p * (count(*) OVER (PARTITION BY l_returnflag) - row_number() OVER (PARTITION BY l_returnflag ORDER BY p, month) + 1) AS raw FROM p)
SELECT l_returnflag, month, {r('least(1.0, max(raw) OVER (PARTITION BY l_returnflag ORDER BY p, month))')} AS p_holm FROM w""",
    "perf_summary": f"""WITH {TRADES}, e AS (SELECT *, sum(r) OVER w AS equity FROM t WINDOW w AS (PARTITION BY l_returnflag ORDER BY trade_date)), d AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY l_returnflag ORDER BY trade_date)) - equity AS dd FROM e)
SELECT l_returnflag, count(*) AS trades, count(DISTINCT trade_date) AS days, {r('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {r('avg(r)')} AS mean_r, {r('median(r)')} AS median_r, {r('max(dd)')} AS max_drawdown,
{r('sum(CASE WHEN r > 0 THEN r ELSE 0.0 END) / nullif(sum(CASE WHEN r < 0 THEN -r ELSE 0.0 END), 0)')} AS profit_factor FROM d GROUP BY 1""",
    "drawdown": f"WITH {TRADES}, e AS (SELECT *, sum(r) OVER w AS equity FROM t WINDOW w AS (PARTITION BY l_returnflag ORDER BY trade_date)) SELECT l_returnflag, trade_date, {r('equity')} AS equity, {r('greatest(0.0, max(equity) OVER (PARTITION BY l_returnflag ORDER BY trade_date)) - equity')} AS drawdown FROM e",
    "daily_matrix_pivot": f"WITH {TRADES} SELECT trade_date, " + ", ".join(f"{r(f'''coalesce(sum(r) FILTER (l_returnflag = '{n}'), 0.0)''')} AS r_{n.lower()}" for n in ("A", "N", "R")) + " FROM t GROUP BY 1",
    "daily_net": f"WITH {TRADES} SELECT trade_date, {r('sum(r)')} AS net_r, count(*) AS trades FROM t GROUP BY 1",
    "positive_concentration": f"""WITH {TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY r DESC, trade_date) AS place FROM t WHERE r > 0)
SELECT l_returnflag, {r('sum(r)')} AS positive, {r('sum(r) FILTER (place <= 10)')} AS top, {r('sum(r) FILTER (place <= 10) / sum(r)')} AS concentration FROM k GROUP BY 1""",
    "quantile_noninterp": f"WITH {SECTION}, k AS (SELECT research_partition, target, row_number() OVER (PARTITION BY research_partition ORDER BY target) AS place, count(*) OVER (PARTITION BY research_partition) AS n FROM s) SELECT research_partition, n, {r('target', 4)} AS value FROM k WHERE place = greatest(1, CAST(ceil(0.9 * n) AS BIGINT))",
    "duplicate_columns": "SELECT * FROM (VALUES ('l_quantity,quantity_again', 2::BIGINT), ('discount_again,l_discount', 2::BIGINT), ('l_tax', 1::BIGINT)) t(names, columns)",
    "auc_by_partition": f"""WITH {SECTION}, k AS (SELECT research_partition, target > 40000 AS label, {rank('feature', 'research_partition')} AS rk FROM s)
SELECT research_partition, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg, {r('(sum(rk) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * count(*) FILTER (NOT label))')} AS auc FROM k GROUP BY 1""",
    "ridge_gram": f"WITH {SECTION}, v AS (SELECT research_partition, 1.0::DOUBLE AS one, feature / 50 AS x1, feature_b * 5 AS x2, target / 1e5 AS y FROM s) "
    + " UNION ALL ".join(f"SELECT research_partition, '{p}*{q}' AS term, {r(f'sum({p} * {q})', 4)} AS value FROM v GROUP BY 1" for p, q in _GRAM),
    "missing_audit": f"WITH {sql.features()}, u AS ({_MISSING}) SELECT research_partition, n, feature, missing, {r('1 - missing / n')} AS coverage FROM u",
    "event_groups": f"""{_LABELS}, g AS (SELECT entry_session, research_partition, weekday, count(*) AS n, count(DISTINCT trade_date) AS dates, avg(return_atr) AS mean, median(return_atr) AS median, stddev_samp(return_atr) AS sd FROM x GROUP BY GROUPING SETS ((entry_session), (entry_session, research_partition), (weekday)))
SELECT entry_session, research_partition, weekday, n, dates, {r('mean')} AS mean, {r('median')} AS median, {r('sd')} AS sd, {r('mean / nullif(sd, 0) * sqrt(n)')} AS t FROM g""",
    "rank_groups": f"""{_LABELS}, g AS (SELECT entry_session, weekday, avg(return_atr) FILTER (research_partition = 'Development') AS dm, count(*) FILTER (research_partition = 'Development') AS dn, avg(return_atr) FILTER (research_partition = 'Validation') AS vm FROM x GROUP BY 1, 2),
s AS (SELECT entry_session, weekday, round(abs(dm) * ln(1 + dn) * CASE WHEN coalesce(sign(dm) = sign(vm), false) THEN 1.0 ELSE 0.5 END, 6) AS score FROM g WHERE dn > 0)
SELECT entry_session, weekday, score, CAST(row_number() OVER (ORDER BY score DESC, entry_session, weekday) AS INTEGER) AS place FROM s""",
}
