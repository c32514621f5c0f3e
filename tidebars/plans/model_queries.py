"""Queries of recursions, policies, inference, models, governance and streams, with SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.order import edges_of, exact_quantiles, global_rank
from tidebars.functions.windows import corr, log_ratio
from tidebars.operators import aggregates, events, features, inference, sequential
from tidebars.plans import sql
from tidebars.plans.aggregate_queries import DAYS, SECTION
from tidebars.plans.sql import r, rounded
from tidebars.sources import governed
from tidebars.sources.bars import cross_section, daily_prices, event_bars, table
from tidebars.streaming import bars as streaming

c = F.col
KEYS = ("product", "bar_ts", "bar_id")


def _nan_to_null(name: str, digits: int = 6):
    return rounded(F.when(~F.isnan(name), c(name)), digits).alias(name)


def ind_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_bars(spark, sf_dir).select(*KEYS, "run_id", "close")
    out = sequential.by_group(rows, ["run_id"], ["bar_id"], {"ema_10": "double"}, lambda p: {"ema_10": sequential.ema_values(p["close"].to_numpy(), 10)})
    return out.select(*KEYS, _nan_to_null("ema_10"))


def ind_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_bars(spark, sf_dir).select(*KEYS, "run_id", "close")
    out = sequential.by_group(rows, ["run_id"], ["bar_id"], {"rsi_14": "double"}, lambda p: {"rsi_14": sequential.rsi_values(p["close"].to_numpy(), 14)})
    return out.select(*KEYS, _nan_to_null("rsi_14"))


def ind_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMA, Bollinger bands, simple ATR, volatility of percent returns and on-balance volume, by plain frames."""
    from tidebars.functions.windows import by_run, lag, rmean, rstd, safe_div

    bars = features.prepared(event_bars(spark, sf_dir)).withColumn("pct", 100 * safe_div(c("dc"), lag(c("close"))))
    bars = bars.withColumn("flow", F.coalesce(F.signum("dc") * c("volume"), F.lit(0.0)))
    obv = F.sum("flow").over(by_run().rowsBetween(Window.unboundedPreceding, 0))
    mean, sd = rmean(c("close"), 20), rstd(c("close"), 20)
    bars = bars.withColumns({"sma_20": mean, "boll_up": mean + 2 * sd, "boll_down": mean - 2 * sd, "atr_14": rmean(c("tr"), 14), "vol_20": rstd(c("pct"), 20), "obv": obv})
    return bars.select(*KEYS, *[rounded(n, 4).alias(n) for n in ("sma_20", "boll_up", "boll_down", "atr_14", "vol_20", "obv")])


def vwap_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling VWAP by segment without the completeness rule, and VWAP since the start of the date."""
    bars = features.prepared(event_bars(spark, sf_dir))
    w = Window.partitionBy("product", "segment").orderBy("bar_id").rowsBetween(-19, 0)
    d = Window.partitionBy("product", "trade_date").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    return bars.select(*KEYS, rounded(F.try_divide(F.sum("pv").over(w), F.sum("volume").over(w))).alias("vwap_20"), rounded(F.try_divide(F.sum("pv").over(d), F.sum("volume").over(d))).alias("vwap_date"))


def garch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional variance along each run with fixed parameters; the recursion restarts with the run."""
    rows = features.prepared(event_bars(spark, sf_dir)).select(*KEYS, "run_id", "ret")
    out = sequential.by_group(rows, ["run_id"], ["bar_id"], {"variance": "double"}, lambda p: {"variance": sequential.variance_path(p["ret"].to_numpy(float), 0.05, 0.1, 0.8, 0.5)})
    return out.select(*KEYS, rounded("variance").alias("variance"))


def garch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GARCH(1,1) of each flag's Development returns: one series to one task."""
    days = daily_prices(spark, sf_dir)
    w = Window.partitionBy("l_returnflag").orderBy("trade_date")
    rows = days.withColumn("ret", log_ratio(c("close"), F.lag("close").over(w))).where("ret IS NOT NULL AND year(trade_date) <= 1999")
    return inference.by_cell(rows, ["l_returnflag"], "ret", "trade_date", {"omega": "double", "alpha": "double", "beta": "double"}, lambda x: sequential.fit_garch(x))


def kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.prepared(event_bars(spark, sf_dir)).where("ret IS NOT NULL").select(*KEYS, "run_id", "ret")
    names = ("prior", "innovation", "gain")
    out = sequential.by_group(rows, ["run_id"], ["bar_id"], dict.fromkeys(names, "double"), lambda p: dict(zip(names, sequential.kalman_level(p["ret"].to_numpy(), 0.01, 1.0), strict=True)))
    return out.select(*KEYS, *[_nan_to_null(n) for n in names])


def ar_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the next ten returns by an AR(2) on the last 40 returns: arrays in, one Arrow batch at a time."""
    import pandas as pd

    def forecast(batches):
        for pdf in batches:
            yield pd.DataFrame({**{k: pdf[k] for k in KEYS}, "ar_sum": [inference.ar_forecast(np.asarray(x, float), 2, 10) for x in pdf["a"]]})

    bars = features.prepared(event_bars(spark, sf_dir)).withColumn("a", features.window_array(c("ret"), 40)).where("a IS NOT NULL").select(*KEYS, "a")
    return bars.mapInPandas(forecast, "product string, bar_ts timestamp_ntz, bar_id int, ar_sum double").select(*KEYS, _nan_to_null("ar_sum"))


def thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars kept at least 45 minutes apart within a date and session, greedily from the first."""
    rows = event_bars(spark, sf_dir).where("session IS NOT NULL").select("bar_id", "trade_date", "session", "minute_of_day")
    out = sequential.by_group(rows, ["trade_date", "session"], ["bar_id"], {"kept": "boolean"}, lambda p: {"kept": sequential.thin(p["minute_of_day"].to_numpy(), 45)})
    return out.where("kept").select("trade_date", "session", "bar_id")


def flex_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequential.simulate_flex(features.prepared(event_bars(spark, sf_dir)), 1.0, 2.0, 0.8, 0.5)
    return out.select("trade_date", "entry_bar", "exit_bar", "exit_reason", rounded("gross_r").alias("gross_r"), rounded("mfe_r").alias("mfe_r"), rounded("mae_r").alias("mae_r"))


POLICIES = (sequential.Policy("static", trailing=False), sequential.Policy("trailing"), sequential.Policy("strict", drawdown=1500.0, daily_loss=700.0))
LAMBDAS = (0.0, 0.01, 0.1, 1.0)
#: Accounts of a rotation.
ACCOUNTS = 8


def _pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_prices(spark, sf_dir).where("high > low").withColumn("r", (c("close") - c("open")) / (c("high") - c("low")))
    return rows.select(c("l_returnflag").alias("account"), "trade_date", F.round(800 * c("r"), 2).alias("pnl"), "r")


def prop_firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.prop_firm(_pnl(spark, sf_dir), list(POLICIES)).withColumn("equity", rounded("equity", 2))


def challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of each flag used one after the other."""
    import pandas as pd

    policy = POLICIES[1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        got = sequential.challenge_rotation(pdf["pnl"].to_numpy(), policy, ACCOUNTS)
        return pd.DataFrame([(pdf["account"].iloc[0], *g) for g in got], columns=["account", "attempt", "days", "outcome", "equity"])

    out = _pnl(spark, sf_dir).groupBy("account").applyInPandas(run, "account string, attempt long, days long, outcome string, equity double")
    return out.withColumn("equity", rounded("equity", 2))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"days": "long", "mean": "double", "lo": "double", "hi": "double", "p": "double"}
    return inference.by_cell(_pnl(spark, sf_dir), ["account"], "r", "trade_date", fields, lambda x: (len(x), float(x.mean()), *inference.bootstrap_mean_ci(x, 7), inference.bootstrap_p(x, 7)))


def boot_stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(x: np.ndarray):
        means = x[inference.stationary_indices(len(x), 2000, 0.2, 11)].mean(axis=1)
        return (len(x), *np.quantile(means, [0.025, 0.975]).tolist())

    return inference.by_cell(_pnl(spark, sf_dir), ["account"], "r", "trade_date", {"days": "long", "lo": "double", "hi": "double"}, run)


def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.by_cell(_pnl(spark, sf_dir), ["account"], "r", "trade_date", {"sharpe": "double", "dsr": "double"}, lambda x: (inference.sharpe(x), inference.deflated_sharpe(x, 20, 0.01)))


def pbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overfitting probability of choosing among the flags, per year: the year's day by flag matrix is a group."""
    import pandas as pd

    wide = _pnl(spark, sf_dir).groupBy("trade_date").pivot("account", ["A", "N", "R"]).agg(F.sum("r")).na.fill(0.0).withColumn("year", F.year("trade_date"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("trade_date")[["A", "N", "R"]].to_numpy()
        return pd.DataFrame([(int(pdf["year"].iloc[0]), len(m), inference.pbo(m, 6) if len(m) >= 12 else None)], columns=["year", "days", "pbo"])

    return wide.groupBy("year").applyInPandas(run, "year int, days long, pbo double")


def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge coefficients by penalty on Development rows, and their error there: one Gram aggregate."""
    rows = cross_section(spark, sf_dir).withColumns({"x1": c("feature") / 50, "x2": c("feature_b") * 5, "y": c("target") / 1e5})
    gram, moment, n = inference.gram_of(rows, ["x1", "x2"], "y", c("research_partition") == "Development")
    fits = [(lam, *inference.ridge_from_gram(gram, moment, n, lam).tolist()) for lam in LAMBDAS]
    return spark.createDataFrame(fits, "lambda double, b0 double, b1 double, b2 double").select("lambda", *[rounded(b).alias(b) for b in ("b0", "b1", "b2")])


def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cross_section(spark, sf_dir).withColumns({"x1": c("feature") / 50, "x2": c("feature_b") * 5, "y": c("target") > 40000})
    beta = inference.logistic_irls(rows, ["x1", "x2"], "y", 0.001)
    return spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "term int, beta double")


def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cross_section(spark, sf_dir).withColumns({"score": c("feature") / 51, "label": c("target") > 40000})
    return inference.isotonic(rows, "score", "label", 50)


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and mean-of-dates log loss of a score by partition."""
    rows = cross_section(spark, sf_dir).withColumns({"p": F.least(F.lit(0.99), F.greatest(F.lit(0.01), c("feature") / 51)), "y": (c("target") > 40000).cast("double")})
    loss = -(c("y") * F.ln("p") + (1 - c("y")) * F.ln(1 - c("p")))
    daily = rows.groupBy("research_partition", "trade_date").agg(F.avg(loss).alias("loss"), F.sum(F.pow(c("p") - c("y"), F.lit(2.0))).alias("sq"), F.count("*").alias("n"))
    return daily.groupBy("research_partition").agg(rounded(F.sum("sq") / F.sum("n")).alias("brier"), rounded(F.avg("loss")).alias("log_loss"))


def robust_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development median and interquartile range, applied everywhere and clipped at ten: means by partition."""
    rows = cross_section(spark, sf_dir)
    q = edges_of(rows.where("research_partition = 'Development'"), "target", [0.25, 0.5, 0.75], "q")
    z = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.try_divide(c("target") - F.get("q", F.lit(1)), F.get("q", F.lit(2)) - F.get("q", F.lit(0)))))
    return rows.join(F.broadcast(q)).withColumn("z", z).groupBy("research_partition").agg(rounded(F.avg("z")).alias("mean_z"), rounded(F.max("z")).alias("max_z"), rounded(F.min("z")).alias("min_z"))


def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation terms of returns within runs, pooled, and the statistic over five lags."""
    from tidebars.functions.windows import by_run

    bars = features.prepared(event_bars(spark, sf_dir)).where("ret IS NOT NULL").select("run_id", "bar_id", "ret")
    mean, v, n = bars.agg(F.avg("ret"), F.var_pop("ret"), F.count("*")).first()
    bars = bars.withColumn("x", c("ret") - mean)
    bars = bars.withColumns({f"x{k}": F.lag("x", k).over(by_run()) for k in range(1, 6)})
    wide = bars.agg(*[F.struct(F.sum(c("x") * c(f"x{k}")).alias("s"), F.count(f"x{k}").alias("pairs")).alias(f"k{k}") for k in range(1, 6)])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), c(f"k{k}.s").alias("s"), c(f"k{k}.pairs").alias("pairs")) for k in range(1, 6)])).alias("x")).select("x.*").where("pairs > 0")
    rho = c("s") / (n * v)
    return rows.select("lag", "pairs", rounded(rho).alias("rho"), rounded(n * (n + 2) * rho * rho / c("pairs")).alias("term"))


def corr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features clustered by rank correlation on percentile ranks: two aggregates, then linkage on k by k."""
    names = ["bps5", "disp5", "clv", "relvol20", "rng", "body", "atr5", "atr20"]
    bars = features.prepared(event_bars(spark, sf_dir)).dropna(subset=names)
    qs = F.array(*[F.lit(i / 100) for i in range(1, 100)])
    edges = bars.agg(*[F.percentile_approx(n, qs, F.lit(1000)).alias(f"e_{n}") for n in names])
    # ranks in hundredths: how many percentile edges a value reaches
    hundredth = lambda n: F.size(F.filter(f"e_{n}", lambda e: e <= c(n))).cast("double").alias(n)
    ranked = bars.join(F.broadcast(edges)).select(*[hundredth(n) for n in names])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    got = ranked.agg(*[corr(c(names[i]), c(names[j])) for i, j in pairs]).first()
    rho = np.eye(len(names))
    for (i, j), v in zip(pairs, got, strict=True):
        rho[i, j] = rho[j, i] = v if v is not None else 0.0
    return spark.createDataFrame(list(zip(names, inference.average_linkage(rho, 0.6), strict=True)), "feature string, cluster int")


def quantiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the line values over the whole table, spread over ranges."""
    return exact_quantiles(cross_section(spark, sf_dir), "target", [0.01, 0.25, 0.5, 0.9, 0.99]).select("q", rounded("value", 4).alias("value"))


def rank_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank of the quantity over the whole table, summed by partition."""
    rows = global_rank(cross_section(spark, sf_dir), "feature", "rank")
    return rows.groupBy("research_partition").agg(F.count("*").alias("n"), rounded(F.sum("rank"), 1).alias("rank_sum"))


def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, correlation and sign accuracy of one column as a prediction of another."""
    rows = cross_section(spark, sf_dir).withColumns({"p": c("feature") / 25 - 1, "y": c("target") / 35000 - 1})
    e = c("p") - c("y")
    return rows.groupBy("research_partition").agg(F.count("*").alias("n"), rounded(F.avg(F.abs(e))).alias("mae"), rounded(F.sqrt(F.avg(e * e))).alias("rmse"), rounded(corr(c("p"), c("y"))).alias("pearson"), rounded(F.avg(F.when(c("y") != 0, (F.signum("p") == F.signum("y")).cast("double")))).alias("sign_accuracy"))


def tick_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = governed.tick_grid_report(event_bars(spark, sf_dir), ["open", "high", "low", "close"], 0.05, 1e-6)
    return out.select("field", rounded("worst").alias("worst"), "off")


def ohlc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir, 60, True)
    return bars.groupBy("product").agg(F.count("*").alias("bars")).join(governed.ohlc_violations(bars).groupBy("product").agg(F.count("*").alias("bad")), "product", "left").na.fill(0)


def guarded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order counts through the guarded reader, up to its date bound."""
    reader = governed.GuardedReader(spark, frozenset({"orders.parquet"}), "1998-12-31")
    rows = reader.read(f"{sf_dir}/orders.parquet", ["o_orderdate", "o_totalprice"], "o_orderdate")
    return rows.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"), rounded(F.sum("o_totalprice"), 2).alias("total"))


def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all zones, chained by product and date, with the first direction of each chain turned round: what the check reports."""
    import pandas as pd

    keys = ["product", "trade_date"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("middle_bar")
        records = [{"zone": z, "direction": d, "bar": int(b)} for z, d, b in zip(pdf["zone_id"], pdf["direction"], pdf["middle_bar"], strict=True)]
        rows = [(i, governed.canonical(x), r["previous_hash"], r["record_hash"]) for i, (x, r) in enumerate(zip(records, governed.chain(records), strict=True))]
        turned = governed.canonical(records[0] | {"direction": "bear" if records[0]["direction"] == "bull" else "bull"})
        rows = [(i, p if i else turned, a, b) for i, p, a, b in rows]
        out = pd.DataFrame(rows, columns=["seq", "payload", "previous_hash", "record_hash"])
        return out.assign(product=pdf["product"].iloc[0], trade_date=pdf["trade_date"].iloc[0])

    zones = events.gap_zones(event_bars(spark, sf_dir)).select(*keys, "zone_id", "direction", "middle_bar")
    log = zones.groupBy(*keys).applyInPandas(run, "product string, trade_date date, seq long, payload string, previous_hash string, record_hash string")
    return log.agg(F.count("*").alias("records")).crossJoin(governed.broken_links(log, keys=keys).agg(F.count("*").alias("broken")))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field by event type."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return rows.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count_if(c("k") > 50).alias("over_50"))


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.run_to_table(streaming.bar_stream(streaming.tick_stream(spark, sf_dir), 60))
    return out.select(c("event_type").alias("product"), c("bar_ts").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event counts, in whatever order the files have them: no watermark, and all files in one batch. An event without a time is a session of its own."""
    out = streaming.run_to_table(streaming.user_sessions(streaming.tick_stream(spark, sf_dir, files=None), "6 hours", late=None).select("user_id", "events"))
    out = out.unionByName(table(spark, sf_dir, "events").where("ts IS NULL").select("user_id", F.lit(1).cast("long").alias("events")))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks older than 120 s when their next tick of the type arrives."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    rows = rows.withColumn("now", F.lead("ts").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))).where("now IS NOT NULL")
    rows = streaming.stale(rows, c("now").cast("timestamp"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("is_stale").alias("stale"))


QUERIES: dict[str, sql.Query] = {
    f.__name__: f
    for f in (
        ind_ema, ind_rsi, ind_frames, vwap_rolling, garch_filter, garch_fit, kalman, ar_forecast, thinning, flex_exits, prop_firm, challenge, bootstrap_ci, boot_stationary, deflated_sharpe, pbo, ridge_fit, logistic_fit, isotonic,
        brier, robust_preprocess, ljung_box, corr_clusters, quantiles_exact, rank_global, prediction_summary, tick_grid, ohlc_check, guarded_scan, hash_chain, json_props, stream_bars, stream_sessions, staleness,
    )
}

K = "product, bar_ts, bar_id"
_B = f"WITH {sql.bars()}"
_F = f"WITH {sql.features()}"
_RB = f"WITH RECURSIVE {sql.bars()}"
_RF = f"WITH RECURSIVE {sql.features()}"

ORACLE_SQL: dict[str, str] = {
    "ind_ema": f"""{_RB}, seed AS (SELECT run_id, avg(close) AS e FROM bars WHERE run_position < 10 GROUP BY 1 HAVING count(*) = 10),
e(run_id, pos, ema) AS (SELECT run_id, 9, e FROM seed UNION ALL SELECT e.run_id, e.pos + 1, e.ema + 2.0 / 11 * (b.close - e.ema) FROM e JOIN bars b ON b.run_id = e.run_id AND b.run_position = e.pos + 1)
SELECT {K}, {r('ema')} AS ema_10 FROM bars b LEFT JOIN e ON e.run_id = b.run_id AND e.pos = b.run_position""",
    "ind_rsi": f"""{_RF}, gl AS (SELECT *, greatest(dc, 0.0) AS g, greatest(-dc, 0.0) AS l FROM f WHERE run_position > 0),
seed AS (SELECT run_id, avg(g) AS g, avg(l) AS l FROM gl WHERE run_position <= 14 GROUP BY 1 HAVING count(*) = 14),
e(run_id, pos, g, l) AS (SELECT run_id, 14, g, l FROM seed UNION ALL SELECT e.run_id, e.pos + 1, (e.g * 13 + x.g) / 14, (e.l * 13 + x.l) / 14 FROM e JOIN gl x ON x.run_id = e.run_id AND x.run_position = e.pos + 1)
SELECT {K}, {r('CASE WHEN e.l > 0 THEN 100 - 100 / (1 + e.g / e.l) WHEN e.g > 0 THEN 100.0 WHEN e.g IS NOT NULL THEN 50.0 END')} AS rsi_14 FROM bars b LEFT JOIN e ON e.run_id = b.run_id AND e.pos = b.run_position""",
    "ind_frames": f"""{_F}, x AS (SELECT *, 100 * dc / lag(close) OVER o AS pct, coalesce(sign(dc) * volume, 0.0) AS flow FROM f {sql.windows()})
SELECT {K}, {r(sql.roll('avg', 'close', 20), 4)} AS sma_20, {r(f"({sql.roll('avg', 'close', 20)}) + 2 * ({sql.roll('stddev_pop', 'close', 20)})", 4)} AS boll_up, {r(f"({sql.roll('avg', 'close', 20)}) - 2 * ({sql.roll('stddev_pop', 'close', 20)})", 4)} AS boll_down,
{r(sql.roll('avg', 'tr', 14), 4)} AS atr_14, {r(sql.roll('stddev_pop', 'pct', 20), 4)} AS vol_20, {r('sum(flow) OVER o', 4)} AS obv FROM x {sql.windows(14, 20)}""",
    "vwap_rolling": f"{_F} SELECT {K}, {r('sum(pv) OVER w / sum(volume) OVER w')} AS vwap_20, {r('sum(pv) OVER d / sum(volume) OVER d')} AS vwap_date FROM f WINDOW w AS (PARTITION BY product, segment ORDER BY bar_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), d AS (PARTITION BY product, trade_date ORDER BY bar_id)",
    "garch_filter": f"""{_RF}, v(run_id, pos, s) AS (SELECT DISTINCT run_id, 0, 0.5::DOUBLE FROM f UNION ALL SELECT v.run_id, v.pos + 1, 0.05 + 0.1 * pow(coalesce(p.ret, 0), 2) + 0.8 * v.s FROM v JOIN f p ON p.run_id = v.run_id AND p.run_position = v.pos JOIN f n ON n.run_id = v.run_id AND n.run_position = v.pos + 1)
SELECT {K}, {r('s')} AS variance FROM f JOIN v ON v.run_id = f.run_id AND v.pos = f.run_position""",
    "thinning": f"""{_RB}, x AS (SELECT trade_date, session, bar_id, minute_of_day AS m FROM bars WHERE session IS NOT NULL),
k AS (SELECT trade_date, session, min(m) AS m FROM x GROUP BY 1, 2 UNION ALL SELECT k.trade_date, k.session, (SELECT min(n.m) FROM x n WHERE n.trade_date = k.trade_date AND n.session = k.session AND n.m >= k.m + 45) FROM k WHERE k.m IS NOT NULL)
SELECT x.trade_date, x.session, x.bar_id FROM k JOIN x USING (trade_date, session, m)""",
    "brier": f"""WITH {SECTION}, x AS (SELECT *, least(0.99, greatest(0.01, feature / 51)) AS p, CASE WHEN target > 40000 THEN 1.0 ELSE 0.0 END AS y FROM s),
d AS (SELECT research_partition, trade_date, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss, sum(pow(p - y, 2)) AS sq, count(*) AS n FROM x GROUP BY 1, 2) SELECT research_partition, {r('sum(sq) / sum(n)')} AS brier, {r('avg(loss)')} AS log_loss FROM d GROUP BY 1""",
    "robust_preprocess": f"""WITH {SECTION}, q AS (SELECT quantile_cont(target, [0.25, 0.5, 0.75]) AS q FROM s WHERE research_partition = 'Development'), z AS (SELECT research_partition, greatest(-10.0, least(10.0, (target - q[2]) / (q[3] - q[1]))) AS z FROM s, q)
SELECT research_partition, {r('avg(z)')} AS mean_z, {r('max(z)')} AS max_z, {r('min(z)')} AS min_z FROM z GROUP BY 1""",
    "ljung_box": f"""{_F}, m AS (SELECT avg(ret) AS m, var_pop(ret) AS v, count(*) AS n FROM f WHERE ret IS NOT NULL), x AS MATERIALIZED (SELECT run_id, bar_id, ret - (SELECT m FROM m) AS x FROM f WHERE ret IS NOT NULL),
g AS (SELECT k AS lag, sum(a.x * b.x) AS s, count(*) AS pairs FROM x a, (VALUES (1), (2), (3), (4), (5)) t(k), x b WHERE b.run_id = a.run_id AND b.bar_id = a.bar_id - k GROUP BY 1)
SELECT lag, pairs, {r('s / (n * v)')} AS rho, {r('n * (n + 2) * pow(s / (n * v), 2) / pairs')} AS term FROM g, m""",
    "quantiles_exact": f"WITH {SECTION}, q AS (SELECT unnest([0.01, 0.25, 0.5, 0.9, 0.99]::DOUBLE[]) AS q, unnest(quantile_cont(target, [0.01, 0.25, 0.5, 0.9, 0.99])) AS value FROM s) SELECT q, {r('value', 4)} AS value FROM q",
    "rank_global": f"WITH {SECTION}, k AS (SELECT research_partition, rank() OVER (ORDER BY feature) + (count(*) OVER (PARTITION BY feature) - 1) / 2.0 AS rk FROM s) SELECT research_partition, count(*) AS n, {r('sum(rk)', 1)} AS rank_sum FROM k GROUP BY 1",
    "prediction_summary": f"""WITH {SECTION}, x AS (SELECT research_partition, feature / 25 - 1 AS p, target / 35000 - 1 AS y FROM s) SELECT research_partition, count(*) AS n, {r('avg(abs(p - y))')} AS mae, {r('sqrt(avg((p - y) * (p - y)))')} AS rmse, {r('corr(p, y)')} AS pearson,
{r('avg(CASE WHEN y <> 0 THEN CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END END)')} AS sign_accuracy FROM x GROUP BY 1""",
    "tick_grid": f"{_B}, u AS (UNPIVOT (SELECT open, high, low, close FROM bars) ON open, high, low, close INTO NAME field VALUE v) SELECT field, {r('max(abs(v / 0.05 - round_even(v / 0.05, 0)))')} AS worst, count(*) FILTER (abs(v / 0.05 - round_even(v / 0.05, 0)) > 1e-6) AS off FROM u GROUP BY 1",
    "ohlc_check": f"WITH {sql.bars(60, True)} SELECT product, count(*) AS bars, count(*) FILTER (least(open, high, low, close) <= 0 OR high < greatest(open, close) OR low > least(open, close)) AS bad FROM bars GROUP BY 1",
    "guarded_scan": f"SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, {r('sum(o_totalprice)', 2)} AS total FROM orders WHERE o_orderdate <= DATE '1998-12-31' GROUP BY 1",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, count(*) FILTER (CAST(json_extract(props, '$.k') AS INTEGER) > 50) AS over_50 FROM events GROUP BY 1",
    "stream_bars": f"WITH {sql.bars(60, True)} SELECT product, bar_ts, open, high, low, close, volume FROM bars",
    "stream_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x),
h AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM h GROUP BY 1""",
    "staleness": "WITH x AS (SELECT event_type, floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)) AS age FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, count(*) AS n, count(*) FILTER (age > 120) AS stale FROM x WHERE age IS NOT NULL GROUP BY 1",
}


_PNL = f"{DAYS}, pn AS (SELECT l_returnflag AS account, trade_date, round(800 * ((close - open) / (high - low)), 2) AS pnl, row_number() OVER (PARTITION BY l_returnflag ORDER BY trade_date) AS i FROM days WHERE high > low)"
_POLICY_ROWS = ", ".join(f"('{p.name}', {p.balance}::DOUBLE, {p.target}::DOUBLE, {p.daily_loss}::DOUBLE, {p.drawdown}::DOUBLE, {str(p.trailing).lower()}, {p.best_day_share}::DOUBLE, {p.least_days})" for p in POLICIES)


def _outcome(p: str) -> str:
    """The first rule of a day, with the policy's numbers in columns of p."""
    return f"""CASE WHEN pnl <= -{p}daily_loss THEN 'daily_loss' WHEN equity <= CASE WHEN {p}trails THEN peak ELSE {p}balance END - {p}drawdown THEN 'drawdown'
  WHEN equity - {p}balance >= {p}target AND i >= {p}least_days AND best <= {p}share * (equity - {p}balance) THEN 'passed' END"""


_ROTATION = POLICIES[1]
_FLEX = f"""fo0 AS (SELECT *, lead(open) OVER o AS entry_price, lead(bar_id) OVER o AS entry_bar, lead(trade_date) OVER o AS entry_date, lead(session) OVER o AS es FROM f {sql.windows()}),
fo AS (SELECT product, trade_date, run_id, entry_bar, entry_price, atr20 AS atr FROM fo0 WHERE entry_date = trade_date AND es IS NOT NULL AND atr20 > 0),
fp AS (SELECT fo.*, b.bar_id, b.close AS c_, b.low, b.high, coalesce(greatest(0, max(b.high - entry_price) OVER q), 0) AS best_before, count(*) OVER q AS passed, greatest(0, max(b.high - entry_price) OVER u) AS best, greatest(0, max(entry_price - b.low) OVER u) AS worst
  FROM fo JOIN f b ON b.product = fo.product AND b.trade_date = fo.trade_date AND b.run_id = fo.run_id AND b.bar_id BETWEEN entry_bar AND entry_bar + 11
  WINDOW q AS (PARTITION BY fo.product, entry_bar ORDER BY b.bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY fo.product, entry_bar ORDER BY b.bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fs AS (SELECT *, greatest(entry_price - 1.0 * atr, CASE WHEN passed > 0 AND best_before >= 0.5 * atr THEN entry_price END, CASE WHEN passed > 0 THEN entry_price + best_before - 0.8 * atr END) AS stop, entry_price + 2.0 * atr AS target FROM fp),
fh AS (SELECT *, CASE WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' END AS hit FROM fs),
fe AS (SELECT product, trade_date, entry_bar, coalesce(min(bar_id) FILTER (hit IS NOT NULL), max(bar_id)) AS exit_bar, max(bar_id) AS last_bar, entry_bar + 11 AS full_bar FROM fh GROUP BY product, trade_date, entry_bar),
fx AS (SELECT e.product, e.trade_date, e.entry_bar, e.exit_bar, coalesce(h.hit, CASE WHEN e.last_bar = e.full_bar THEN 'time_exit' ELSE 'boundary_exit' END) AS exit_reason, (CASE h.hit WHEN 'stop' THEN h.stop WHEN 'target' THEN h.target ELSE h.c_ END - h.entry_price) / h.atr AS gross_r, h.best / h.atr AS mfe_r, h.worst / h.atr AS mae_r
  FROM fe e JOIN fh h ON h.product = e.product AND h.entry_bar = e.entry_bar AND h.bar_id = e.exit_bar),
fw AS (SELECT product, trade_date, min(entry_bar) AS entry_bar FROM fx GROUP BY ALL
  UNION ALL SELECT w.product, w.trade_date, (SELECT min(n.entry_bar) FROM fx n WHERE n.product = w.product AND n.trade_date = w.trade_date AND n.entry_bar > l.exit_bar) FROM fw w JOIN fx l ON l.product = w.product AND l.trade_date = w.trade_date AND l.entry_bar = w.entry_bar)"""

ORACLE_SQL |= {
    "ridge_fit": f"""WITH {SECTION}, x AS (SELECT feature / 50 AS x1, feature_b * 5 AS x2, target / 1e5 AS y FROM s WHERE research_partition = 'Development'),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM x),
b AS (SELECT *, ((v2 + lam) * c1 - c12 * c2) / ((v1 + lam) * (v2 + lam) - c12 * c12) AS b1, ((v1 + lam) * c2 - c12 * c1) / ((v1 + lam) * (v2 + lam) - c12 * c12) AS b2 FROM m, (VALUES {', '.join(f'({x}::DOUBLE)' for x in LAMBDAS)}) l(lam))
SELECT lam AS "lambda", {r('my - b1 * m1 - b2 * m2')} AS b0, {r('b1')} AS b1, {r('b2')} AS b2 FROM b""",
    "prop_firm": f"""WITH {_PNL}, po(policy, balance, target, daily_loss, drawdown, trails, share, least_days) AS (VALUES {_POLICY_ROWS}),
e AS (SELECT po.*, account, i, pnl, balance + sum(pnl) OVER w AS equity, greatest(0, max(pnl) OVER w) AS best FROM pn, po WINDOW w AS (PARTITION BY policy, account ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, greatest(balance, max(equity) OVER (PARTITION BY policy, account ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak FROM e),
o AS (SELECT *, {_outcome('')} AS outcome FROM p),
d AS (SELECT policy, account, coalesce(min(i) FILTER (outcome IS NOT NULL), max(i)) AS day FROM o GROUP BY ALL)
SELECT o.policy, o.account, coalesce(outcome, 'open') AS outcome, day, {r('equity', 2)} AS equity FROM d JOIN o ON o.policy = d.policy AND o.account = d.account AND o.i = d.day""",
    "challenge": f"""WITH RECURSIVE {_PNL.replace('AS i FROM', 'AS n FROM')}, po(balance, target, daily_loss, drawdown, trails, share, least_days) AS (VALUES ({_ROTATION.balance}::DOUBLE, {_ROTATION.target}::DOUBLE, {_ROTATION.daily_loss}::DOUBLE, {_ROTATION.drawdown}::DOUBLE, {str(_ROTATION.trailing).lower()}, {_ROTATION.best_day_share}::DOUBLE, {_ROTATION.least_days})),
st(account, n, attempt, i, equity, high, best, outcome) AS (
  SELECT DISTINCT account, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 'start' FROM pn
  UNION ALL SELECT account, n, attempt, i, equity, greatest(peak, equity), best, {_outcome('po.')} FROM (
    SELECT s.account, q.n, q.pnl, CASE WHEN s.outcome IS NULL THEN s.attempt ELSE s.attempt + 1 END AS attempt, CASE WHEN s.outcome IS NULL THEN s.i + 1 ELSE 1 END AS i, CASE WHEN s.outcome IS NULL THEN s.equity ELSE {_ROTATION.balance} END + q.pnl AS equity,
      CASE WHEN s.outcome IS NULL THEN s.high ELSE {_ROTATION.balance} END AS peak, greatest(CASE WHEN s.outcome IS NULL THEN s.best ELSE 0 END, q.pnl) AS best FROM st s JOIN pn q ON q.account = s.account AND q.n = s.n + 1) x, po WHERE attempt <= {ACCOUNTS})
SELECT account, attempt, max(i) AS days, coalesce(max(outcome), 'open') AS outcome, {r('arg_max(equity, i)', 2)} AS equity FROM st WHERE attempt > 0 GROUP BY account, attempt""",
    "flex_exits": f"{_RF}, {_FLEX} SELECT fx.trade_date, fx.entry_bar, exit_bar, exit_reason, {r('gross_r')} AS gross_r, {r('mfe_r')} AS mfe_r, {r('mae_r')} AS mae_r FROM fw JOIN fx USING (product, trade_date, entry_bar)",
    "kalman": f"""{_RF}, kr AS (SELECT product, bar_ts, bar_id, run_id, ret, row_number() OVER (PARTITION BY run_id ORDER BY bar_id) - 1 AS i FROM f WHERE ret IS NOT NULL),
ks(run_id, i, level, p, prior, s) AS (SELECT run_id, 0::BIGINT, ret + 1.01 / 2.01 * (ret - ret), 1.01 * (1 - 1.01 / 2.01), ret, 2.01::DOUBLE FROM kr WHERE i = 0
  UNION ALL SELECT k.run_id, x.i, k.level + (k.p + 0.01) / (k.p + 1.01) * (x.ret - k.level), (k.p + 0.01) * (1 - (k.p + 0.01) / (k.p + 1.01)), k.level, k.p + 1.01 FROM ks k JOIN kr x ON x.run_id = k.run_id AND x.i = k.i + 1)
SELECT {K}, CASE WHEN x.i >= 15 THEN {r('prior')} END AS prior, CASE WHEN x.i >= 15 THEN {r('(ret - prior) / sqrt(s)')} END AS innovation, CASE WHEN x.i >= 15 THEN {r('(s - 1.0) / s')} END AS gain FROM kr x JOIN ks USING (run_id, i)""",
}
