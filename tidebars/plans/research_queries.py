"""Queries of the study operators, and their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.windows import corr
from tidebars.operators import events, features, inference, labels, research, sequential
from tidebars.plans import sql
from tidebars.plans.aggregate_queries import TRADES
from tidebars.plans.event_queries import _PASSAGE, _zones
from tidebars.plans.label_queries import _path
from tidebars.plans.sql import r, rounded
from tidebars.sources.bars import TICK, daily_prices, event_bars

c = F.col


def zone_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.refine_zones(event_bars(spark, sf_dir))
    return out.groupBy("direction", "reason", "geometry_case").agg(F.count("*").alias("n"), rounded(F.avg("gap_ticks"), 4).alias("mean_gap"))


def stop_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.stop_models(features.prepared(event_bars(spark, sf_dir)))
    return out.groupBy("model").agg(F.count("*").alias("n"), rounded(F.avg("risk_ticks"), 4).alias("mean_risk"), rounded(F.max("risk_ticks"), 4).alias("max_risk"))


APPROACH = tuple(f"approach_{k}_{n}" for n in (3, 5, 10) for k in ("move", "efficiency"))


def approach_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.approach(features.prepared(event_bars(spark, sf_dir))).select("bar_id", *[rounded(n).alias(n) for n in APPROACH])


def displacement_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    out = research.displacement(events.gap_zones(bars), bars)
    return out.select("zone_id", *[rounded(n).alias(n) for n in ("net", "path", "largest")], "bars")


def grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = features.prepared(event_bars(spark, sf_dir))
    out = research.sweep(events.opportunities(bars).where("side = 1"), bars, [1.0, 2.0], [1.0, 2.0, 3.0], 12)
    return out.select(c("entry_session").alias("cell"), "n", rounded("mean_r").alias("mean_r"), rounded("target_rate").alias("target_rate"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled(features.prepared(event_bars(spark, sf_dir)), 8).where("reason = 'available' AND entry_session IS NOT NULL")


def sizing_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.sizing_ladder(_labelled(spark, sf_dir), "relvol20", "return_atr", [0.5, 1.0, 1.5, 2.0])
    return out.select("research_partition", "n", rounded("flat").alias("flat"), rounded("sized").alias("sized"))


def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.gate_comparison(_labelled(spark, sf_dir), c("relvol20") > 1.1, "range_atr", ["research_partition", "entry_session"])
    return out.select("research_partition", "entry_session", "n", "gated_n", *[rounded(n).alias(n) for n in ("baseline", "gated", "improvement")])


def confirmation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _labelled(spark, sf_dir).groupBy("entry_session", "research_partition").agg(corr(c("disp5"), c("return_atr")).alias("ic"))
    out = research.confirmation(cells, ["entry_session"], "ic")
    return out.select("entry_session", rounded("dev").alias("dev"), rounded("val").alias("val"), c("agrees").cast("int").alias("agrees"), rounded("retention", 4).alias("retention"), "verdict")


def interaction_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"wide_range": c("rng") > c("atr20"), "high_volume": c("relvol20") > 1, "strong_close": c("clv") > 0.5, "both": (c("rng") > c("atr20")) & (c("relvol20") > 1)}
    out = research.conditions(_labelled(spark, sf_dir), named, "return_atr", ["research_partition"])
    return out.select("research_partition", "condition", "n", rounded("mean").alias("mean"))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_prices(spark, sf_dir).where("high > low").withColumn("r", F.round((c("close") - c("open")) / (c("high") - c("low")), 9))
    out = research.session_stats(days, "r", ["l_returnflag"], "trade_date")
    return out.select("l_returnflag", "days", *[rounded(n).alias(n) for n in ("mean_day", "sharpe", "best", "worst", "win_days")])


def quintile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.quintiles(_labelled(spark, sf_dir), "relvol20", "range_atr", ["research_partition"])
    return out.select("research_partition", "buckets", rounded("spread").alias("spread"), rounded("monotonicity").alias("monotonicity"))


def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.viewport(event_bars(spark, sf_dir), 100, 1500, 400).select("bar_ts", "open", "high", "low", "close", "volume")


def boot_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of resampled accounts by outcome: replicates are rows, dealt over the cluster, each with its own seed.

    All days are in the pool: one number a day.
    """
    import pandas as pd

    pool = [x[0] for x in daily_prices(spark, sf_dir).where("high > low AND l_returnflag = 'N'").orderBy("trade_date").select(F.round(800 * (c("close") - c("open")) / (c("high") - c("low")), 2)).collect()]
    days, policy = np.array(pool), sequential.Policy("trailing")

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"].tolist():
                draw = np.random.default_rng(1000 + i).integers(0, len(days), 120)
                out.append((i, sequential.evaluate_account(days[draw], policy)[0]))
            yield pd.DataFrame(out, columns=["replicate", "outcome"])

    return spark.range(2000).mapInPandas(run, "replicate long, outcome string").groupBy("outcome").agg(F.count("*").alias("n"))


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size and percent-risk equity of daily results: a window sum, and a product of growth factors as a sum of logs."""
    from pyspark.sql import Window

    days = daily_prices(spark, sf_dir).where("high > low").withColumn("r", F.round((c("close") - c("open")) / (c("high") - c("low")), 9))
    w = Window.partitionBy("l_returnflag").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("l_returnflag", "trade_date", rounded(10000 + 100 * F.sum("r").over(w), 2).alias("fixed_size"), rounded(10000 * F.exp(F.sum(F.ln(1 + 0.01 * c("r"))).over(w)), 2).alias("percent_risk"))


def headline_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means by session with bootstrap intervals, from one pivoted daily table."""
    daily = _labelled(spark, sf_dir).groupBy("entry_session", "trade_date").agg(F.avg("return_atr").alias("m"))
    return inference.by_cell(daily, ["entry_session"], "m", "trade_date", {"days": "long", "mean": "double", "lo": "double", "hi": "double"}, lambda x: (len(x), float(np.nanmean(x)), *inference.bootstrap_mean_ci(x[~np.isnan(x)], 5)))


def pca_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance shares of the principal components of return profiles: Spark ML on vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = features.profile(features.prepared(event_bars(spark, sf_dir))).where("p_ret IS NOT NULL").select(array_to_vector("p_ret").alias("v"))
    if rows.isEmpty():
        return spark.createDataFrame([], "component int, share double")
    model = PCA(k=5, inputCol="v", outputCol="p").fit(rows)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.explainedVariance.toArray())], "component int, share double")


def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elastic-net coefficients on Development rows over a path of penalties: Spark ML."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = ["disp5", "disp15", "clv", "relvol20"]
    rows = _labelled(spark, sf_dir).where("research_partition = 'Development'").dropna(subset=[*names, "return_atr"])
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", "return_atr")
    out = []
    if rows.isEmpty():
        return spark.createDataFrame([], "alpha double, feature string, beta double")
    for alpha in (0.01, 0.05):
        fit = LinearRegression(featuresCol="x", labelCol="return_atr", regParam=alpha, elasticNetParam=0.5).fit(rows)
        out += [(alpha, n, float(b)) for n, b in zip(names, fit.coefficients, strict=True)]
    return spark.createDataFrame(out, "alpha double, feature string, beta double")


QUERIES: dict[str, sql.Query] = {
    f.__name__: f
    for f in (
        zone_refinement, stop_policies, approach_context, displacement_legs, grid_sweep, sizing_ladder, hybrid_gate, confirmation_gate, interaction_conditions, session_stats, quintile_summary, viewport, boot_prop, equity_curve, headline_ci,
        pca_profiles, elastic_net,
    )
}

_B = f"WITH {sql.bars()}"
_F = f"WITH {sql.features()}"
_L = f"WITH {sql.features()}, {_path(8)}, x AS (SELECT * FROM l WHERE reason = 'available' AND entry_session IS NOT NULL)"
_GAP = f"CASE WHEN close >= open THEN l2 - h0 ELSE l0 - h2 END / {TICK}"
_OPEN = f"CASE WHEN close >= open THEN o2 - h0 ELSE l0 - o2 END / {TICK}"
_EDGE = "CASE WHEN close >= open THEN h0 - least(open, close) ELSE greatest(open, close) - l0 END"


def _approach(n: int) -> str:
    same, move = f"lag(trade_date, {n + 1}) OVER o = trade_date", f"(lag(close) OVER o - lag(close, {n + 1}) OVER o)"
    path = f"sum(adc) OVER (PARTITION BY run_id ORDER BY bar_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"{r(f'CASE WHEN {same} THEN {move} / nullif(atr20, 0) END')} AS approach_move_{n}, {r(f'CASE WHEN {same} THEN abs({move}) / nullif({path}, 0) END')} AS approach_efficiency_{n}"


_MODELS = {
    "touch": "low",
    "adjacent": "min(low) OVER (PARTITION BY run_id ORDER BY bar_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "micro_swing": "min(low) OVER (PARTITION BY run_id ORDER BY bar_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)",
    "hybrid": "least(low, close - 0.5 * atr20)",
}
_STOPS = " UNION ALL ".join(f"SELECT '{n}' AS model, close, {x} AS stop FROM f" for n, x in _MODELS.items())
_SWEEP = _PASSAGE.replace("entry_session, entry_price, side, 1.5 * atr20 AS risk, entry_price - side * 1.5 * atr20 AS stop, entry_price + side * 3.0 * atr20 AS target", "sa || '|' || tgt AS entry_session, entry_price, side, sa * atr20 AS risk, entry_price - side * sa * atr20 AS stop, entry_price + side * tgt * sa * atr20 AS target").replace(
    "(VALUES (1), (-1)) s(side)", "(VALUES (1)) s(side), (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) sv(sa), (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) tv(tgt)"
)


def _bucket(n: int, x: str) -> str:
    qs = ", ".join(str(i / n) for i in range(1, n))
    return f"q AS (SELECT list_distinct(quantile_cont({x}, [{qs}])) AS edges FROM x WHERE research_partition = 'Development'), b AS (SELECT x.*, len(list_filter(edges, lambda e: e <= {x})) AS bucket FROM x, q WHERE {x} IS NOT NULL)"


ORACLE_SQL: dict[str, str] = {
    "zone_refinement": f"""{_B}, z AS (SELECT *, lag(high) OVER o AS h0, lag(low) OVER o AS l0, lead(high) OVER o AS h2, lead(low) OVER o AS l2, lead(open) OVER o AS o2 FROM bars {sql.windows()}),
y AS (SELECT CASE WHEN close >= open THEN 'bull' ELSE 'bear' END AS direction, {_GAP} AS gap, CASE WHEN {_EDGE} < 0 THEN 1 WHEN {_EDGE} = 0 THEN 2 ELSE 3 END AS geometry_case,
  CASE WHEN {_GAP} < 3 THEN 'gap_too_small' WHEN coalesce(abs(close - open) / nullif(high - low, 0), 0.0) < 0.3 THEN 'body_too_small' WHEN {_OPEN} <= 0 THEN 'no_open_gap' WHEN minute_of_day > 900 THEN 'late_session' ELSE 'accepted' END AS reason FROM z WHERE h0 IS NOT NULL AND h2 IS NOT NULL)
SELECT direction, reason, geometry_case, count(*) AS n, {r('avg(gap)', 4)} AS mean_gap FROM y GROUP BY ALL""",
    "stop_policies": f"{_F}, m AS ({_STOPS}) SELECT model, count(*) AS n, {r(f'avg((close - stop) / {TICK})', 4)} AS mean_risk, {r(f'max((close - stop) / {TICK})', 4)} AS max_risk FROM m WHERE stop IS NOT NULL GROUP BY 1",
    "approach_context": f"{_F} SELECT bar_id, {', '.join(_approach(n) for n in (3, 5, 10))} FROM f {sql.windows()}",
    "displacement_legs": f"{_B}, {_zones()} SELECT zone_id, {r('arg_max(b.close, b.bar_id) - arg_min(b.open, b.bar_id)')} AS net, {r('sum(abs(b.close - b.open))')} AS path, {r('max(b.high - b.low)')} AS largest, count(*) AS bars FROM zones z JOIN bars b ON b.product = z.product AND b.bar_id BETWEEN z.middle_bar - 5 AND z.middle_bar GROUP BY 1",
    "grid_sweep": f"{_F}, {_SWEEP} SELECT entry_session AS cell, count(*) AS n, {r('avg(gross_r)')} AS mean_r, {r('''avg(CASE WHEN exit_reason = 'target' THEN 1.0 ELSE 0.0 END)''')} AS target_rate FROM ex GROUP BY 1",
    "sizing_ladder": f"{_L}, {_bucket(4, 'relvol20')} SELECT research_partition, count(*) AS n, {r('avg(return_atr)')} AS flat, {r('sum(([0.5, 1.0, 1.5, 2.0])[least(bucket, 3) + 1] * return_atr) / sum(([0.5, 1.0, 1.5, 2.0])[least(bucket, 3) + 1])')} AS sized FROM b WHERE return_atr IS NOT NULL GROUP BY 1",
    "hybrid_gate": f"{_L} SELECT research_partition, entry_session, count(*) AS n, count(*) FILTER (relvol20 > 1.1) AS gated_n, {r('avg(range_atr)')} AS baseline, {r('avg(range_atr) FILTER (relvol20 > 1.1)')} AS gated, {r('avg(range_atr) FILTER (relvol20 > 1.1) - avg(range_atr)')} AS improvement FROM x GROUP BY 1, 2",
    "confirmation_gate": f"""{_L}, k AS (SELECT entry_session, corr(disp5, return_atr) FILTER (research_partition = 'Development') AS dev, corr(disp5, return_atr) FILTER (research_partition = 'Validation') AS val FROM x GROUP BY 1)
SELECT entry_session, {r('dev')} AS dev, {r('val')} AS val, CAST(sign(dev) = sign(val) AS INTEGER) AS agrees, {r('abs(val) / nullif(abs(dev), 0)', 4)} AS retention, CASE WHEN dev IS NULL OR val IS NULL THEN 'insufficient' WHEN sign(dev) <> sign(val) THEN 'sign_flip' WHEN abs(val) / nullif(abs(dev), 0) < 0.25 THEN 'faded' ELSE 'advance' END AS verdict FROM k""",
    "interaction_conditions": f"{_L} " + " UNION ALL ".join(f"SELECT research_partition, '{n}' AS condition, count(*) FILTER ({x}) AS n, {r(f'avg(return_atr) FILTER ({x})')} AS mean FROM x GROUP BY 1" for n, x in (("wide_range", "rng > atr20"), ("high_volume", "relvol20 > 1"), ("strong_close", "clv > 0.5"), ("both", "rng > atr20 AND relvol20 > 1"))),
    "session_stats": f"WITH {TRADES}, d AS (SELECT l_returnflag, trade_date, sum(r) AS d FROM t GROUP BY 1, 2) SELECT l_returnflag, count(*) AS days, {r('avg(d)')} AS mean_day, {r(f'avg(d) / stddev_samp(d) * {math.sqrt(252)!r}')} AS sharpe, {r('max(d)')} AS best, {r('min(d)')} AS worst, {r('avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)')} AS win_days FROM d GROUP BY 1",
    "quintile_summary": f"{_L}, {_bucket(5, 'relvol20')}, m AS (SELECT research_partition, bucket, avg(range_atr) AS m FROM b WHERE range_atr IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY research_partition ORDER BY m) AS rk FROM m) SELECT research_partition, count(*) AS buckets, {r('arg_max(m, bucket) - arg_min(m, bucket)')} AS spread, {r('corr(bucket, rk)')} AS monotonicity FROM k GROUP BY 1",
    "viewport": f"{_B} SELECT min(bar_ts) AS bar_ts, arg_min(open, bar_id) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_id) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars WHERE bar_id BETWEEN 100 AND 1500 GROUP BY product, bar_id // 4",
    "equity_curve": f"WITH {TRADES} SELECT l_returnflag, trade_date, {r('10000 + 100 * sum(r) OVER w', 2)} AS fixed_size, {r('10000 * exp(sum(ln(1 + 0.01 * r)) OVER w)', 2)} AS percent_risk FROM t WINDOW w AS (PARTITION BY l_returnflag ORDER BY trade_date)",
}
