"""Queries of evaluation: frames, screens, folds and ridge, redundancy, gates; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.windows import safe_div
from tidebars.operators import aggregates, evaluation, features
from tidebars.plans import sql
from tidebars.plans.aggregate_queries import SECTION, rank
from tidebars.plans.feature_queries import MATRIX_FEATURES, MATRIX_SQL, feature_matrix
from tidebars.plans.label_queries import _path
from tidebars.plans.sql import r, rounded
from tidebars.sources.bars import NEW_YORK, cross_section, event_bars

c = F.col
HZ = evaluation.HORIZONS
Y = tuple(f"y_{h}" for h in HZ)
#: Features of the redundancy and ridge queries; the last one counts as experimental.
NAMES = ("bps5", "clv", "disp15", "disp5", "relvol20", "rv15")
EXPERIMENTAL = ("rv15",)
X = ("disp5", "clv")
PENALTIES = (0.0, 0.1, 1.0)
FIRST, SIZE, FOLDS = 9, 3, 3


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_outcomes(features.prepared(event_bars(spark, sf_dir)))


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluation_frame(_outcomes(spark, sf_dir))


def evaluation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir).select("product", "bar_id", "entry_session", "research_partition", *[rounded(n).alias(n) for n in (*X, *Y)])


def frame_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.frame_funnel(_outcomes(spark, sf_dir))


def univariate_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the matrix, all horizons, sessions and partitions: one unpivoted, grouped plan."""
    keys = ["product", "bar_id"]
    matrix = feature_matrix(spark, sf_dir).select(*keys, *[c(n).cast("double").alias(n) for n in MATRIX_FEATURES])
    rows = _frame(spark, sf_dir).select(*keys, "entry_session", "research_partition", "trade_date", *[rounded(n).alias(n) for n in Y]).join(matrix, keys)
    out = evaluation.screen(rows, MATRIX_FEATURES)
    return out.select("feature", "horizon", "entry_session", "research_partition", "dates", *[rounded(n, 5).alias(n) for n in ("mean_ic", "t", "lo", "hi", "p", "q")])


def multi_partial_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.residual_ic(cross_section(spark, sf_dir), "feature", "target", ["feature_b", "l_linenumber"])
    return out.select("trade_date", "pairs", rounded("partial_ic").alias("partial_ic"))


def redundancy_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations, clusters, representatives, the anchor, partial rank correlation given the anchor, the frozen set.

    Rows are aggregated to one number a pair or a date; what follows is features by features.
    """
    rows = _frame(spark, sf_dir).where("research_partition = 'Development'").select("trade_date", *[rounded(n).alias(n) for n in (*NAMES, "y_4")])
    rows = rows.dropna()
    pairs = evaluation.correlations(rows, list(NAMES))
    leader = evaluation.clusters(pairs, list(NAMES), 0.7)
    scores = evaluation.daily_scores(rows, list(NAMES), "y_4")
    table = spark.createDataFrame([(n, leader[n], n in EXPERIMENTAL) for n in NAMES], "feature string, cluster string, experimental boolean").join(scores, "feature")
    chosen = evaluation.representatives(table)
    # as many rows as there are clusters
    picked = [tuple(x) for x in chosen.select("feature", "cluster", "score").orderBy(F.desc("score"), "feature").collect()]
    if not picked:
        return spark.createDataFrame([], "feature string, cluster string, score double, anchor boolean, partial double, frozen boolean")
    anchor = picked[0][0]
    partial = evaluation.partial_scores(rows, [x[0] for x in picked[1:]], "y_4", anchor)
    out = spark.createDataFrame(picked, "feature string, cluster string, score double").join(partial, "feature", "left")
    frozen = (c("feature") == anchor) | (F.abs("partial") >= 0.01)
    return out.select("feature", "cluster", rounded("score").alias("score"), (c("feature") == anchor).alias("anchor"), "partial", F.coalesce(frozen, F.lit(False)).alias("frozen"))


def _dates(rows: DataFrame) -> DataFrame:
    """trade_date, no: a short row a date."""
    return rows.select("trade_date").distinct().withColumn("no", F.row_number().over(Window.orderBy("trade_date")) - 1)


def _folds(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    dates = _dates(rows)
    return dates, evaluation.fold_table(spark, dates.count(), FIRST, SIZE, FOLDS)


def _development(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir).where(c("research_partition") == "Development").select("trade_date", "bar_id", *X, "y_4").dropna()


def date_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in training and assessment of each expanding fold of the cross-section; one date is left out between them."""
    rows = cross_section(spark, sf_dir)
    dates = _dates(rows)
    n = dates.count()
    folds = evaluation.fold_table(spark, n, n // 2, max(1, n // 8), 4)
    per_date = rows.groupBy("trade_date").agg(F.count("*").alias("rows"))
    return evaluation.by_fold(per_date, dates, folds).groupBy("fold").agg(F.sum(F.when(c("role") == "train", c("rows")).otherwise(0)).alias("train_rows"), F.sum(F.when(c("role") == "assess", c("rows")).otherwise(0)).alias("assess_rows"))


def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _development(spark, sf_dir)
    out = evaluation.walk_forward(rows, *_folds(spark, rows), list(X), "y_4", [0.1])
    return out.select("fold", "bar_id", rounded("y", 5).alias("y"), rounded("prediction", 5).alias("prediction"))


def ridge_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _development(spark, sf_dir)
    out = evaluation.choose_penalty(evaluation.walk_forward(rows, *_folds(spark, rows), list(X), "y_4", list(PENALTIES)))
    return out.select("penalty", rounded("mean_ic", 5).alias("mean_ic"), "chosen")


def refit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Development fit on Validation rows: daily rank correlation of the prediction and of the anchor with the outcome, paired."""
    rows = _frame(spark, sf_dir).select("research_partition", "trade_date", "bar_id", *X, "y_4").dropna()
    fit = evaluation.refit(rows, list(X), "y_4", 0.1).select("trade_date", F.round("prediction", 6).alias("prediction"), F.round(X[0], 6).alias("anchor"), F.round("y_4", 6).alias("y"))
    a = aggregates.daily_spearman(fit, "prediction", "y").select("trade_date", "pairs", c("rho").alias("model"))
    b = aggregates.daily_spearman(fit, "anchor", "y").select("trade_date", c("rho").alias("anchor"))
    return a.join(b, "trade_date").select("trade_date", "pairs", rounded("model").alias("model"), rounded("anchor").alias("anchor"), rounded(c("model") - c("anchor")).alias("delta"))


def combination_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development decides, Validation is read once: the penalty by walk-forward, a refit, its daily rank correlation beside the
    anchor's, the gates that fail; nothing is published unless all hold."""
    rows = _frame(spark, sf_dir).select("research_partition", "trade_date", "bar_id", *X, "y_4").dropna()
    dev = rows.where("research_partition = 'Development'").drop("research_partition")
    table = evaluation.choose_penalty(evaluation.walk_forward(dev, *_folds(spark, dev), list(X), "y_4", list(PENALTIES)))
    chosen = table.where("chosen").select("penalty", "mean_ic").first()
    if chosen is None:
        return spark.createDataFrame([], "penalty double, oof_ic double, days long, model double, anchor double, failures string, published boolean")
    penalty, oof = chosen
    fit = evaluation.refit(rows, list(X), "y_4", penalty).select("trade_date", F.round("prediction", 6).alias("prediction"), F.round(X[0], 6).alias("anchor"), F.round("y_4", 6).alias("y"))
    a = aggregates.daily_spearman(fit, "prediction", "y").agg(F.count("*").alias("days"), F.avg("rho").alias("model"))
    b = aggregates.daily_spearman(fit, "anchor", "y").agg(F.avg("rho").alias("anchor"))
    out = a.join(b).withColumns({"penalty": F.lit(penalty), "oof_ic": F.lit(oof)})
    gates = {"oof": c("oof_ic") > 0.02, "days": c("days") >= 3, "sign": F.signum("model") == F.signum("oof_ic"), "beats_anchor": c("model") > c("anchor")}
    failures = F.array_join(evaluation.failed_gates(gates), ",")
    return out.select("penalty", rounded("oof_ic", 5).alias("oof_ic"), "days", rounded("model", 5).alias("model"), rounded("anchor", 5).alias("anchor"), failures.alias("failures"), (failures == "").alias("published"))


def verdict_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of every feature at one horizon: support, size, agreement of Validation; the first that fail, and a verdict."""
    rows = _frame(spark, sf_dir).select("entry_session", "research_partition", "trade_date", *[rounded(n).alias(n) for n in (*NAMES, "y_4")])
    cells = evaluation.screen(rows, list(NAMES), (4,))
    wide = cells.groupBy("feature", "entry_session").pivot("research_partition", ["Development", "Validation"]).agg(F.first("dates").alias("dates"), F.first(F.round("mean_ic", 9)).alias("ic"))
    gates = {"support": c("Development_dates") >= 10, "size": F.abs("Development_ic") >= 0.03, "sign": F.signum("Development_ic") == F.signum("Validation_ic"), "retention": F.abs("Validation_ic") >= 0.5 * F.abs("Development_ic")}
    out = wide.withColumn("failures", F.array_join(evaluation.failed_gates(gates), ","))
    return out.select("feature", "entry_session", "failures", F.when(c("failures") == "", "advance").when(c("failures").isin("sign", "retention", "sign,retention"), "reject_validation").otherwise("reject").alias("verdict"))


def qcut_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.deciles(_frame(spark, sf_dir).select("research_partition", rounded("disp5").alias("x"), "y_4"), "x")
    return rows.groupBy("research_partition", "decile").agg(F.count("*").alias("n"), rounded(F.avg("y_4"), 5).alias("mean_y"))


def nested_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, sf_dir).where("research_partition = 'Development'").select("trade_date", F.abs("y_8").alias("size"))
    out = evaluation.nested_expansion(rows, *_folds(spark, rows), "size", 0.8)
    return out.select("fold", rounded("threshold").alias("threshold"), "rows", rounded("share").alias("share"))


def perf_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.spread_sharpe(_frame(spark, sf_dir).select("research_partition", "trade_date", rounded("disp5").alias("x"), "y_4"), "x", "y_4")
    return out.select("research_partition", "days", rounded("mean_spread", 5).alias("mean_spread"), rounded("sharpe", 4).alias("sharpe"))


def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.prepared(event_bars(spark, sf_dir)).select(*[F.round(n, 6).alias(n) for n in ("bps5", "disp5", "rv15", "rv30", "atr5", "atr20")])
    out = evaluation.overlap_audit(rows, ["bps5", "rv15", "atr5"], ["disp5", "rv30", "atr20", "atr5"])
    return out.select("feature", "existing", "n", rounded("rho").alias("rho"), "equal", "near_duplicate")


def vol_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ATR over close, scaled by the square root of the horizon over 20, beside what came."""
    rows = features.prepared(event_bars(spark, sf_dir)).where("atr20 IS NOT NULL")
    return rows.select("product", "bar_id", *[rounded(1e4 * safe_div(c("atr20"), c("close")) * F.sqrt(F.lit(h / 20.0)), 4).alias(f"anchor_{h}") for h in (4, 8, 20)])


def edge_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features of the bars of one day, and why one is missing."""
    rows = features.prepared(event_bars(spark, sf_dir)).where("trade_date = DATE '2024-01-10'")
    need = {"disp5": 20, "relvol20": 20, "rv15": 16, "clv": 1}
    long = rows.unpivot(["bar_id", "run_position", "rng", "atr20", "vmean20"], list(need), "feature", "value")
    wants = F.create_map(*[x for n, k in need.items() for x in (F.lit(n), F.lit(k))])
    cause = F.when(c("value").isNotNull(), None).when(c("run_position") < wants[c("feature")], "warm_up").when((c("feature") == "clv") & (c("rng") == 0), "no_range").otherwise("undefined")
    return long.select("bar_id", "feature", rounded("value").alias("value"), cause.alias("cause"))


def day_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every bar: the day's open, high, low and VWAP so far, the day before's high, low and close, trend of two means,
    efficiency of 15 bars, and the Development quartile of ATR20."""
    bars = features.prepared(event_bars(spark, sf_dir))
    so_far = Window.partitionBy("product", "trade_date").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    days = bars.groupBy("product", "trade_date").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bar_id").alias("cl"))
    w = Window.partitionBy("product").orderBy("trade_date")
    before = days.select("product", "trade_date", *[F.lag(x).over(w).alias(n) for x, n in (("h", "previous_high"), ("l", "previous_low"), ("cl", "previous_close"))])
    run = Window.partitionBy("run_id").orderBy("bar_id")
    mean = lambda n: F.when(F.count("close").over(run.rowsBetween(1 - n, 0)) == n, F.avg("close").over(run.rowsBetween(1 - n, 0)))
    moved = F.abs(c("close") - F.lag("close", 15).over(run))
    path = F.when(F.count("adc").over(run.rowsBetween(-14, 0)) == 15, F.sum("adc").over(run.rowsBetween(-14, 0)))
    rows = bars.withColumns(
        {
            "day_open": F.first("open").over(so_far), "day_high": F.max("high").over(so_far), "day_low": F.min("low").over(so_far), "day_vwap": safe_div(F.sum("pv").over(so_far), F.sum("volume").over(so_far)),
            "sma20": mean(20), "sma50": mean(50), "efficiency": safe_div(moved, path), "vol": F.round("atr20", 6),
        }
    )
    rows = evaluation.deciles(rows, "vol", 4).withColumnRenamed("decile", "vol_quartile").join(before, ["product", "trade_date"])
    trend = F.when(c("sma20").isNull() | c("sma50").isNull(), None).when(c("sma20") > c("sma50"), "up").when(c("sma20") < c("sma50"), "down").otherwise("flat")
    names = ("day_open", "day_high", "day_low", "day_vwap", "previous_high", "previous_low", "previous_close", "efficiency")
    return rows.select("product", "bar_id", *[rounded(n).alias(n) for n in names], trend.alias("trend"), c("vol_quartile").cast("int").alias("vol_quartile"))


def interactions_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight products of declared pairs, NULL where a side is."""
    rows = features.prepared(event_bars(spark, sf_dir))
    pairs = (("disp5", "relvol20"), ("disp15", "relvol20"), ("disp5", "clv"), ("disp15", "clv"), ("clv", "relvol20"), ("disp5", "disp30"), ("rv15", "relvol20"), ("disp30", "clv"))
    return rows.select("product", "bar_id", *[rounded(c(a) * c(b)).alias(f"{a}_x_{b}") for a, b in pairs])


def interactions_fes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four products with the relative volume held to [0.5, 2]."""
    rows = features.prepared(event_bars(spark, sf_dir)).withColumn("held", features.clip(c("relvol20"), 0.5, 2.0))
    return rows.select("product", "bar_id", *[rounded(c(a) * c("held")).alias(f"{a}_x_held_volume") for a in ("disp5", "disp15", "clv", "bps5")])


def feature_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production checks of the matrix as rows: identity, range, missingness, boundaries; one aggregate, no row is gathered."""
    matrix = feature_matrix(spark, sf_dir)
    rows = matrix.join(event_bars(spark, sf_dir).select("product", "bar_id", "run_position"), ["product", "bar_id"])
    n = F.count("*")
    checks = {
        "identity": n - F.count_distinct("product", "bar_id"),
        "bounded_position": F.count_if(~c("rolling_range_position_60").between(-1e-9, 1 + 1e-9)),
        "bounded_efficiency": F.count_if(~c("efficiency_ratio_30").between(0.0, 1.0)),
        "bounded_choppiness": F.count_if(~c("choppiness_14").between(0.0, 100.0)),
        "not_finite": F.count_if(F.abs("return_5m_bps") == float("inf")),
        "warm_up_atr": F.count_if((c("run_position") < 19) & c("atr_20").isNotNull()),
        "warm_up_return": F.count_if((c("run_position") < 60) & c("return_60m_bps").isNotNull()),
        "missing_atr": F.count_if((c("run_position") >= 19) & c("atr_20").isNull()),
        "streak_limit": F.count_if(F.abs("directional_streak") > 120),
    }
    wide = rows.agg(*[x.cast("long").alias(name) for name, x in checks.items()])
    out = wide.select(F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), c(name).alias("failures")) for name in checks])).alias("x")).select("x.*")
    return out.withColumn("passed", c("failures") == 0)


_ALL = (
    evaluation_frame, frame_funnel, univariate_screen, multi_partial_ic, redundancy_pipeline, date_folds, oof_predictions, ridge_walkforward, refit_validation, combination_run, verdict_gates, qcut_decile, nested_expansion, perf_sharpe,
    overlap_audit, vol_anchor, edge_day, day_levels, interactions_poi, interactions_fes, feature_gates,
)
QUERIES: dict[str, sql.Query] = {f.__name__: f for f in _ALL}

_F = f"WITH {sql.features()}"
_LABELS = ", ".join(_path(h, f"l{h}_") for h in HZ)
_EW = f"""{_F}, {_LABELS}, ew AS (SELECT a.*, {", ".join(f"l{h}_.return_atr AS y_{h}, l{h}_.reason AS reason_{h}" for h in HZ)} FROM l{HZ[0]}_ a {" ".join(f"JOIN l{h}_ l{h}_{'' if h != HZ[0] else ''} ON l{h}_.product = a.product AND l{h}_.bar_id = a.bar_id" for h in HZ)})"""
_RULES = ["true", "research_partition IN ('Development', 'Validation')", "entry_session IS NOT NULL", *[f"coalesce(reason_{h} = 'available' AND y_{h} IS NOT NULL, false)" for h in HZ]]
_RULE_NAMES = ["all", "partition", "session", *[f"horizon_{h}" for h in HZ]]
_EV = f"{_EW}, ev AS (SELECT * FROM ew WHERE {' AND '.join(_RULES)})"
_SHOWN = lambda names, digits=6: ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _tail(t: str) -> str:
    k = f"(1 / (1 + {evaluation.TAIL_STEP} * abs({t})))"
    poly = "0.0"
    for a in reversed(evaluation.TAIL):
        poly = f"(({poly} + {a}) * {k})"
    return f"least(1.0, 2 / sqrt(2 * pi()) * exp(-{t} * {t} / 2) * {poly})"


def _screen(source: str, names, horizons) -> str:
    """CTEs up to cells (with q) from a source of keys, outcomes and features."""
    keys = "feature, entry_session, research_partition, trade_date"
    ranks = ", ".join(f"{rank(f'y_{h}', keys)} AS r_{h}" for h in horizons)
    long = " UNION ALL ".join(f"SELECT '{n}' AS feature, entry_session, research_partition, trade_date, CAST({n} AS DOUBLE) AS x, {', '.join(f'y_{h}' for h in horizons)} FROM {source} WHERE {n} IS NOT NULL" for n in names)
    tall = " UNION ALL ".join(f"SELECT {keys}, {h} AS horizon, {_corr('rx', f'r_{h}')} AS ic FROM rk GROUP BY {keys} HAVING count(*) >= 5" for h in horizons)
    return f"""lg AS ({long}), rk AS (SELECT *, {rank('x', keys)} AS rx, {ranks} FROM lg),
tall AS (SELECT * FROM ({tall}) WHERE ic IS NOT NULL),
c0 AS (SELECT feature, horizon, entry_session, research_partition, count(*) AS dates, avg(ic) AS mean_ic, stddev_samp(ic) AS sd FROM tall GROUP BY ALL),
c1 AS (SELECT *, CASE WHEN sd > 1e-9 THEN sd / sqrt(dates) END AS err FROM c0),
c2 AS (SELECT *, mean_ic / err AS t, mean_ic - 1.96 * err AS lo, mean_ic + 1.96 * err AS hi FROM c1),
c3 AS (SELECT *, round({_tail('t')}, 9) AS p FROM c2),
c4 AS (SELECT *, p * count(*) OVER f / row_number() OVER (PARTITION BY entry_session, research_partition, horizon ORDER BY p) AS raw FROM c3 WHERE p IS NOT NULL WINDOW f AS (PARTITION BY entry_session, research_partition, horizon)),
cells AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY entry_session, research_partition, horizon ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM c4)"""


_ROUNDED = "SELECT entry_session, research_partition, trade_date, " + _SHOWN((*NAMES, "y_4")) + " FROM ev"
_DEV = "dev AS (SELECT trade_date, bar_id, disp5, clv, y_4 FROM ev WHERE research_partition = 'Development' AND disp5 IS NOT NULL AND clv IS NOT NULL)"


def _fold_ctes(source: str, first: str = str(FIRST), size: str = str(SIZE), folds: int = FOLDS) -> str:
    return f"""dn AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS no FROM (SELECT DISTINCT trade_date FROM {source})),
dc AS (SELECT count(*) AS n FROM dn),
fo AS (SELECT CAST(i AS INTEGER) AS fold, {first} + i * {size} - 2 AS train_to, {first} + i * {size} AS assess_from, least({first} + (i + 1) * {size} - 1, n - 1) AS assess_to FROM dc, (SELECT unnest(range({folds})) AS i) WHERE {first} + i * {size} < n),
bf AS (SELECT s.*, fold, no <= train_to AS train FROM {source} s JOIN dn USING (trade_date) JOIN fo ON no <= train_to OR no BETWEEN assess_from AND assess_to)"""


_FIT = """su AS (SELECT fold, avg(disp5) AS ma, avg(clv) AS mb, avg(y_4) AS my, stddev_pop(disp5) AS sa, stddev_pop(clv) AS sb, covar_pop(disp5, clv) AS cab, covar_pop(disp5, y_4) AS cay, covar_pop(clv, y_4) AS cby FROM bf WHERE train GROUP BY fold),
sr AS (SELECT *, cab / nullif(sa * sb, 0) AS rab, cay / nullif(sa, 0) AS ray, cby / nullif(sb, 0) AS rby FROM su)"""
_COEF = "((1 + pen) * ray - rab * rby) / nullif((1 + pen) * (1 + pen) - rab * rab, 0) AS ba, ((1 + pen) * rby - rab * ray) / nullif((1 + pen) * (1 + pen) - rab * rab, 0) AS bb"
_PREDICT = "my + ba * (disp5 - ma) / nullif(sa, 0) + bb * (clv - mb) / nullif(sb, 0)"


def _scored(penalties) -> str:
    values = ", ".join(f"({p}::DOUBLE)" for p in penalties)
    return f"{_EV}, {_DEV}, {_fold_ctes('dev')}, {_FIT}, fi AS (SELECT *, {_COEF} FROM sr, (VALUES {values}) v(pen)), sc AS (SELECT bf.fold, pen, bar_id, y_4 AS y, {_PREDICT} AS prediction FROM bf JOIN fi USING (fold) WHERE NOT train)"


def _decile_edges(source: str, x: str, n: int) -> str:
    return f"ed AS (SELECT [{', '.join(f'quantile_cont({x}, {i / n})' for i in range(1, n))}] AS edges FROM {source} WHERE research_partition = 'Development')"


_DECILE = lambda x: f"CASE WHEN {x} IS NOT NULL THEN CAST(1 + len(list_filter(edges, lambda e: e < {x})) AS INTEGER) END"
_DAY_RANK = lambda x: f"({rank(x, 'trade_date')}) / count(*) OVER (PARTITION BY trade_date)"
_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
_RHO = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(f'k_{a}', f'k_{b}')} AS rho FROM rk" for a, b in _PAIRS)
_SPEAR = " UNION ALL ".join(f"SELECT '{n}' AS feature, {_corr('rx', 'ry')} AS rho FROM (SELECT trade_date, {rank(n, 'trade_date')} AS rx, {rank('y_4', 'trade_date')} AS ry FROM d) GROUP BY trade_date HAVING count(*) >= 10 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0" for n in NAMES)
_PARTIALS = " UNION ALL ".join(
    f"""SELECT '{a}' AS anchor, '{n}' AS feature, CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-12 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END AS p FROM (
SELECT trade_date, {_corr('x', 'y')} AS xy, {_corr('x', 'z')} AS xz, {_corr('y', 'z')} AS yz FROM (SELECT trade_date, {rank(n, 'trade_date')} AS x, {rank('y_4', 'trade_date')} AS y, {rank(a, 'trade_date')} AS z FROM d) GROUP BY trade_date HAVING count(*) >= 10)"""
    for n in NAMES
    for a in NAMES
    if a != n
)
_GATES = [("identity", "count(*) - count(DISTINCT (product, bar_id))"), ("bounded_position", "count(*) FILTER (NOT rolling_range_position_60 BETWEEN -1e-9 AND 1 + 1e-9)"), ("bounded_efficiency", "count(*) FILTER (NOT efficiency_ratio_30 BETWEEN 0 AND 1)"), ("bounded_choppiness", "count(*) FILTER (NOT choppiness_14 BETWEEN 0 AND 100)"),
          ("not_finite", "count(*) FILTER (isinf(return_5m_bps))"), ("warm_up_atr", "count(*) FILTER (run_position < 19 AND atr_20 IS NOT NULL)"), ("warm_up_return", "count(*) FILTER (run_position < 60 AND return_60m_bps IS NOT NULL)"), ("missing_atr", "count(*) FILTER (run_position >= 19 AND atr_20 IS NULL)"), ("streak_limit", "count(*) FILTER (abs(directional_streak) > 120)")]
_PARTIAL3 = lambda i, j, k: f"(c{i}{j} - c{i}{k} * c{j}{k}) / sqrt((1 - c{i}{k} * c{i}{k}) * (1 - c{j}{k} * c{j}{k}))"

ORACLE_SQL: dict[str, str] = {
    "evaluation_frame": f"{_EV} SELECT product, bar_id, entry_session, research_partition, {_SHOWN((*X, *Y))} FROM ev",
    "frame_funnel": f"{_EW} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, '{n}' AS rule, count(*) FILTER ({' AND '.join(_RULES[: i + 1])}) AS rows FROM ew" for i, n in enumerate(_RULE_NAMES)),
    "univariate_screen": f"{_EV}, mx AS ({MATRIX_SQL}), j AS (SELECT ev.entry_session, ev.research_partition, ev.trade_date, {', '.join(f'{r(f'ev.{y}')} AS {y}' for y in Y)}, {', '.join(f'mx.{n}' for n in MATRIX_FEATURES)} FROM ev JOIN mx ON mx.product = ev.product AND mx.bar_id = ev.bar_id), {_screen('j', MATRIX_FEATURES, HZ)} SELECT feature, CAST(horizon AS INTEGER) AS horizon, entry_session, research_partition, dates, {_SHOWN(('mean_ic', 't', 'lo', 'hi', 'p', 'q'), 5)} FROM cells",
    "multi_partial_ic": f"""WITH {SECTION}, k AS (SELECT trade_date, {rank('feature', 'trade_date')} AS r0, {rank('target', 'trade_date')} AS r1, {rank('feature_b', 'trade_date')} AS r2, {rank('l_linenumber', 'trade_date')} AS r3 FROM s),
g AS (SELECT trade_date, count(*) AS pairs, {', '.join(f'{_corr(f"r{j}", f"r{i}")} AS c{i}{j}' for j in range(4) for i in range(j))} FROM k GROUP BY 1 HAVING count(*) >= 10),
h AS (SELECT trade_date, pairs, {', '.join(f'CASE WHEN (1 - c{i}3 * c{i}3) * (1 - c{j}3 * c{j}3) > 1e-12 THEN {_PARTIAL3(i, j, 3)} END AS c{i}{j}' for i, j in ((0, 1), (0, 2), (1, 2)))} FROM g)
SELECT trade_date, pairs, {r(f'CASE WHEN (1 - c02 * c02) * (1 - c12 * c12) > 1e-12 THEN {_PARTIAL3(0, 1, 2)} END')} AS partial_ic FROM h""",
    "redundancy_pipeline": f"""{_EV.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS (SELECT trade_date, {_SHOWN((*NAMES, 'y_4'))} FROM ev WHERE research_partition = 'Development' AND {' AND '.join(f'{n} IS NOT NULL' for n in NAMES)}),
rk AS (SELECT {', '.join(f'{_DAY_RANK(n)} AS k_{n}' for n in NAMES)} FROM d),
rho AS ({_RHO}), lk AS (SELECT a, b FROM rho WHERE abs(rho) >= 0.7 UNION ALL SELECT b, a FROM rho WHERE abs(rho) >= 0.7),
nm AS (SELECT unnest({list(NAMES)!r}) AS feature), cc(feature, other) AS (SELECT feature, feature FROM nm UNION SELECT cc.feature, lk.b FROM cc JOIN lk ON lk.a = cc.other),
cl AS (SELECT feature, min(other) AS cluster FROM cc GROUP BY 1), sp AS (SELECT feature, round(abs(avg(rho)), 9) AS score FROM ({_SPEAR}) GROUP BY 1),
rp AS (SELECT feature, cluster, score FROM cl JOIN sp USING (feature) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, feature IN {EXPERIMENTAL!r}, feature) = 1),
an AS (SELECT feature AS anchor FROM rp ORDER BY score DESC, feature LIMIT 1), pa AS (SELECT anchor, feature, round(avg(p), 6) AS partial FROM ({_PARTIALS}) GROUP BY ALL)
SELECT rp.feature, cluster, {r('score')} AS score, rp.feature = an.anchor AS anchor, partial, coalesce(rp.feature = an.anchor OR abs(partial) >= 0.01, false) AS frozen FROM rp CROSS JOIN an LEFT JOIN pa ON pa.feature = rp.feature AND pa.anchor = an.anchor""".replace("IN ('rv15',)", "IN ('rv15')"),
    "date_folds": f"WITH {SECTION}, pd AS (SELECT trade_date, count(*) AS rows FROM s GROUP BY 1), {_fold_ctes('pd', '(n // 2)', 'greatest(1, n // 8)', 4)} SELECT fold, CAST(coalesce(sum(rows) FILTER (train), 0) AS BIGINT) AS train_rows, CAST(coalesce(sum(rows) FILTER (NOT train), 0) AS BIGINT) AS assess_rows FROM bf GROUP BY fold",
    "oof_predictions": f"{_scored([0.1])} SELECT fold, bar_id, {r('y', 5)} AS y, {r('prediction', 5)} AS prediction FROM sc",
    "ridge_walkforward": f"{_scored(PENALTIES)}, fc AS (SELECT fold, pen, round({_corr('prediction', 'y')}, 9) AS ic FROM sc GROUP BY ALL), tb AS (SELECT pen, round(avg(ic), 9) AS mean_ic FROM fc GROUP BY 1) SELECT pen AS penalty, {r('mean_ic', 5)} AS mean_ic, pen = (SELECT pen FROM tb ORDER BY mean_ic DESC NULLS LAST, pen DESC LIMIT 1) AS chosen FROM tb",
    "refit_validation": f"""{_EV}, al AS (SELECT * FROM ev WHERE disp5 IS NOT NULL AND clv IS NOT NULL), bf AS (SELECT *, 0 AS fold, true AS train FROM al WHERE research_partition = 'Development'), {_FIT}, fi AS (SELECT *, {_COEF} FROM sr, (VALUES (0.1::DOUBLE)) v(pen)),
v AS (SELECT trade_date, round({_PREDICT}, 6) AS prediction, round(disp5, 6) AS anchor, round(y_4, 6) AS y FROM al, fi WHERE research_partition = 'Validation'),
k AS (SELECT trade_date, {rank('prediction', 'trade_date')} AS rp, {rank('anchor', 'trade_date')} AS ra, {rank('y', 'trade_date')} AS ry FROM v),
g AS (SELECT trade_date, count(*) AS pairs, {_corr('rp', 'ry')} AS model, {_corr('ra', 'ry')} AS anchor FROM k GROUP BY 1 HAVING count(*) >= 10)
SELECT trade_date, pairs, {r('model')} AS model, {r('anchor')} AS anchor, {r('model - anchor')} AS delta FROM g WHERE model IS NOT NULL AND anchor IS NOT NULL""",
    "combination_run": f"""{_scored(PENALTIES)}, fc AS (SELECT fold, pen, round({_corr('prediction', 'y')}, 9) AS ic FROM sc GROUP BY ALL), tb AS (SELECT pen, round(avg(ic), 9) AS mean_ic FROM fc GROUP BY 1), ch AS (SELECT pen, mean_ic FROM tb ORDER BY mean_ic DESC NULLS LAST, pen DESC LIMIT 1),
al AS (SELECT * FROM ev WHERE disp5 IS NOT NULL AND clv IS NOT NULL), bw AS (SELECT *, 0 AS fold, true AS train FROM al WHERE research_partition = 'Development'), {_FIT.replace('su AS', 'sv AS').replace('sr AS', 'sw AS').replace('FROM bf', 'FROM bw').replace('FROM su)', 'FROM sv)')}, fv AS (SELECT *, {_COEF} FROM sw, ch),
v AS (SELECT trade_date, round({_PREDICT}, 6) AS prediction, round(disp5, 6) AS anchor, round(y_4, 6) AS y FROM al, fv WHERE research_partition = 'Validation'),
k AS (SELECT trade_date, {rank('prediction', 'trade_date')} AS rp, {rank('anchor', 'trade_date')} AS ra, {rank('y', 'trade_date')} AS ry FROM v),
g AS (SELECT {_corr('rp', 'ry')} AS model, {_corr('ra', 'ry')} AS anchor FROM k GROUP BY trade_date HAVING count(*) >= 10),
o AS (SELECT count(model) AS days, avg(model) AS model, avg(anchor) AS anchor FROM g),
w AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT coalesce(mean_ic > 0.02, false) THEN 'oof' END, CASE WHEN NOT coalesce(days >= 3, false) THEN 'days' END, CASE WHEN NOT coalesce(sign(model) = sign(mean_ic), false) THEN 'sign' END, CASE WHEN NOT coalesce(model > anchor, false) THEN 'beats_anchor' END], lambda x: x IS NOT NULL), ',') AS failures FROM o, ch)
SELECT pen AS penalty, {r('mean_ic', 5)} AS oof_ic, days, {r('model', 5)} AS model, {r('anchor', 5)} AS anchor, failures, failures = '' AS published FROM w""",
    "verdict_gates": f"""{_EV}, j AS ({_ROUNDED}), {_screen('j', NAMES, (4,))}, w AS (SELECT feature, entry_session, max(dates) FILTER (research_partition = 'Development') AS dd, max(round(mean_ic, 9)) FILTER (research_partition = 'Development') AS di, max(round(mean_ic, 9)) FILTER (research_partition = 'Validation') AS vi FROM cells GROUP BY ALL),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT coalesce(dd >= 10, false) THEN 'support' END, CASE WHEN NOT coalesce(abs(di) >= 0.03, false) THEN 'size' END, CASE WHEN NOT coalesce(sign(di) = sign(vi), false) THEN 'sign' END, CASE WHEN NOT coalesce(abs(vi) >= 0.5 * abs(di), false) THEN 'retention' END], lambda g: g IS NOT NULL), ',') AS failures FROM w)
SELECT feature, entry_session, failures, CASE WHEN failures = '' THEN 'advance' WHEN failures IN ('sign', 'retention', 'sign,retention') THEN 'reject_validation' ELSE 'reject' END AS verdict FROM x""",
    "qcut_decile": f"{_EV}, z AS (SELECT research_partition, {r('disp5')} AS x, y_4 FROM ev), {_decile_edges('z', 'x', 10)} SELECT research_partition, {_DECILE('x')} AS decile, count(*) AS n, {r('avg(y_4)', 5)} AS mean_y FROM z, ed GROUP BY ALL",
    "nested_expansion": f"{_EV}, dev AS (SELECT trade_date, abs(y_8) AS size FROM ev WHERE research_partition = 'Development'), {_fold_ctes('dev')}, th AS (SELECT fold, quantile_cont(size, 0.8) AS threshold FROM bf WHERE train GROUP BY 1) SELECT fold, {r('threshold')} AS threshold, count(*) AS rows, {r('avg(CASE WHEN size >= threshold THEN 1.0 ELSE 0.0 END)')} AS share FROM bf JOIN th USING (fold) WHERE NOT train GROUP BY fold, threshold",
    "perf_sharpe": f"""{_EV}, z AS (SELECT research_partition, trade_date, {r('disp5')} AS x, y_4 AS y FROM ev), ed AS (SELECT quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM z WHERE research_partition = 'Development'),
d AS (SELECT research_partition, trade_date, avg(y) FILTER (x > hi) AS top, avg(y) FILTER (x <= lo) AS bottom FROM z, ed WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (x > hi) >= 2 AND count(*) FILTER (x <= lo) >= 2)
SELECT research_partition, count(*) AS days, {r('avg(top - bottom)', 5)} AS mean_spread, {r('avg(top - bottom) / nullif(stddev_samp(top - bottom), 0) * sqrt(252.0)', 4)} AS sharpe FROM d GROUP BY 1""",
    "overlap_audit": f"{_F}, q AS (SELECT {', '.join(f'round({n}, 6) AS {n}' for n in ('bps5', 'disp5', 'rv15', 'rv30', 'atr5', 'atr20'))} FROM f), o AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS existing, count(*) AS n, {_corr('a', 'b')} AS rho, count(*) FILTER (a = b) AS equal FROM (SELECT {a} AS a, {b} AS b FROM q WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a in ("bps5", "rv15", "atr5") for b in ("disp5", "rv30", "atr20", "atr5"))
    + f") SELECT feature, existing, n, {r('rho')} AS rho, equal, coalesce(abs(rho) >= 0.98 OR equal = n, false) AS near_duplicate FROM o",
    "vol_anchor": f"{_F} SELECT product, bar_id, {', '.join(f'{r(f"1e4 * (atr20 / nullif(close, 0)) * sqrt({h / 20.0})", 4)} AS anchor_{h}' for h in (4, 8, 20))} FROM f WHERE atr20 IS NOT NULL",
    "edge_day": f"{_F}, q AS (SELECT * FROM f WHERE trade_date = DATE '2024-01-10'), u AS (" + " UNION ALL ".join(f"SELECT bar_id, '{n}' AS feature, CAST({n} AS DOUBLE) AS value, run_position < {k} AS early, {'rng = 0' if n == 'clv' else 'false'} AS flat FROM q" for n, k in {"disp5": 20, "relvol20": 20, "rv15": 16, "clv": 1}.items())
    + f") SELECT bar_id, feature, {r('value')} AS value, CASE WHEN value IS NOT NULL THEN NULL WHEN early THEN 'warm_up' WHEN flat THEN 'no_range' ELSE 'undefined' END AS cause FROM u",
    "day_levels": f"""{_F}, dy AS (SELECT product, trade_date, max(high) AS h, min(low) AS l, arg_max(close, bar_id) AS cl FROM f GROUP BY ALL), pv_ AS (SELECT product, trade_date, lag(h) OVER w AS previous_high, lag(l) OVER w AS previous_low, lag(cl) OVER w AS previous_close FROM dy WINDOW w AS (PARTITION BY product ORDER BY trade_date)),
q AS (SELECT *, first(open) OVER d AS day_open, max(high) OVER d AS day_high, min(low) OVER d AS day_low, sum(pv) OVER d / nullif(sum(volume) OVER d, 0) AS day_vwap, {sql.roll('avg', 'close', 20)} AS sma20, {sql.roll('avg', 'close', 50)} AS sma50,
  abs(close - lag(close, 15) OVER o) / nullif({sql.roll('sum', 'adc', 15)}, 0) AS efficiency, round(atr20, 6) AS vol FROM f {sql.windows(15, 20, 50)}, d AS (PARTITION BY product, trade_date ORDER BY bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), {_decile_edges('q', 'vol', 4)}
SELECT q.product, bar_id, {_SHOWN(('day_open', 'day_high', 'day_low', 'day_vwap', 'previous_high', 'previous_low', 'previous_close', 'efficiency'))}, CASE WHEN sma20 IS NULL OR sma50 IS NULL THEN NULL WHEN sma20 > sma50 THEN 'up' WHEN sma20 < sma50 THEN 'down' ELSE 'flat' END AS trend, {_DECILE('vol')} AS vol_quartile FROM q JOIN pv_ USING (product, trade_date), ed""",
    "interactions_poi": f"{_F} SELECT product, bar_id, " + ", ".join(f"{r(f'{a} * {b}')} AS {a}_x_{b}" for a, b in (("disp5", "relvol20"), ("disp15", "relvol20"), ("disp5", "clv"), ("disp15", "clv"), ("clv", "relvol20"), ("disp5", "disp30"), ("rv15", "relvol20"), ("disp30", "clv"))) + " FROM f",
    "interactions_fes": f"{_F}, h AS (SELECT *, CASE WHEN relvol20 IS NOT NULL THEN greatest(0.5, least(2.0, relvol20)) END AS held FROM f) SELECT product, bar_id, " + ", ".join(f"{r(f'{a} * held')} AS {a}_x_held_volume" for a in ("disp5", "disp15", "clv", "bps5")) + " FROM h",
    "feature_gates": f"WITH {sql.bars()}, mx AS ({MATRIX_SQL}), j AS (SELECT mx.*, run_position FROM mx JOIN bars USING (product, bar_id)), g AS (" + " UNION ALL ".join(f"SELECT '{n}' AS gate, CAST({x} AS BIGINT) AS failures FROM j" for n, x in _GATES) + ") SELECT gate, failures, failures = 0 AS passed FROM g",
}
