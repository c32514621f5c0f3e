"""Queries of the feature families over 15-minute event bars, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.windows import let
from tidebars.operators import features as f
from tidebars.plans import sql
from tidebars.plans.sql import corr, pick, roll, rounded, slope, windows
from tidebars.sources.bars import TICK, event_bars

KEYS = ("product", "bar_ts", "bar_id")


def family(columns: Callable[[], dict], digits: int = 6) -> sql.Query:
    """A family of plain columns over the prepared bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = f.prepared(event_bars(spark, sf_dir))
        own = columns()
        bars = bars.withColumns({f"x_{name}": x for name, x in own.items()})
        kinds = dict(bars.dtypes)
        return bars.select(*KEYS, *[F.col(f"x_{n}").cast("int").alias(n) if kinds[f"x_{n}"] in ("boolean", "int") else rounded(f"x_{n}", digits).alias(n) for n in own])

    return run


def derived(build: Callable[[DataFrame], DataFrame], names: tuple[str, ...], digits: int = 6, plain: tuple[str, ...] = ()) -> sql.Query:
    """A family that adds its columns to the prepared bars itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = build(f.prepared(event_bars(spark, sf_dir)))
        return bars.select(*KEYS, *[F.col(n) if n in plain else rounded(n, digits).alias(n) for n in names])

    return run


def bars15_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir).select("product", "bar_ts", "bar_id", "open", "high", "low", "close", "volume")


def bars60_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, 60, True).select("product", "bar_ts", "bar_id", "open", "high", "low", "close", "volume")


def continuity_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, 60, True).select("product", "bar_ts", F.col("run_no").cast("long"), F.col("run_position").cast("long"), F.col("boundary_reason").cast("int"), "segment", "session", "research_partition")


def run_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, 60, True).groupBy("product", F.col("boundary_reason").cast("int").alias("boundary_reason")).agg(F.count("*").alias("bars"), F.count_distinct("run_id").alias("runs"))


def rolling_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = f.prepared(event_bars(spark, sf_dir))
    return bars.select(*KEYS, rounded("atr20").alias("atr_20"), rounded("disp5").alias("return_5_atr"))


VWAP = ("distance_from_rolling_vwap_20_atr", "distance_from_rolling_vwap_60_atr", "distance_from_research_day_vwap_atr", "vwap_slope_5_atr", "vwap_slope_15_atr", "fraction_above_vwap_15")
SESSION = ("distance_from_execution_session_vwap_atr", "distance_from_session_open_atr", "session_range_position", "session_range_over_atr")
TREND = ("efficiency_ratio_15", "efficiency_ratio_30", "efficiency_ratio_60", "normalized_ols_slope_15", "normalized_ols_slope_30", "normalized_ols_slope_60", "ols_r_squared_30", "directional_persistence_15", "return_autocorrelation_15", "return_sign_change_rate_30", "choppiness_14")
EXPERIMENTAL = ("directional_energy_balance_15_exp", "wick_pressure_balance_10_exp", "liquidity_vacuum_score_exp", "pullback_tension_5_30_exp", "vwap_elasticity_30_exp")
MLAT = (
    "bollinger_zscore_20", "bollinger_bandwidth_20", "cutler_rsi_14", "chaikin_money_flow_20", "amihud_illiquidity_60", "parkinson_volatility_30", "rogers_satchell_volatility_30", "realized_semivariance_balance_60",
    "bipower_jump_ratio_60", "variance_ratio_60_5", "return_sign_entropy_60", "volatility_of_volatility_60",
)
FES = ("trimmed_mean_30", "mad_30", "tail_balance_30", "outlier_fraction_30", "curvature_31", "draw_balance_31", "volume_slope_30")
TSAY = ("roll_spread_ticks", "zero_fraction_60", "expected_shortfall_60", "tail_balance_60", "lead_impulse")


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = f.clock(event_bars(spark, sf_dir))
    whole = ("minute_from_execution_window_open", "minutes_to_noon_entry_cutoff", "minutes_to_1530_forced_exit", "new_york_minute_of_day")
    return bars.select(*KEYS, "entry_session", *[F.col(n).cast("int").alias(n) for n in whole], *[rounded(n).alias(n) for n in ("session_progress_fraction", "time_of_day_sin", "time_of_day_cos")], "day_of_week")


def tod_loo_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = f.tod_reference(event_bars(spark, sf_dir), min_obs=8, min_dates=8)
    return bars.select(*KEYS, F.col("n_ref").cast("long").alias("n_ref"), rounded("tod_log_volume_z").alias("tod_log_volume_z"), rounded("tod_relative_volume").alias("tod_relative_volume"))


def clock_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = f.clock_adjusted(event_bars(spark, sf_dir), min_obs=20, min_dates=5)
    return bars.select(*KEYS, rounded("clock_z").alias("clock_z"))


def profile_p0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's 30 lags of each channel as rows (lag 0 newest)."""
    bars = f.profile(f.prepared(event_bars(spark, sf_dir))).where("p_ret IS NOT NULL AND p_range IS NOT NULL")
    rows = bars.select(*KEYS, F.posexplode(F.arrays_zip(F.col("p_ret").alias("r"), F.col("p_range").alias("t"))).alias("pos", "x"))
    return rows.select(*KEYS, (29 - F.col("pos")).cast("int").alias("lag"), rounded(F.col("x.r")).alias("ret_bps"), rounded(F.col("x.t")).alias("range_atr"))


def profile_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust z-scores (P1), their first differences (P2) and trailing medians (P3), as sums over lags."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    stages = let(f.p1_robust(F.col("p_ret")), lambda p: F.when(p.isNotNull(), F.struct(add(p).alias("p1"), add(f.p2_difference(p)).alias("p2"), add(f.p3_median(p)).alias("p3"))))
    bars = f.profile(f.prepared(event_bars(spark, sf_dir))).withColumn("e", stages).where("e IS NOT NULL")
    return bars.select(*KEYS, *[rounded(F.col(f"e.p{i}"), 5).alias(f"p{i}_energy") for i in (1, 2, 3)])


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rolling families in one plan: one exchange and one sort by run serve every window on runs."""
    bars = f.prepared(event_bars(spark, sf_dir))
    own = f.returns() | f.momentum() | f.volatility() | f.candles() | f.volume()
    bars = f.trend(f.compression_age(f.streak(f.experimental(f.session_state(f.vwap_state(bars.withColumns({f"x_{n}": x for n, x in own.items()})))))))
    kinds = dict(bars.dtypes)
    own_names = [F.col(f"x_{n}").cast("int").alias(n) if kinds[f"x_{n}"] == "boolean" else rounded(f"x_{n}", 4).alias(n) for n in own]
    rest = [*VWAP, *SESSION, *TREND, *EXPERIMENTAL]
    return bars.select(*KEYS, *own_names, *[rounded(n, 4).alias(n) for n in rest], "directional_streak", F.col("compression_age_exp").cast("int").alias("compression_age_exp"))


QUERIES: dict[str, sql.Query] = {
    "bars15_ohlcv": bars15_ohlcv,
    "bars60_by_type": bars60_by_type,
    "continuity_run": continuity_run,
    "run_reasons": run_reasons,
    "rolling_atr": rolling_atr,
    "returns_family": family(f.returns, 4),
    "momentum_family": family(f.momentum, 4),
    "realized_vol_family": family(f.volatility, 4),
    "candle_geometry": family(f.candles),
    "volume_family": family(f.volume),
    "vwap_day": derived(f.vwap_state, VWAP),
    "session_state": derived(f.session_state, SESSION),
    "trend_family": derived(f.trend, TREND),
    "streak": derived(f.streak, ("directional_streak",), plain=("directional_streak",)),
    "compression_age": derived(f.compression_age, ("compression_age_exp",), plain=("compression_age_exp",)),
    "experimental_family": derived(lambda b: f.experimental(f.vwap_state(b)), EXPERIMENTAL),
    "clock_family": clock,
    "tod_loo_reference": tod_loo_reference,
    "clock_adjust": clock_adjust,
    "mlat_family": derived(f.mlat, MLAT, 4),
    "fes_family": derived(f.fes, FES),
    "fes_acf_energy": derived(f.acf_energy, ("acf_energy_60",)),
    "fes_spearman": derived(f.spearman_profiles, ("spearman_ret_volume_30",)),
    "tsay_family": derived(f.tsay, TSAY),
    "profile_p0": profile_p0,
    "profile_stages": profile_stages,
    "feature_matrix": feature_matrix,
}

K = "product, bar_ts, bar_id"
_F = "WITH " + sql.features()
_BPS = {f"return_{h}m_bps": f"bps{h}" for h in (1, 5, 15, 30, 60)} | {f"return_{h}m_atr": f"disp{h}" for h in (5, 15, 30, 60)}


def _place(n: int) -> str:
    low, high = roll("min", "low", n), roll("max", "high", n)
    return f"(close - ({low})) / nullif(({high}) - ({low}), 0)"


_MOMENTUM = {
    "absolute_return_1m_atr": "adc / nullif(atr20, 0)",
    "momentum_acceleration_5_15": "bps5 / 5 - bps15 / 15",
    "momentum_acceleration_15_30": "bps15 / 15 - bps30 / 30",
    "rolling_range_position_15": _place(15),
    "rolling_range_position_60": _place(60),
    "momentum_alignment_5_30": "CAST(bps5 * bps30 > 0 AS INTEGER)",
}
_VOL = {f"atr_{n}": f"atr{n}" for n in (5, 20, 60)} | {
    "atr_ratio_5_20": "atr5 / nullif(atr20, 0)",
    "atr_ratio_20_60": "atr20 / nullif(atr60, 0)",
    **{f"realized_volatility_{n}": f"rv{n}" for n in (5, 15, 30, 60)},
    "realized_volatility_ratio_5_30": "rv5 / nullif(rv30, 0)",
    "realized_volatility_ratio_15_60": "rv15 / nullif(rv60, 0)",
    "current_range_over_atr": "rng / nullif(atr20, 0)",
    "range_compression_ratio_5_30": "atr5 / nullif(atr30, 0)",
}
_CANDLES = {
    "signed_body_atr": "body / nullif(atr20, 0)",
    "body_to_range": "abs(body) / nullif(rng, 0)",
    "upper_wick_to_range": "upper_ / nullif(rng, 0)",
    "lower_wick_to_range": "lower_ / nullif(rng, 0)",
    "close_location_value": "clv",
    "inside_bar": "CAST(high <= lag(high) OVER o AND low >= lag(low) OVER o AS INTEGER)",
    "outside_bar": "CAST(high >= lag(high) OVER o AND low <= lag(low) OVER o AS INTEGER)",
    "range_relative_to_previous_bar": "rng / nullif(lag(rng) OVER o, 0)",
    "two_bar_directional_balance": f"({roll('sum', 'dc', 2)}) / nullif({roll('sum', 'adc', 2)}, 0)",
    "three_bar_directional_balance": f"({roll('sum', 'dc', 3)}) / nullif({roll('sum', 'adc', 3)}, 0)",
}
_VOLUME = {
    "log_volume": "logv",
    "relative_volume_20": "relvol20",
    "relative_volume_60": "relvol60",
    "volume_zscore_60": f"(logv - ({roll('avg', 'logv', 60)})) / nullif({roll('stddev_pop', 'logv', 60)}, 0)",
    "volume_acceleration_5_20": "vmean5 / nullif(vmean20, 0)",
    "volume_per_tick_range": f"volume / nullif(rng / {TICK}, 0)",
    "signed_volume_proxy": "clv * relvol20",
    "volume_price_alignment_10": corr("ret", "logv", "w10", 10),
}
_DAY = sql.islands("f", "CAST(bar_ts - INTERVAL 1 HOUR AS DATE)", "day_group", "g0") + f""",
g1 AS (SELECT *, sum(pv) OVER d / nullif(sum(volume) OVER d, 0) AS day_vwap FROM g0 WINDOW d AS (PARTITION BY day_group ORDER BY bar_id)),
g AS (SELECT *, (close - day_vwap) / nullif(atr20, 0) AS day_distance, CASE WHEN day_vwap IS NOT NULL THEN CASE WHEN close > day_vwap THEN 1.0 ELSE 0.0 END END AS above FROM g1)"""
_DAY_W = windows(20, 60) + ", d AS (PARTITION BY day_group ORDER BY bar_id), d15 AS (PARTITION BY day_group ORDER BY bar_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), d30 AS (PARTITION BY day_group ORDER BY bar_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), w15 AS (PARTITION BY run_id ORDER BY bar_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY run_id ORDER BY bar_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_VWAP = {f"distance_from_rolling_vwap_{n}_atr": f"(close - ({roll('sum', 'pv', n)}) / nullif({roll('sum', 'volume', n)}, 0)) / nullif(atr20, 0)" for n in (20, 60)} | {
    "distance_from_research_day_vwap_atr": "day_distance",
    **{f"vwap_slope_{n}_atr": f"(day_vwap - lag(day_vwap, {n}) OVER d) / nullif(atr20, 0)" for n in (5, 15)},
    "fraction_above_vwap_15": "CASE WHEN count(above) OVER d15 = 15 THEN avg(above) OVER d15 END",
}
_CODE = "CASE WHEN minute_of_day BETWEEN 180 AND 359 THEN 1 WHEN minute_of_day BETWEEN 420 AND 719 THEN 2 ELSE 0 END"
_SESSION = sql.islands("f", f"trade_date || '/' || ({_CODE})", "session_group", "s0") + f""",
s AS (SELECT *, CASE WHEN ({_CODE}) > 0 THEN sum(pv) OVER d / nullif(sum(volume) OVER d, 0) END AS s_vwap, CASE WHEN ({_CODE}) > 0 THEN first(open) OVER d END AS s_open,
      CASE WHEN ({_CODE}) > 0 THEN max(high) OVER d END AS s_high, CASE WHEN ({_CODE}) > 0 THEN min(low) OVER d END AS s_low FROM s0 WINDOW d AS (PARTITION BY session_group ORDER BY bar_id))"""
_SESSION_COLUMNS = {
    "distance_from_execution_session_vwap_atr": "(close - s_vwap) / nullif(atr20, 0)",
    "distance_from_session_open_atr": "(close - s_open) / nullif(atr20, 0)",
    "session_range_position": "(close - s_low) / nullif(s_high - s_low, 0)",
    "session_range_over_atr": "(s_high - s_low) / nullif(atr20, 0)",
}
_TREND_CTE = f"""t1 AS (SELECT *, sign(dc) AS sgn, lag(ret) OVER o AS ret_before, CAST(bar_id AS DOUBLE) AS bar FROM f {windows()}),
t AS (SELECT *, CASE WHEN lag(sgn) OVER o IS NOT NULL THEN CASE WHEN sgn <> lag(sgn) OVER o THEN 1.0 ELSE 0.0 END END AS flip FROM t1 {windows()})"""


def _clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def _efficiency(n: int) -> str:
    return _clip(f"abs(close - lag(close, {n}) OVER o) / nullif({roll('sum', 'adc', n)}, 0)", 0.0, 1.0)


_CHOP = f"({roll('sum', 'tr', 14)}) / nullif(({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}), 0)"
_TREND = {f"efficiency_ratio_{n}": _efficiency(n) for n in (15, 30, 60)} | {f"normalized_ols_slope_{n}": f"({slope('close', 'bar', f'w{n}', n)}) / nullif(atr20, 0)" for n in (15, 30, 60)} | {
    "ols_r_squared_30": f"pow({corr('close', 'bar', 'w30', 30)}, 2)",
    "directional_persistence_15": f"abs({roll('sum', 'sgn', 15)}) / 15",
    "return_autocorrelation_15": corr("ret", "ret_before", "w14", 14),
    "return_sign_change_rate_30": roll("avg", "flip", 29),
    "choppiness_14": _clip(f"100 * log10(CASE WHEN ({_CHOP}) > 0 THEN {_CHOP} END) / {math.log10(14)!r}", 0.0, 100.0),
}
_STREAK = sql.islands("f", "sign(dc)", "sign_group", "k")
_SQUEEZE = "rv5 / nullif(rv30, 0) < 0.70 AND atr5 / nullif(atr30, 0) < 0.75"
_AGE = sql.islands("f", _SQUEEZE, "squeeze_group", "k")
_EXP_CTE = f"""e1 AS (SELECT *, {_clip("relvol20", 0.5, 2.0)} AS w FROM g),
e2 AS (SELECT *, r2 * w AS energy, sign(ret) * r2 * w AS signed_energy, CASE WHEN rng > 0 THEN (lower_ - upper_) / rng ELSE 0.0 END * w AS wick, ret * 1e4 AS bps, lag(day_distance) OVER (PARTITION BY day_group ORDER BY bar_id) AS distance_before FROM e1)"""
_EXP = {
    "directional_energy_balance_15_exp": f"({roll('sum', 'signed_energy', 15)}) / nullif({roll('sum', 'energy', 15)}, 0)",
    "wick_pressure_balance_10_exp": f"({roll('sum', 'wick', 10)}) / nullif({roll('sum', 'w', 10)}, 0)",
    "liquidity_vacuum_score_exp": "rng / nullif(atr20, 0) * abs(clv) / sqrt(CASE WHEN relvol20 IS NOT NULL THEN greatest(relvol20, 0.25) ELSE 0.25 END)",
    "pullback_tension_5_30_exp": "CASE WHEN disp5 IS NOT NULL AND disp30 IS NOT NULL THEN CASE WHEN disp5 * disp30 < 0 THEN sign(disp30) * least(abs(disp5), abs(disp30)) ELSE 0.0 END END",
    "vwap_elasticity_30_exp": slope("bps", "distance_before", "d30", 30),
}
_MLAT_CTE = f"""m AS (SELECT *, CASE WHEN dc IS NOT NULL THEN greatest(dc, 0.0) END AS gain, CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0.0) END AS loss,
  CASE WHEN rng = 0 THEN 0.0 ELSE clv END * volume AS mfv, abs(ret) / nullif(close * volume, 0) AS amihud, pow({sql.log_ratio('high', 'low')}, 2) AS pk,
  ({sql.log_ratio('high', 'open')}) * ({sql.log_ratio('high', 'close')}) + ({sql.log_ratio('low', 'open')}) * ({sql.log_ratio('low', 'close')}) AS rs, CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN r2 ELSE 0.0 END END AS up,
  CASE WHEN ret IS NOT NULL THEN CASE WHEN ret < 0 THEN r2 ELSE 0.0 END END AS down, abs(ret) * abs(lag(ret) OVER o) AS bip, {roll('sum', 'ret', 5)} AS ret5, 1e4 * sqrt({roll('avg', 'r2', 15)}) AS rvol15,
  CAST(ret < 0 AS DOUBLE) AS neg, CAST(ret = 0 AS DOUBLE) AS zero, CAST(ret > 0 AS DOUBLE) AS pos FROM f {windows(5, 15)})"""


def _plogp(x: str) -> str:
    p = f"(({roll('sum', x, 60)}) / 60)"
    return f"CASE WHEN {p} > 0 THEN {p} * ln({p}) WHEN {p} IS NOT NULL THEN 0.0 END"


_RS = roll("avg", "rs", 30)
_BPV = f"{math.pi / 2 * 60 / 59!r} * ({roll('sum', 'bip', 60)})"
_RV60 = f"({roll('sum', 'r2', 60)})"
_MLAT = {
    "bollinger_zscore_20": f"(close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_pop', 'close', 20)}, 0)",
    "bollinger_bandwidth_20": f"4 * ({roll('stddev_pop', 'close', 20)}) / nullif({roll('avg', 'close', 20)}, 0)",
    "cutler_rsi_14": f"100 * ({roll('sum', 'gain', 14)}) / nullif(({roll('sum', 'gain', 14)}) + ({roll('sum', 'loss', 14)}), 0)",
    "chaikin_money_flow_20": f"({roll('sum', 'mfv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0)",
    "amihud_illiquidity_60": f"1e9 * ({roll('avg', 'amihud', 60)})",
    "parkinson_volatility_30": f"1e4 * sqrt(({roll('avg', 'pk', 30)}) / {4 * math.log(2)!r})",
    "rogers_satchell_volatility_30": f"1e4 * sqrt(CASE WHEN ({_RS}) >= -1e-12 THEN greatest({_RS}, 0.0) END)",
    "realized_semivariance_balance_60": f"(({roll('sum', 'up', 60)}) - ({roll('sum', 'down', 60)})) / nullif(({roll('sum', 'up', 60)}) + ({roll('sum', 'down', 60)}), 0)",
    "bipower_jump_ratio_60": _clip(f"CASE WHEN ({_BPV}) IS NOT NULL THEN greatest({_RV60} - {_BPV}, 0.0) END / nullif({_RV60}, 0)", 0.0, 1.0),
    "variance_ratio_60_5": f"({roll('var_pop', 'ret5', 60)}) / nullif(5 * ({roll('var_pop', 'ret', 60)}), 0)",
    "return_sign_entropy_60": f"-({_plogp('neg')} + {_plogp('zero')} + {_plogp('pos')}) / {math.log(3)!r}",
    "volatility_of_volatility_60": f"({roll('stddev_pop', 'rvol15', 60)}) / nullif({roll('avg', 'rvol15', 60)}, 0)",
}


def _list(x: str, n: int, w: str) -> str:
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN list({x}) OVER {w} END"


def _dot(a: str, weights: list[float]) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: ({a})[i] * ([{', '.join(repr(w) for w in weights)}])[i]))"


_FES_CTE = f"""h0 AS (SELECT *, ret * 1e4 AS c_ret, tr / nullif(atr20, 0) AS c_range, (logv - ({roll('avg', 'logv', 60)})) / nullif({roll('stddev_pop', 'logv', 60)}, 0) AS c_volume FROM f {windows(60)}),
h1 AS (SELECT *, {_list('c_ret', 30, 'w30')} AS a, {_list('close', 31, 'w31')} AS cl, {_list('c_volume', 30, 'w30')} AS av, {_list('c_range', 30, 'w30')} AS ar FROM h0 {windows(30, 31)}),
h2 AS (SELECT *, list_aggregate(a, 'median') AS med, list_aggregate(a, 'quantile_cont', 0.1) AS q10, list_aggregate(a, 'quantile_cont', 0.9) AS q90 FROM h1),
h3 AS (SELECT *, {f.MAD_SCALE} * list_aggregate(list_transform(a, lambda x: abs(x - med)), 'median') AS mad,
  list_max(list_transform(range(1, 32), lambda i: cl[i] - list_min(cl[1:i]))) AS up_, list_max(list_transform(range(1, 32), lambda i: list_max(cl[1:i]) - cl[i])) AS dn_ FROM h2)"""
_FES = {
    "trimmed_mean_30": "list_avg(list_sort(a)[4:27])",
    "mad_30": "mad",
    "tail_balance_30": "CASE WHEN abs(q90) + abs(q10) = 0 THEN 0.0 ELSE (abs(q90) - abs(q10)) / (abs(q90) + abs(q10)) END",
    "outlier_fraction_30": "CASE WHEN mad = 0 THEN 0.0 WHEN a IS NOT NULL THEN len(list_filter(a, lambda x: abs(x - med) > 3 * mad)) / 30.0 END",
    "curvature_31": f"CASE WHEN cl IS NOT NULL THEN {_dot('list_transform(cl, lambda x: x - cl[1])', f.quadratic_weights(31))} END / nullif(atr20, 0)",
    "draw_balance_31": "CASE WHEN cl IS NULL THEN NULL WHEN up_ + dn_ = 0 THEN 0.0 ELSE (up_ - dn_) / (up_ + dn_) END",
    "volume_slope_30": f"CASE WHEN av IS NOT NULL THEN {_dot('av', f.slope_weights(30))} END",
}
_RHO_W = windows(60, *range(55, 60))
_ACF_CTE = f"""a1 AS (SELECT *, {", ".join(f"lag(ret, {k}) OVER o AS ret_l{k}" for k in range(1, 6))} FROM f {windows()}),
a2 AS (SELECT *, {", ".join(f"CASE WHEN count(ret) OVER w60 = 60 THEN {corr('ret', f'ret_l{k}', f'w{60 - k}', 60 - k)} END AS rho{k}" for k in range(1, 6))} FROM a1 {_RHO_W})"""
_RANK = "list_transform({a}, lambda x: len(list_filter({a}, lambda y: y < x)) + (len(list_filter({a}, lambda y: y = x)) + 1) / 2.0)"
_SPEARMAN_CTE = f"""{_FES_CTE},
u0 AS (SELECT * REPLACE (list_transform(a, lambda x: round(x, 9)) AS a, list_transform(av, lambda x: round(x, 9)) AS av) FROM h1),
u AS (SELECT *, {_RANK.format(a="a")} AS kr, {_RANK.format(a="av")} AS kv FROM u0),
u2 AS (SELECT product, bar_ts, bar_id, unnest(kr) AS x, unnest(kv) AS y FROM u WHERE a IS NOT NULL AND av IS NOT NULL AND len(list_distinct(a)) >= 6 AND len(list_distinct(av)) >= 6),
u3 AS (SELECT product, bar_ts, bar_id, corr(x, y) AS rho FROM u2 GROUP BY ALL)"""
_TSAY_CTE = f"""y1 AS (SELECT *, lag(dc) OVER o AS dc_before, CASE WHEN dc IS NOT NULL THEN CAST(dc = 0 AS DOUBLE) END AS still, (logv - ({roll('avg', 'logv', 60)})) / nullif({roll('stddev_pop', 'logv', 60)}, 0) AS zvol FROM f {windows(60)}),
y2 AS (SELECT *, dc * dc_before AS pair, {", ".join(f"lag(zvol, {k}) OVER o AS zvol_l{k}" for k in range(1, 6))} FROM y1 {windows()}),
y3 AS (SELECT *, ({roll('avg', 'pair', 59)}) - ({roll('avg', 'dc', 59)}) * ({roll('avg', 'dc_before', 59)}) AS gamma, list_sort({_list('dc', 60, 'w60')}) AS s, {", ".join(f"{corr('ret', f'zvol_l{k}', 'w40', 40)} AS lead{k}" for k in range(1, 6))} FROM y2 {windows(40, 59, 60)}),
y4 AS (SELECT *, -list_avg(s[1:6]) AS es, list_avg(s[55:60]) AS gain_tail FROM y3)"""
_TSAY = {
    "roll_spread_ticks": f"CASE WHEN gamma < 0 THEN 2 * sqrt(-gamma) / {TICK} WHEN gamma IS NOT NULL THEN 0.0 END",
    "zero_fraction_60": roll("avg", "still", 60),
    "expected_shortfall_60": "es",
    "tail_balance_60": "CASE WHEN abs(gain_tail) + abs(es) = 0 THEN 0.0 ELSE (gain_tail - es) / (abs(gain_tail) + abs(es)) END",
    "lead_impulse": "(lead1 + lead2 + lead3 + lead4 + lead5) / 5 * zvol",
}


def _digits(columns: dict[str, str], n: int) -> dict[str, int]:
    return dict.fromkeys(columns, n)


_TOD = """
WITH {bars},
x AS (SELECT *, floor(minute_of_day / 15) AS bin, ln(1 + volume) AS x FROM bars WHERE session IS NOT NULL),
d AS (SELECT session, bin, trade_date, count(x) AS nd, sum(x) AS sd, sum(x * x) AS qd FROM x WHERE research_partition = 'Development' GROUP BY ALL),
t AS (SELECT session, bin, sum(nd) AS n, sum(sd) AS s, sum(qd) AS q, count(*) AS dates FROM d GROUP BY ALL),
j AS (SELECT x.*, t.n - coalesce(d.nd, 0) AS n_ref, t.dates - CASE WHEN d.nd IS NULL THEN 0 ELSE 1 END AS dates_ref, (t.s - coalesce(d.sd, 0)) / nullif(t.n - coalesce(d.nd, 0), 0) AS m, (t.q - coalesce(d.qd, 0)) / nullif(t.n - coalesce(d.nd, 0), 0) AS m2
      FROM x LEFT JOIN t USING (session, bin) LEFT JOIN d ON d.session = x.session AND d.bin = x.bin AND d.trade_date = x.trade_date),
k AS (SELECT *, sqrt(greatest(m2 - m * m, 0.0)) AS sd_ref, n_ref >= 8 AND dates_ref >= 8 AS enough FROM j)
SELECT product, bar_ts, bar_id, CAST(n_ref AS BIGINT) AS n_ref, round(CASE WHEN enough AND sd_ref > 1e-6 THEN (x - m) / sd_ref END, 6) + 0.0 AS tod_log_volume_z,
       round(CASE WHEN enough THEN exp(x - m) END, 6) + 0.0 AS tod_relative_volume FROM k
"""
_ADJUST = """
WITH {bars},
x AS (SELECT *, floor(minute_of_day / 60) AS bin, ln(1 + volume) AS x, research_partition = 'Development' AS dev FROM bars),
d AS (SELECT bin, trade_date, count(x) AS nd, sum(x) AS sd, sum(x * x) AS qd FROM x WHERE dev GROUP BY ALL),
p AS (SELECT bin, trade_date, coalesce(sum(nd) OVER e, 0) AS n1, coalesce(sum(sd) OVER e, 0) AS s1, coalesce(sum(qd) OVER e, 0) AS q1, count(*) OVER e AS d1 FROM d WINDOW e AS (PARTITION BY bin ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT bin, sum(nd) AS n2, sum(sd) AS s2, sum(qd) AS q2, count(*) AS d2 FROM d GROUP BY bin),
j AS (SELECT x.*, CASE WHEN dev THEN n1 ELSE n2 END AS n_ref, CASE WHEN dev THEN d1 ELSE d2 END AS dates_ref, CASE WHEN dev THEN s1 ELSE s2 END AS s, CASE WHEN dev THEN q1 ELSE q2 END AS q
      FROM x LEFT JOIN p ON p.bin = x.bin AND p.trade_date = x.trade_date LEFT JOIN t ON t.bin = x.bin),
k AS (SELECT *, s / nullif(n_ref, 0) AS m, sqrt(greatest(q / nullif(n_ref, 0) - pow(s / nullif(n_ref, 0), 2), 0.0)) AS sd_ref FROM j)
SELECT product, bar_ts, bar_id, round(CASE WHEN n_ref >= 20 AND dates_ref >= 5 AND sd_ref > 1e-6 THEN (x - m) / sd_ref END, 6) + 0.0 AS clock_z FROM k
"""
_BOOL = ("momentum_alignment_5_30", "inside_bar", "outside_bar")
_ALL_CTE = f"{_F}, {_DAY}, {_EXP_CTE}"

ORACLE_SQL: dict[str, str] = {
    "bars15_ohlcv": f"WITH {sql.bars()} SELECT product, bar_ts, bar_id, open, high, low, close, volume FROM bars",
    "bars60_by_type": f"WITH {sql.bars(60, True)} SELECT product, bar_ts, bar_id, open, high, low, close, volume FROM bars",
    "continuity_run": f"WITH {sql.bars(60, True)} SELECT product, bar_ts, run_no, run_position, boundary_reason, segment, session, research_partition FROM bars",
    "run_reasons": f"WITH {sql.bars(60, True)} SELECT product, boundary_reason, count(*) AS bars, count(DISTINCT run_id) AS runs FROM bars GROUP BY ALL",
    "rolling_atr": f"{_F} {pick({'atr_20': 'atr20', 'return_5_atr': 'disp5'})}",
    "returns_family": f"{_F} {pick(_BPS, digits=_digits(_BPS, 4))}",
    "momentum_family": f"{_F} {pick(_MOMENTUM, window=windows(15, 60), digits=_digits(_MOMENTUM, 4), plain=_BOOL)}",
    "realized_vol_family": f"{_F} {pick(_VOL, digits=_digits(_VOL, 4))}",
    "candle_geometry": f"{_F} {pick(_CANDLES, window=windows(2, 3), plain=_BOOL)}",
    "volume_family": f"{_F} {pick(_VOLUME, window=windows(10, 60))}",
    "vwap_day": f"{_F}, {_DAY} {pick(_VWAP, 'g', _DAY_W)}",
    "session_state": f"{_F}, {_SESSION} {pick(_SESSION_COLUMNS, 's')}",
    "trend_family": f"{_F}, {_TREND_CTE} {pick(_TREND, 't', windows(14, 15, 29, 30, 60))}",
    "streak": f"{_F}, {_STREAK} SELECT {K}, CAST(sign(dc) * least(120, row_number() OVER (PARTITION BY sign_group ORDER BY bar_id)) AS INTEGER) AS directional_streak FROM k",
    "compression_age": f"{_F}, {_AGE} SELECT {K}, CAST(CASE WHEN rv30 IS NULL OR atr30 IS NULL OR rv30 = 0 OR atr30 = 0 THEN NULL WHEN {_SQUEEZE} THEN least(60, row_number() OVER (PARTITION BY squeeze_group ORDER BY bar_id)) ELSE 0 END AS INTEGER) AS compression_age_exp FROM k",
    "experimental_family": f"{_ALL_CTE} {pick(_EXP, 'e2', _DAY_W)}",
    "clock_family": f"""WITH {sql.bars()}, e AS (SELECT *, lead(bar_ts) OVER (PARTITION BY run_id ORDER BY bar_id) AS entry_ts FROM bars),
m AS (SELECT *, CAST(hour(entry_ts) * 60 + minute(entry_ts) AS INTEGER) AS em FROM e WHERE entry_ts IS NOT NULL),
s AS (SELECT *, em BETWEEN 180 AND 359 AS ldn FROM m WHERE em BETWEEN 180 AND 359 OR em BETWEEN 420 AND 719)
SELECT {K}, CASE WHEN ldn THEN 'London' ELSE 'New York' END AS entry_session, em - CASE WHEN ldn THEN 180 ELSE 420 END AS minute_from_execution_window_open, 720 - em AS minutes_to_noon_entry_cutoff,
930 - em AS minutes_to_1530_forced_exit, em AS new_york_minute_of_day, round((em - CASE WHEN ldn THEN 180 ELSE 420 END) / CASE WHEN ldn THEN 179.0 ELSE 299.0 END, 6) + 0.0 AS session_progress_fraction,
round(sin(2 * pi() * em / 1440), 6) + 0.0 AS time_of_day_sin, round(cos(2 * pi() * em / 1440), 6) + 0.0 AS time_of_day_cos, dayname(entry_ts) AS day_of_week FROM s""",
    "tod_loo_reference": _TOD.format(bars=sql.bars()),
    "clock_adjust": _ADJUST.format(bars=sql.bars()),
    "mlat_family": f"{_F}, {_MLAT_CTE} {pick(_MLAT, 'm', windows(14, 20, 30, 60), digits=_digits(_MLAT, 4))}",
    "fes_family": f"{_F}, {_FES_CTE} {pick(_FES, 'h3')}",
    "fes_acf_energy": f"{_F}, {_ACF_CTE} {pick({'acf_energy_60': 'sqrt((rho1 * rho1 + rho2 * rho2 + rho3 * rho3 + rho4 * rho4 + rho5 * rho5) / 5)'}, 'a2')}",
    "fes_spearman": f"{_F}, {_SPEARMAN_CTE} SELECT {K}, round(rho, 6) + 0.0 AS spearman_ret_volume_30 FROM f LEFT JOIN u3 USING (product, bar_ts, bar_id)",
    "tsay_family": f"{_F}, {_TSAY_CTE} {pick(_TSAY, 'y4', windows(60))}",
    "profile_p0": f"{_F}, {_FES_CTE} SELECT {K}, CAST(30 - i AS INTEGER) AS lag, round(a[i], 6) + 0.0 AS ret_bps, round(ar[i], 6) + 0.0 AS range_atr FROM h1, (SELECT unnest(range(1, 31)) AS i) WHERE a IS NOT NULL AND ar IS NOT NULL",
    "profile_stages": f"""{_F}, {_FES_CTE},
z1 AS (SELECT {K}, list_transform(a, lambda x: (x - list_avg(list_sort(a)[4:27])) / mad) AS p FROM h3 WHERE mad > 0),
z2 AS (SELECT *, list_transform(range(2, 31), lambda i: p[i] - p[i - 1]) AS d, list_transform(range(1, 31), lambda i: CASE WHEN i < 3 THEN p[i] ELSE list_aggregate(p[i - 2:i], 'median') END) AS t FROM z1)
SELECT {K}, round(list_sum(list_transform(p, lambda x: x * x)), 5) + 0.0 AS p1_energy, round(list_sum(list_transform(d, lambda x: x * x)), 5) + 0.0 AS p2_energy, round(list_sum(list_transform(t, lambda x: x * x)), 5) + 0.0 AS p3_energy FROM z2""",
}

#: The columns of feature_matrix with their SQL, family by family: CTEs, columns, source, windows, plain ones.
_MATRIX = (
    (_F, _BPS, "f", "", ()),
    (_F, _MOMENTUM, "f", windows(15, 60), _BOOL),
    (_F, _VOL, "f", "", ()),
    (_F, _CANDLES, "f", windows(2, 3), _BOOL),
    (_F, _VOLUME, "f", windows(10, 60), ()),
    (f"{_F}, {_DAY}", _VWAP, "g", _DAY_W, ()),
    (f"{_F}, {_SESSION}", _SESSION_COLUMNS, "s", "", ()),
    (f"{_F}, {_TREND_CTE}", _TREND, "t", windows(14, 15, 29, 30, 60), ()),
    (_ALL_CTE, _EXP, "e2", _DAY_W, ()),
)
MATRIX_FEATURES = [n for _, columns, _, _, _ in _MATRIX for n in columns] + ["directional_streak", "compression_age_exp"]
MATRIX_SQL = "SELECT * FROM " + " JOIN ".join(f"({cte} {pick(columns, source, window, digits=_digits(columns, 4), plain=plain)}) m{i}" + (f" USING ({K})" if i else "") for i, (cte, columns, source, window, plain) in enumerate(_MATRIX))
MATRIX_SQL += f" JOIN ({ORACLE_SQL['streak']}) ms USING ({K}) JOIN ({ORACLE_SQL['compression_age']}) ma USING ({K})"
ORACLE_SQL["feature_matrix"] = MATRIX_SQL
