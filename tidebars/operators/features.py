"""Predictors over continuity runs, in families of columns.

prepared() adds the shared primitives once; a family is a mapping of names to Columns over them. Windows of all
families have the same partitioning and order (run_id, bar_id), so Spark plans one exchange and one sort for any
number of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.windows import by_run, complete, frame, lag, let, log_ratio, log_return, rcorr, rmax, rmean, rmin, rslope, rstd, rsum, safe_div, true_range
from tidebars.sources.bars import LONDON, NEW_YORK, TICK

KEYS = ("product", "bar_ts", "bar_id", "run_id")
STREAK_CAP, AGE_CAP = 120, 60

c = F.col


def prepared(bars: DataFrame) -> DataFrame:
    """bars with returns, ranges, candle parts and volume terms, and the rolling means that several families share."""
    body_top, body_low = F.greatest("open", "close"), F.least("open", "close")
    bars = bars.withColumns(
        {
            "dc": c("close") - lag(c("close")),
            "ret": log_return(),
            "tr": true_range(),
            "rng": c("high") - c("low"),
            "body": c("close") - c("open"),
            "upper": c("high") - body_top,
            "lower": body_low - c("low"),
            "logv": F.log1p("volume"),
            "pv": (c("high") + c("low") + c("close")) / 3 * c("volume"),
            "clv": safe_div(2 * c("close") - c("high") - c("low"), c("high") - c("low")),
        }
    )
    bars = bars.withColumns({"r2": c("ret") * c("ret"), "adc": F.abs("dc")})
    own = {f"atr{n}": rmean(c("tr"), n) for n in (5, 20, 30, 60)} | {f"rv{n}": 1e4 * F.sqrt(rsum(c("r2"), n)) for n in (5, 15, 30, 60)} | {f"vmean{n}": rmean(c("volume"), n) for n in (5, 20, 60)}
    own |= {f"bps{h}": 1e4 * log_ratio(c("close"), lag(c("close"), h)) for h in (1, 5, 15, 30, 60)}
    bars = bars.withColumns(own)
    return bars.withColumns({"relvol20": safe_div(c("volume").cast("double"), c("vmean20")), "relvol60": safe_div(c("volume").cast("double"), c("vmean60"))} | {f"disp{h}": safe_div(c("close") - lag(c("close"), h), c("atr20")) for h in (5, 15, 30, 60)})


def returns() -> dict[str, Column]:
    return {f"return_{h}m_bps": c(f"bps{h}") for h in (1, 5, 15, 30, 60)} | {f"return_{h}m_atr": c(f"disp{h}") for h in (5, 15, 30, 60)}


def momentum() -> dict[str, Column]:
    def place(n: int) -> Column:
        return safe_div(c("close") - rmin(c("low"), n), rmax(c("high"), n) - rmin(c("low"), n))

    return {
        "absolute_return_1m_atr": safe_div(c("adc"), c("atr20")),
        "momentum_acceleration_5_15": c("bps5") / 5 - c("bps15") / 15,
        "momentum_acceleration_15_30": c("bps15") / 15 - c("bps30") / 30,
        "rolling_range_position_15": place(15),
        "rolling_range_position_60": place(60),
        "momentum_alignment_5_30": c("bps5") * c("bps30") > 0,
    }


def volatility() -> dict[str, Column]:
    return {f"atr_{n}": c(f"atr{n}") for n in (5, 20, 60)} | {
        "atr_ratio_5_20": safe_div(c("atr5"), c("atr20")),
        "atr_ratio_20_60": safe_div(c("atr20"), c("atr60")),
        **{f"realized_volatility_{n}": c(f"rv{n}") for n in (5, 15, 30, 60)},
        "realized_volatility_ratio_5_30": safe_div(c("rv5"), c("rv30")),
        "realized_volatility_ratio_15_60": safe_div(c("rv15"), c("rv60")),
        "current_range_over_atr": safe_div(c("rng"), c("atr20")),
        "range_compression_ratio_5_30": safe_div(c("atr5"), c("atr30")),
    }


def candles() -> dict[str, Column]:
    before_high, before_low = lag(c("high")), lag(c("low"))
    return {
        "signed_body_atr": safe_div(c("body"), c("atr20")),
        "body_to_range": safe_div(F.abs("body"), c("rng")),
        "upper_wick_to_range": safe_div(c("upper"), c("rng")),
        "lower_wick_to_range": safe_div(c("lower"), c("rng")),
        "close_location_value": c("clv"),
        "inside_bar": (c("high") <= before_high) & (c("low") >= before_low),
        "outside_bar": (c("high") >= before_high) & (c("low") <= before_low),
        "range_relative_to_previous_bar": safe_div(c("rng"), lag(c("rng"))),
        "two_bar_directional_balance": safe_div(rsum(c("dc"), 2), rsum(c("adc"), 2)),
        "three_bar_directional_balance": safe_div(rsum(c("dc"), 3), rsum(c("adc"), 3)),
    }


def volume() -> dict[str, Column]:
    return {
        "log_volume": c("logv"),
        "relative_volume_20": c("relvol20"),
        "relative_volume_60": c("relvol60"),
        "volume_zscore_60": safe_div(c("logv") - rmean(c("logv"), 60), rstd(c("logv"), 60)),
        "volume_acceleration_5_20": safe_div(c("vmean5"), c("vmean20")),
        "volume_per_tick_range": safe_div(c("volume").cast("double"), c("rng") / TICK),
        "signed_volume_proxy": c("clv") * c("relvol20"),
        "volume_price_alignment_10": rcorr(c("ret"), c("logv"), 10),
    }


def islands(bars: DataFrame, key: Column, name: str) -> DataFrame:
    """name: an id that changes whenever the run or key changes; contiguous stretches, not equal keys."""
    bars = bars.withColumn("_k", key)
    changed = ~c("_k").eqNullSafe(F.lag("_k").over(by_run())) | (c("run_position") == 0)
    bars = bars.withColumn("_new", changed.cast("int"))
    return bars.withColumn(name, F.concat_ws("/", "run_id", F.sum("_new").over(by_run().rowsBetween(Window.unboundedPreceding, 0)))).drop("_k", "_new")


def so_far(group: str) -> Window:
    return Window.partitionBy(group).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)


def vwap_state(bars: DataFrame) -> DataFrame:
    """Rolling and research-day VWAP distances, slopes and the share of closes above."""
    bars = islands(bars, F.to_date(c("bar_ts") - F.expr("INTERVAL 1 HOUR")), "day_group")
    day = Window.partitionBy("day_group").orderBy("bar_id")
    bars = bars.withColumn("day_vwap", safe_div(F.sum("pv").over(so_far("day_group")), F.sum("volume").over(so_far("day_group"))))
    bars = bars.withColumns({"day_distance": safe_div(c("close") - c("day_vwap"), c("atr20")), "above": F.when(c("day_vwap").isNotNull(), (c("close") > c("day_vwap")).cast("double"))})
    own = {f"distance_from_rolling_vwap_{n}_atr": safe_div(c("close") - safe_div(rsum(c("pv"), n), rsum(c("volume"), n)), c("atr20")) for n in (20, 60)}
    own |= {"distance_from_research_day_vwap_atr": c("day_distance")}
    own |= {f"vwap_slope_{n}_atr": safe_div(c("day_vwap") - lag(c("day_vwap"), n, day), c("atr20")) for n in (5, 15)}
    own |= {"fraction_above_vwap_15": rmean(c("above"), 15, day)}
    return bars.withColumns(own)


def session_state(bars: DataFrame) -> DataFrame:
    """Distances from the execution session's VWAP and open, and its range; NULL outside sessions."""
    code = F.when(c("minute_of_day").between(LONDON[0], LONDON[1] - 1), 1).when(c("minute_of_day").between(NEW_YORK[0], NEW_YORK[1] - 1), 2).otherwise(0)
    bars = islands(bars, F.concat_ws("/", "trade_date", code), "session_group").withColumn("in_session", code > 0)
    own = so_far("session_group")
    inside = lambda x: F.when(c("in_session"), x)
    bars = bars.withColumns(
        {"s_vwap": inside(safe_div(F.sum("pv").over(own), F.sum("volume").over(own))), "s_open": inside(F.first("open").over(own)), "s_high": inside(F.max("high").over(own)), "s_low": inside(F.min("low").over(own))}
    )
    return bars.withColumns(
        {
            "distance_from_execution_session_vwap_atr": safe_div(c("close") - c("s_vwap"), c("atr20")),
            "distance_from_session_open_atr": safe_div(c("close") - c("s_open"), c("atr20")),
            "session_range_position": safe_div(c("close") - c("s_low"), c("s_high") - c("s_low")),
            "session_range_over_atr": safe_div(c("s_high") - c("s_low"), c("atr20")),
        }
    )


def clip(x: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def trend(bars: DataFrame) -> DataFrame:
    """Efficiency, OLS slopes and fit, persistence, autocorrelation, sign changes, choppiness."""
    bars = bars.withColumns({"sgn": F.signum("dc"), "ret_before": lag(c("ret")), "bar": c("bar_id").cast("double")})
    bars = bars.withColumn("flip", F.when(lag(c("sgn")).isNotNull(), (c("sgn") != lag(c("sgn"))).cast("double")))
    own: dict[str, Column] = {}
    for n in (15, 30, 60):
        own[f"efficiency_ratio_{n}"] = clip(safe_div(F.abs(c("close") - lag(c("close"), n)), rsum(c("adc"), n)), 0.0, 1.0)
        own[f"normalized_ols_slope_{n}"] = safe_div(rslope(c("close"), c("bar"), n), c("atr20"))
    r = rcorr(c("close"), c("bar"), 30)
    own |= {
        "ols_r_squared_30": r * r,
        "directional_persistence_15": F.abs(rsum(c("sgn"), 15)) / 15,
        "return_autocorrelation_15": rcorr(c("ret"), c("ret_before"), 14),
        "return_sign_change_rate_30": rmean(c("flip"), 29),
    }
    bars = bars.withColumns(own)
    ratio = safe_div(rsum(c("tr"), 14), rmax(c("high"), 14) - rmin(c("low"), 14))
    return bars.withColumn("choppiness_14", clip(100 * F.log10(F.when(ratio > 0, ratio)) / math.log10(14), 0.0, 100.0))


def streak(bars: DataFrame) -> DataFrame:
    """directional_streak: signed length of the run of equal signs of change; zero on no change; NULL on a run's first bar."""
    bars = islands(bars, F.signum("dc"), "sign_group")
    length = F.row_number().over(Window.partitionBy("sign_group").orderBy("bar_id"))
    return bars.withColumn("directional_streak", (F.signum("dc") * F.least(F.lit(STREAK_CAP), length)).cast("int"))


def compression_age(bars: DataFrame) -> DataFrame:
    """compression_age_exp: bars the compression has lasted; zero where there is none; NULL where it can't be told."""
    rv, atr = safe_div(c("rv5"), c("rv30")), safe_div(c("atr5"), c("atr30"))
    bars = islands(bars, (rv < 0.70) & (atr < 0.75), "squeeze_group").withColumn("squeeze", (rv < 0.70) & (atr < 0.75) & rv.isNotNull() & atr.isNotNull())
    length = F.row_number().over(Window.partitionBy("squeeze_group").orderBy("bar_id"))
    known = rv.isNotNull() & atr.isNotNull()
    return bars.withColumn("compression_age_exp", F.when(known, F.when(c("squeeze"), F.least(F.lit(AGE_CAP), length)).otherwise(0)))


def experimental(bars: DataFrame) -> DataFrame:
    """Energy and wick balances, vacuum score, pullback tension, VWAP elasticity; bars with vwap_state."""
    weight = clip(c("relvol20"), 0.5, 2.0)
    bars = bars.withColumns({"w": weight, "energy": c("r2") * weight})
    bars = bars.withColumns({"signed_energy": F.signum("ret") * c("energy"), "wick": F.when(c("rng") > 0, (c("lower") - c("upper")) / c("rng")).otherwise(0.0) * c("w"), "bps": c("ret") * 1e4, "distance_before": lag(c("day_distance"), 1, Window.partitionBy("day_group").orderBy("bar_id"))})
    day = Window.partitionBy("day_group").orderBy("bar_id")
    near, far = c("disp5"), c("disp30")
    return bars.withColumns(
        {
            "directional_energy_balance_15_exp": safe_div(rsum(c("signed_energy"), 15), rsum(c("energy"), 15)),
            "wick_pressure_balance_10_exp": safe_div(rsum(c("wick"), 10), rsum(c("w"), 10)),
            "liquidity_vacuum_score_exp": safe_div(c("rng"), c("atr20")) * F.abs("clv") / F.sqrt(F.greatest(c("relvol20"), F.lit(0.25))),
            "pullback_tension_5_30_exp": F.when(near.isNotNull() & far.isNotNull(), F.when(near * far < 0, F.signum(far) * F.least(F.abs(near), F.abs(far))).otherwise(0.0)),
            "vwap_elasticity_30_exp": rslope(c("bps"), c("distance_before"), 30, day),
        }
    )


def clock(bars: DataFrame) -> DataFrame:
    """Entry-clock columns of decision bars whose next bar is in a session and the same run."""
    entry = F.lead("bar_ts").over(by_run())
    bars = bars.withColumn("entry_ts", entry).withColumn("entry_minute", F.hour("entry_ts") * 60 + F.minute("entry_ts"))
    london, new_york = c("entry_minute").between(LONDON[0], LONDON[1] - 1), c("entry_minute").between(NEW_YORK[0], NEW_YORK[1] - 1)
    bars = bars.where(london | new_york).withColumn("entry_session", F.when(london, "London").otherwise("New York"))
    since = c("entry_minute") - F.when(london, LONDON[0]).otherwise(NEW_YORK[0])
    angle = 2 * math.pi * c("entry_minute") / 1440
    return bars.withColumns(
        {
            "minute_from_execution_window_open": since,
            "session_progress_fraction": since / F.when(london, 179.0).otherwise(299.0),
            "minutes_to_noon_entry_cutoff": 720 - c("entry_minute"),
            "minutes_to_1530_forced_exit": 930 - c("entry_minute"),
            "new_york_minute_of_day": c("entry_minute"),
            "time_of_day_sin": F.sin(angle),
            "time_of_day_cos": F.cos(angle),
            "day_of_week": F.date_format("entry_ts", "EEEE"),
        }
    )


#: Support a time-of-day bin needs.
TOD_OBS, TOD_DATES = 200, 30


def tod_reference(bars: DataFrame, min_obs: int = TOD_OBS, min_dates: int = TOD_DATES) -> DataFrame:
    """tod_log_volume_z and tod_relative_volume: log volume against its (session, 15-minute bin) on Development days.

    A Development row's reference leaves out its own date. Bins and dates are two aggregates; rows join both, none is
    gathered anywhere.
    """
    rows = bars.where(c("session").isNotNull()).withColumns({"bin": F.floor(c("minute_of_day") / 15), "x": F.log1p("volume")})
    by_date = rows.where(c("research_partition") == "Development").groupBy("session", "bin", "trade_date").agg(F.count("x").alias("nd"), F.sum("x").alias("sd"), F.sum(c("x") * c("x")).alias("qd"))
    total = by_date.groupBy("session", "bin").agg(F.sum("nd").alias("n"), F.sum("sd").alias("s"), F.sum("qd").alias("q"), F.count("*").alias("dates"))
    rows = rows.join(total, ["session", "bin"], "left").join(by_date, ["session", "bin", "trade_date"], "left")
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    n, s, q = c("n") - zero("nd"), c("s") - zero("sd"), c("q") - zero("qd")
    rows = rows.withColumns({"n_ref": n, "dates_ref": c("dates") - F.when(c("nd").isNotNull(), 1).otherwise(0), "mean_ref": safe_div(s, n)})
    rows = rows.withColumn("sd_ref", F.sqrt(F.greatest(safe_div(q, n) - c("mean_ref") * c("mean_ref"), F.lit(0.0))))
    enough = (c("n_ref") >= min_obs) & (c("dates_ref") >= min_dates)
    return rows.withColumns({"tod_log_volume_z": F.when(enough & (c("sd_ref") > 1e-6), (c("x") - c("mean_ref")) / c("sd_ref")), "tod_relative_volume": F.when(enough, F.exp(c("x") - c("mean_ref")))})


def clock_adjusted(bars: DataFrame, min_obs: int, min_dates: int) -> DataFrame:
    """clock_z: log volume against its clock bin on strictly earlier dates; later partitions against all of Development."""
    rows = bars.withColumns({"bin": F.floor(c("minute_of_day") / 60), "x": F.log1p("volume"), "dev": c("research_partition") == "Development"})
    daily = rows.where("dev").groupBy("bin", "trade_date").agg(F.count("x").alias("nd"), F.sum("x").alias("sd"), F.sum(c("x") * c("x")).alias("qd"))
    earlier = Window.partitionBy("bin").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    prior = daily.select("bin", "trade_date", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(y) for x, y in (("nd", "n1"), ("sd", "s1"), ("qd", "q1"))], (F.count("*").over(earlier)).alias("d1"))
    total = daily.groupBy("bin").agg(F.sum("nd").alias("n2"), F.sum("sd").alias("s2"), F.sum("qd").alias("q2"), F.count("*").alias("d2"))
    rows = rows.join(prior, ["bin", "trade_date"], "left").join(total, "bin", "left")
    pick = lambda a, b: F.when(c("dev"), c(a)).otherwise(c(b))
    rows = rows.withColumns({"n_ref": pick("n1", "n2"), "dates_ref": pick("d1", "d2"), "mean_ref": safe_div(pick("s1", "s2").cast("double"), pick("n1", "n2"))})
    variance = safe_div(pick("q1", "q2").cast("double"), c("n_ref")) - c("mean_ref") * c("mean_ref")
    rows = rows.withColumn("sd_ref", F.sqrt(F.greatest(variance, F.lit(0.0))))
    return rows.withColumn("clock_z", F.when((c("n_ref") >= min_obs) & (c("dates_ref") >= min_dates) & (c("sd_ref") > 1e-6), (c("x") - c("mean_ref")) / c("sd_ref")))


def mlat(bars: DataFrame) -> DataFrame:
    """The twelve classical measures: Bollinger, Cutler RSI, Chaikin, Amihud, Parkinson, Rogers-Satchell, semivariance,
    bipower jumps, variance ratio, sign entropy, volatility of volatility."""
    ln = F.ln
    bars = bars.withColumns(
        {
            "gain": F.when(c("dc").isNotNull(), F.greatest(c("dc"), F.lit(0.0))),
            "loss": F.when(c("dc").isNotNull(), F.greatest(-c("dc"), F.lit(0.0))),
            "mfv": F.when(c("rng") == 0, 0.0).otherwise(c("clv")) * c("volume"),
            "amihud": safe_div(F.abs("ret"), c("close") * c("volume")),
            "pk": F.pow(log_ratio(c("high"), c("low")), F.lit(2.0)),
            "rs": log_ratio(c("high"), c("open")) * log_ratio(c("high"), c("close")) + log_ratio(c("low"), c("open")) * log_ratio(c("low"), c("close")),
            "up": F.when(c("ret").isNotNull(), F.when(c("ret") > 0, c("r2")).otherwise(0.0)),
            "down": F.when(c("ret").isNotNull(), F.when(c("ret") < 0, c("r2")).otherwise(0.0)),
            "bip": F.abs("ret") * F.abs(lag(c("ret"))),
            "ret5": rsum(c("ret"), 5),
            "rvol15": 1e4 * F.sqrt(rmean(c("r2"), 15)),
            **{f"sign_{name}": F.when(c("ret").isNotNull(), cond.cast("double")) for name, cond in (("neg", c("ret") < 0), ("zero", c("ret") == 0), ("pos", c("ret") > 0))},
        }
    )
    mean, sd = rmean(c("close"), 20), rstd(c("close"), 20)
    rv60, bpv = rsum(c("r2"), 60), math.pi / 2 * 60 / 59 * rsum(c("bip"), 60)
    shares = [rsum(c(f"sign_{s}"), 60) / 60 for s in ("neg", "zero", "pos")]
    entropy = sum((F.when(p > 0, p * ln(p)).when(p.isNotNull(), 0.0) for p in shares[1:]), F.when(shares[0] > 0, shares[0] * ln(shares[0])).when(shares[0].isNotNull(), 0.0))
    rs_mean = rmean(c("rs"), 30)
    return bars.withColumns(
        {
            "bollinger_zscore_20": safe_div(c("close") - mean, sd),
            "bollinger_bandwidth_20": safe_div(4 * sd, F.when(mean > 0, mean)),
            "cutler_rsi_14": 100 * safe_div(rsum(c("gain"), 14), rsum(c("gain"), 14) + rsum(c("loss"), 14)),
            "chaikin_money_flow_20": safe_div(rsum(c("mfv"), 20), rsum(c("volume"), 20)),
            "amihud_illiquidity_60": 1e9 * rmean(c("amihud"), 60),
            "parkinson_volatility_30": 1e4 * F.sqrt(rmean(c("pk"), 30) / (4 * math.log(2))),
            "rogers_satchell_volatility_30": 1e4 * F.sqrt(F.when(rs_mean >= -1e-12, F.greatest(rs_mean, F.lit(0.0)))),
            "realized_semivariance_balance_60": safe_div(rsum(c("up"), 60) - rsum(c("down"), 60), rsum(c("up"), 60) + rsum(c("down"), 60)),
            "bipower_jump_ratio_60": clip(safe_div(F.when(bpv.isNotNull(), F.greatest(rv60 - bpv, F.lit(0.0))), rv60), 0.0, 1.0),
            "variance_ratio_60_5": safe_div(complete(F.var_pop, c("ret5"), 60), 5 * complete(F.var_pop, c("ret"), 60)),
            "return_sign_entropy_60": -entropy / math.log(3),
            "volatility_of_volatility_60": safe_div(rstd(c("rvol15"), 60), F.when(rmean(c("rvol15"), 60) > 0, rmean(c("rvol15"), 60))),
        }
    )


def window_array(x: Column, n: int) -> Column:
    """The last n values, oldest first; NULL unless all are there."""
    w = frame(n)
    return F.when(F.count(x).over(w) == n, F.collect_list(x).over(w))


MAD_SCALE = 1.4826


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def quantile(a: Column, q: float, n: int) -> Column:
    """Linear quantile of an array of n values."""
    s, at = F.array_sort(a), q * (n - 1)
    lo = int(math.floor(at))
    return F.get(s, F.lit(lo)) + (at - lo) * (F.get(s, F.lit(min(lo + 1, n - 1))) - F.get(s, F.lit(lo)))


def dot(a: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(a, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def quadratic_weights(n: int) -> list[float]:
    """Weights that give the x**2 coefficient of a quadratic on n points of [-1, 1]."""
    xs = [-1 + 2 * i / (n - 1) for i in range(n)]
    m2, m4 = sum(x**2 for x in xs), sum(x**4 for x in xs)
    d = n * m4 - m2 * m2
    return [(n * x * x - m2) / d for x in xs]


def slope_weights(n: int) -> list[float]:
    xs = [-1 + 2 * i / (n - 1) for i in range(n)]
    m2 = sum(x * x for x in xs)
    return [x / m2 for x in xs]


def profile(bars: DataFrame, n: int = 30) -> DataFrame:
    """p_ret, p_range, p_volume: arrays of the last n returns (bps), true ranges over ATR20, volume z-scores over 60."""
    bars = bars.withColumns({"c_ret": c("ret") * 1e4, "c_range": safe_div(c("tr"), c("atr20")), "c_volume": safe_div(c("logv") - rmean(c("logv"), 60), rstd(c("logv"), 60))})
    return bars.withColumns({f"p_{x}": window_array(c(f"c_{x}"), n) for x in ("ret", "range", "volume")})


def p1_robust(p: Column, trim: int = 3) -> Column:
    """Each value less the trimmed mean, over the scaled MAD; NULL where that is zero."""

    def over(a: Column) -> Column:
        n = F.size(a)
        mean = F.aggregate(F.slice(F.array_sort(a), F.lit(trim + 1), n - 2 * trim), F.lit(0.0), lambda s, x: s + x) / (n - 2 * trim)
        scale = let(median(a), lambda m: MAD_SCALE * median(F.transform(a, lambda x: F.abs(x - m))))
        return let(F.struct(mean.alias("m"), scale.alias("s")), lambda t: F.when(t["s"] > 0, F.transform(a, lambda x: (x - t["m"]) / t["s"])))

    return let(p, over)


def p2_difference(p: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(p, i) - F.get(p, i - 1))


def p3_median(p: Column) -> Column:
    """Trailing median of three; the first two stand as they are."""
    return F.transform(p, lambda x, i: F.when(i < 2, x).otherwise(median(F.slice(p, i - 1, F.lit(3)))))


def fes(bars: DataFrame) -> DataFrame:
    """Shape measures of the last 30 returns, 31 closes and 30 volume z-scores."""
    bars = profile(bars)
    bars = bars.withColumns({"a_ret": c("p_ret"), "a_close": window_array(c("close"), 31), "close_first": F.when(F.count("close").over(frame(31)) == 31, F.first("close").over(frame(31)))})
    # arrays are columns by now: kernels read them, nothing is gathered twice
    a = c("a_ret")
    bars = bars.withColumns({"a_med": median(a), "a_q10": quantile(a, 0.1, 30), "a_q90": quantile(a, 0.9, 30)})
    bars = bars.withColumn("a_mad", MAD_SCALE * median(F.transform(a, lambda x: F.abs(x - c("a_med")))))
    size = F.abs("a_q90") + F.abs("a_q10")
    walk = F.aggregate(
        c("a_close"),
        F.struct(c("close_first").alias("lo"), c("close_first").alias("hi"), F.lit(0.0).alias("up"), F.lit(0.0).alias("dn")),
        lambda s, x: F.struct(F.least(s["lo"], x).alias("lo"), F.greatest(s["hi"], x).alias("hi"), F.greatest(s["up"], x - F.least(s["lo"], x)).alias("up"), F.greatest(s["dn"], F.greatest(s["hi"], x) - x).alias("dn")),
    )
    bars = bars.withColumn("walk", F.when(c("a_close").isNotNull(), walk))
    total = c("walk.up") + c("walk.dn")
    return bars.withColumns(
        {
            "trimmed_mean_30": F.aggregate(F.slice(F.array_sort(a), 4, 24), F.lit(0.0), lambda s, x: s + x) / 24,
            "mad_30": c("a_mad"),
            "tail_balance_30": F.when(size == 0, 0.0).otherwise((F.abs("a_q90") - F.abs("a_q10")) / size),
            "outlier_fraction_30": F.when(c("a_mad") == 0, 0.0).when(a.isNotNull(), F.size(F.filter(a, lambda x: F.abs(x - c("a_med")) > 3 * c("a_mad"))) / 30.0),
            "curvature_31": safe_div(dot(F.transform("a_close", lambda x: x - c("close_first")), quadratic_weights(31)), c("atr20")),
            "draw_balance_31": F.when(total == 0, 0.0).otherwise(safe_div(c("walk.up") - c("walk.dn"), total)),
            "volume_slope_30": dot(c("p_volume"), slope_weights(30)),
        }
    )


def rank_average(a: Column) -> Column:
    """Average ranks of an array, in its order; n is bounded by the window."""
    return F.transform(a, lambda x: F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / 2.0)


def pearson(x: Column, y: Column) -> Column:
    """Of two arrays of one length; NULL where either doesn't vary."""
    n = F.size(x)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    mx, my = add(x) / n, add(y) / n
    xx, yy = add(F.transform(x, lambda t: (t - mx) * (t - mx))), add(F.transform(y, lambda t: (t - my) * (t - my)))
    xy = add(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    return F.when((xx > 0) & (yy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), xy / F.sqrt(xx * yy))))


def acf_energy(bars: DataFrame, n: int = 60, lags: int = 5) -> DataFrame:
    """acf_energy_60: root mean square of the first five autocorrelations of n returns, as frame correlations."""
    bars = bars.withColumns({f"ret_l{k}": lag(c("ret"), k) for k in range(1, lags + 1)})
    rho = {f"rho{k}": F.when(F.count("ret").over(frame(n)) == n, rcorr(c("ret"), c(f"ret_l{k}"), n - k)) for k in range(1, lags + 1)}
    bars = bars.withColumns(rho)
    return bars.withColumn("acf_energy_60", F.sqrt(sum((c(f"rho{k}") * c(f"rho{k}") for k in range(2, lags + 1)), c("rho1") * c("rho1")) / lags))


def spearman_profiles(bars: DataFrame, n: int = 30) -> DataFrame:
    """spearman_ret_volume_30: rank correlation of the return and volume profiles; both need a fifth of distinct values."""
    bars = profile(bars, n)
    # values that differ by rounding alone are ties
    bars = bars.withColumns({x: F.transform(x, lambda v: F.round(v, 9)) for x in ("p_ret", "p_volume")})
    bars = bars.withColumns({"k_ret": rank_average(c("p_ret")), "k_vol": rank_average(c("p_volume"))})
    need = max(3, math.ceil(0.2 * n))
    enough = (F.size(F.array_distinct("p_ret")) >= need) & (F.size(F.array_distinct("p_volume")) >= need)
    return bars.withColumn("spearman_ret_volume_30", F.when(enough, pearson(c("k_ret"), c("k_vol"))))


def tsay(bars: DataFrame) -> DataFrame:
    """Roll spread, share of unchanged closes, tail shortfall and balance, lead impulse."""
    bars = bars.withColumns({"dc_before": lag(c("dc")), "still": F.when(c("dc").isNotNull(), (c("dc") == 0).cast("double")), "zvol": safe_div(c("logv") - rmean(c("logv"), 60), rstd(c("logv"), 60))})
    pair = F.when(c("dc_before").isNotNull(), c("dc") * c("dc_before"))
    bars = bars.withColumn("pair", pair)
    n = 59
    gamma = complete(F.avg, c("pair"), n) - complete(F.avg, c("dc"), n) * complete(F.avg, c("dc_before"), n)
    bars = bars.withColumns({"gamma": gamma, "a_dc": window_array(c("dc"), 60), **{f"zvol_l{k}": lag(c("zvol"), k) for k in range(1, 6)}})
    worst = F.slice(F.array_sort("a_dc"), 1, 6)
    best = F.slice(F.array_sort("a_dc"), -6, 6)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    bars = bars.withColumns({"es": F.when(c("a_dc").isNotNull(), -add(worst) / 6), "gain_tail": F.when(c("a_dc").isNotNull(), add(best) / 6), **{f"lead{k}": rcorr(c("ret"), c(f"zvol_l{k}"), 40) for k in range(1, 6)}})
    return bars.withColumns(
        {
            "roll_spread_ticks": F.when(c("gamma") < 0, 2 * F.sqrt(-c("gamma")) / TICK).when(c("gamma").isNotNull(), 0.0),
            "roll_state": (-F.signum("gamma")).cast("int"),
            "zero_fraction_60": rmean(c("still"), 60),
            "expected_shortfall_60": c("es"),
            "tail_balance_60": F.when(F.abs("gain_tail") + F.abs("es") == 0, 0.0).otherwise((c("gain_tail") - c("es")) / (F.abs("gain_tail") + F.abs("es"))),
            "lead_impulse": (c("lead1") + c("lead2") + c("lead3") + c("lead4") + c("lead5")) / 5 * c("zvol"),
        }
    )
