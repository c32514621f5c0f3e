"""Queries of forward labels and eligibility, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.windows import log_ratio
from tidebars.operators import features, labels
from tidebars.plans import sql
from tidebars.plans.sql import r, rounded
from tidebars.sources.bars import TICK, event_bars

KEYS = ("product", "bar_ts", "bar_id")


def _rows(spark: SparkSession, sf_dir: str, h: int) -> DataFrame:
    return labels.labelled(features.prepared(event_bars(spark, sf_dir)), h)


def labels_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, 8).select(*KEYS, "reason")


def labels_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, 8).select(*KEYS, "return_ticks", rounded("return_bps", 4).alias("return_bps"), rounded("return_atr").alias("return_atr"), "direction")


def labels_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, 8).select(*KEYS, *[rounded(n).alias(n) for n in ("mfe_long", "mae_long", "mfe_short", "mae_short")])


def labels_time_to_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, 8).select(*KEYS, "bars_to_high", "bars_to_low")


def labels_rv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, 8).select(*KEYS, rounded("realized_vol", 4).alias("realized_vol"))


def labels_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_expansion(_rows(spark, sf_dir, 8)).select(*KEYS, rounded("range_atr").alias("range_atr"), F.col("expansion").cast("int").alias("expansion"))


def labels_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All horizons as rows, with every label."""
    bars = features.prepared(event_bars(spark, sf_dir))
    rows = reduce(DataFrame.unionByName, [labels.labelled(bars, h) for h in labels.HORIZONS])
    return rows.where("entry_session IS NOT NULL").select("horizon", *KEYS, "entry_session", "research_partition", "reason", "return_ticks", rounded("return_atr").alias("return_atr"), rounded("mfe_long").alias("mfe_long"), rounded("mae_long").alias("mae_long"))


def availability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = features.prepared(event_bars(spark, sf_dir))
    rows = reduce(DataFrame.unionByName, [labels.labelled(bars, h).select("horizon", "entry_session", "research_partition", "reason") for h in labels.HORIZONS])
    return labels.availability(rows).withColumn("share", rounded("share"))


def eligible_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.funnel(event_bars(spark, sf_dir))


def continuity_lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.continuity_lag_pairs(event_bars(spark, sf_dir), 3).select("product", "bar_ts", rounded(log_ratio(F.col("close"), F.col("close_before"))).alias("log_change"))


def forward_rv_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.forward_vol(event_bars(spark, sf_dir), 5).select(*KEYS, rounded("forward_vol").alias("forward_vol"))


QUERIES: dict[str, sql.Query] = {
    f.__name__: f for f in (labels_reasons, labels_returns, labels_excursions, labels_time_to_extreme, labels_rv, labels_expansion, labels_wide, availability_report, eligible_funnel, continuity_lag_pairs, forward_rv_segmented)
}


def _path(h: int, name: str = "l") -> str:
    """Labels of one horizon over f."""
    frame = f"PARTITION BY product ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING"
    inner = f"PARTITION BY product ORDER BY bar_id ROWS BETWEEN 2 FOLLOWING AND {h} FOLLOWING"
    return f"""
{name}1 AS (SELECT *, pow({sql.log_ratio('close', 'lag(close) OVER p')}, 2) AS step2, lead(open) OVER p AS entry_price, lead(close) OVER p AS entry_close, lead(minute_of_day) OVER p AS entry_minute,
  lead(trade_date) OVER p AS entry_date, lead(session) OVER p AS entry_session FROM f WINDOW p AS (PARTITION BY product ORDER BY bar_id)),
{name}2 AS (SELECT *, count(*) OVER a AS n_path, last(close) OVER a AS exit_close, last(minute_of_day) OVER a AS last_minute, last(trade_date) OVER a AS last_date, max(high) OVER a AS path_high, min(low) OVER a AS path_low,
  list_position(list(high) OVER a, max(high) OVER a) AS t_high, list_position(list(low) OVER a, min(low) OVER a) AS t_low, coalesce(sum(step2) OVER i, 0) AS steps,
  coalesce(max(CASE WHEN boundary_reason = 2 THEN 1 ELSE 0 END) OVER i, 0) AS gaps, coalesce(max(CASE WHEN boundary_reason = 5 THEN 1 ELSE 0 END) OVER i, 0) AS segs FROM {name}1 WINDOW a AS ({frame}), i AS ({inner})),
{name}3 AS (SELECT *, CASE WHEN n_path < {h} THEN 'insufficient_rows' WHEN gaps = 1 THEN 'time_gap' WHEN segs = 1 THEN 'segment_change' WHEN last_date <> entry_date THEN 'date_change'
  WHEN entry_minute < 930 AND last_minute >= 930 THEN 'forced_exit' ELSE 'available' END AS reason FROM {name}2),
{name} AS (SELECT *, {h} AS horizon, CASE WHEN reason = 'available' THEN CAST(round_even((exit_close - entry_price) / {TICK}, 0) AS INTEGER) END AS return_ticks,
  CASE WHEN reason = 'available' THEN 1e4 * ({sql.log_ratio('exit_close', 'entry_price')}) END AS return_bps, CASE WHEN reason = 'available' THEN (exit_close - entry_price) / nullif(atr20, 0) END AS return_atr,
  CASE WHEN reason = 'available' THEN path_high - entry_price END AS mfe_long, CASE WHEN reason = 'available' THEN entry_price - path_low END AS mae_long,
  CASE WHEN reason = 'available' THEN 1e4 * sqrt(pow({sql.log_ratio('entry_close', 'entry_price')}, 2) + steps) END AS realized_vol,
  CASE WHEN reason = 'available' THEN (path_high - path_low) / nullif(atr20, 0) END AS range_atr FROM {name}3)"""


_L8 = f"WITH {sql.features()}, {_path(8)}"
_ALL = f"WITH {sql.features()}, " + ", ".join(_path(h, f"l{h}_") for h in labels.HORIZONS)
_UNION = " UNION ALL ".join(f"SELECT horizon, product, bar_ts, bar_id, entry_session, research_partition, reason, return_ticks, return_atr, mfe_long, mae_long FROM l{h}_" for h in labels.HORIZONS)
K = "product, bar_ts, bar_id"
_PASS = [
    "lead(bar_id) OVER p IS NOT NULL",
    "coalesce(lead(boundary_reason) OVER p <> 2, false)",
    "coalesce(lead(segment) OVER p = segment, false)",
    "coalesce(lead(trade_date) OVER p = trade_date, false)",
    "coalesce(lead(minute_of_day) OVER p BETWEEN 180 AND 359 OR lead(minute_of_day) OVER p BETWEEN 420 AND 719, false)",
    "coalesce(lead(volume) OVER p >= 2, false)",
]
_ok = lambda x: f"CASE WHEN reason = 'available' THEN {x} END"

ORACLE_SQL: dict[str, str] = {
    "labels_reasons": f"{_L8} SELECT {K}, reason FROM l",
    "labels_returns": f"{_L8} SELECT {K}, return_ticks, {r('return_bps', 4)} AS return_bps, {r('return_atr')} AS return_atr, CAST(sign(return_ticks) AS INTEGER) AS direction FROM l",
    "labels_excursions": f"{_L8} SELECT {K}, {r('mfe_long')} AS mfe_long, {r('mae_long')} AS mae_long, {r('mae_long')} AS mfe_short, {r('mfe_long')} AS mae_short FROM l",
    "labels_time_to_extreme": f"{_L8} SELECT {K}, CAST({_ok('t_high')} AS INTEGER) AS bars_to_high, CAST({_ok('t_low')} AS INTEGER) AS bars_to_low FROM l",
    "labels_rv": f"{_L8} SELECT {K}, {r('realized_vol', 4)} AS realized_vol FROM l",
    "labels_expansion": f"{_L8}, q AS (SELECT quantile_cont(range_atr, 0.8) AS edge FROM l WHERE research_partition = 'Development') SELECT {K}, {r('range_atr')} AS range_atr, CAST(range_atr >= edge AS INTEGER) AS expansion FROM l, q",
    "labels_wide": f"{_ALL} SELECT horizon, {K}, entry_session, research_partition, reason, return_ticks, {r('return_atr')} AS return_atr, {r('mfe_long')} AS mfe_long, {r('mae_long')} AS mae_long FROM ({_UNION}) WHERE entry_session IS NOT NULL",
    "availability_report": f"{_ALL}, c AS (SELECT horizon, entry_session, research_partition, reason, count(*) AS n FROM ({_UNION}) WHERE entry_session IS NOT NULL GROUP BY ALL) SELECT *, {r('n / sum(n) OVER (PARTITION BY horizon, entry_session, research_partition)')} AS share FROM c",
    "eligible_funnel": f"WITH {sql.bars()}, e AS (SELECT {', '.join(f'{x} AS p{i}' for i, x in enumerate(_PASS, 1))} FROM bars WINDOW p AS (PARTITION BY product ORDER BY bar_id)) "
    + " UNION ALL ".join(f"SELECT {i} AS rule_no, '{n}' AS rule, count(*) FILTER ({' AND '.join(f'p{j}' for j in range(1, i + 1))}) AS survivors FROM e" for i, n in enumerate(labels.RULES, 1)),
    "continuity_lag_pairs": f"WITH {sql.bars()} SELECT x.product, x.bar_ts, {r('(' + sql.log_ratio('x.close', 'y.close') + ')')} AS log_change FROM bars x JOIN bars y ON x.product = y.product AND y.bar_ts = x.bar_ts - INTERVAL 45 MINUTES AND x.trade_date = y.trade_date AND x.segment = y.segment",
    "forward_rv_segmented": f"WITH {sql.features()} SELECT {K}, {r('CASE WHEN count(r2) OVER a = 5 THEN sqrt(sum(r2) OVER a) END')} AS forward_vol FROM f WINDOW a AS (PARTITION BY run_id ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)",
}
