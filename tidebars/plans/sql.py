"""Building blocks of the DuckDB statements that the queries are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def bars(minutes: int = 15, by_type: bool = False) -> str:
    """Common table expressions up to bars: calendar, continuity runs."""
    product = "event_type" if by_type else "'ALL'"
    return f"""
b0 AS (SELECT {product} AS product, time_bucket(INTERVAL '{minutes} minutes', ts) AS bar_ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
       min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
b1 AS (SELECT *, CAST(bar_ts AS DATE) AS trade_date, CAST(hour(bar_ts) * 60 + minute(bar_ts) AS INTEGER) AS minute_of_day,
       CAST(floor((CAST(bar_ts AS DATE) - DATE '2024-01-01') / 7.0) AS INTEGER) AS segment FROM b0),
b2 AS (SELECT *, row_number() OVER o - 1 AS bar_id, epoch(bar_ts) - epoch(lag(bar_ts) OVER o) AS gap, lag(segment) OVER o AS before FROM b1 WINDOW o AS (PARTITION BY product ORDER BY bar_ts)),
b3 AS (SELECT *, CASE WHEN bar_id = 0 THEN 1 WHEN gap <> {minutes * 60} THEN 2 WHEN segment <> before THEN 5 ELSE 0 END AS boundary_reason FROM b2),
b4 AS (SELECT *, CAST(sum(CASE WHEN boundary_reason > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY product ORDER BY bar_ts) - 1 AS BIGINT) AS run_no FROM b3),
bars AS (SELECT *, product || '/' || run_no AS run_id, row_number() OVER (PARTITION BY product, run_no ORDER BY bar_id) - 1 AS run_position,
       CASE WHEN minute_of_day BETWEEN 180 AND 359 THEN 'London' WHEN minute_of_day BETWEEN 420 AND 719 THEN 'New York' END AS session,
       CASE WHEN trade_date <= DATE '2024-01-18' THEN 'Development' WHEN trade_date <= DATE '2024-01-24' THEN 'Validation' ELSE 'Final' END AS research_partition FROM b4)"""


def log_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln(({a}) / ({b})) END"


def roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {fn}({x}) OVER w{n} END"


def windows(*ns: int, by: str = "run_id") -> str:
    return "WINDOW o AS (PARTITION BY run_id ORDER BY bar_id)" + "".join(f", w{n} AS (PARTITION BY {by} ORDER BY bar_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


def features(minutes: int = 15, by_type: bool = False) -> str:
    """bars, then f: the shared primitives of all families."""
    atr = ", ".join(f"{roll('avg', 'tr', n)} AS atr{n}" for n in (5, 20, 30, 60))
    rv = ", ".join(f"1e4 * sqrt({roll('sum', 'r2', n)}) AS rv{n}" for n in (5, 15, 30, 60))
    vm = ", ".join(f"{roll('avg', 'volume', n)} AS vmean{n}" for n in (5, 20, 60))
    bps = ", ".join(f"1e4 * ({log_ratio('close', f'lag(close, {h}) OVER o')}) AS bps{h}" for h in (1, 5, 15, 30, 60))
    disp = ", ".join(f"(close - lag(close, {h}) OVER o) / nullif(atr20, 0) AS disp{h}" for h in (5, 15, 30, 60))
    return f"""{bars(minutes, by_type)},
f1 AS (SELECT *, close - lag(close) OVER o AS dc, {log_ratio('close', 'lag(close) OVER o')} AS ret, high - low AS rng, close - open AS body,
       CASE WHEN lag(close) OVER o IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) END AS tr,
       high - greatest(open, close) AS upper_, least(open, close) - low AS lower_, ln(1 + volume) AS logv, (high + low + close) / 3 * volume AS pv,
       (2 * close - high - low) / nullif(high - low, 0) AS clv FROM bars {windows()}),
f2 AS (SELECT *, ret * ret AS r2, abs(dc) AS adc FROM f1),
f3 AS (SELECT *, {atr}, {rv}, {vm}, {bps} FROM f2 {windows(5, 15, 20, 30, 60)}),
f AS (SELECT *, volume / nullif(vmean20, 0) AS relvol20, volume / nullif(vmean60, 0) AS relvol60, {disp} FROM f3 {windows()})"""


def islands(source: str, key: str, name: str, out: str) -> str:
    """out: source with name, an id of stretches of equal key within runs."""
    return f"""{out}_k AS (SELECT *, {key} AS k_{name} FROM {source}),
{out}_n AS (SELECT *, CASE WHEN run_position = 0 OR k_{name} IS DISTINCT FROM lag(k_{name}) OVER (PARTITION BY run_id ORDER BY bar_id) THEN 1 ELSE 0 END AS n_{name} FROM {out}_k),
{out} AS (SELECT *, run_id || '/' || CAST(sum(n_{name}) OVER (PARTITION BY run_id ORDER BY bar_id) AS BIGINT) AS {name} FROM {out}_n)"""


def corr(x: str, y: str, w: str, n: int) -> str:
    """Over window w of n rows: complete, both sides varying, clipped."""
    both = f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {w} = {n}"
    return f"CASE WHEN {both} AND max({x}) OVER {w} > min({x}) OVER {w} AND max({y}) OVER {w} > min({y}) OVER {w} THEN greatest(-1.0, least(1.0, corr({x}, {y}) OVER {w})) END"


def slope(y: str, x: str, w: str, n: int) -> str:
    both = f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {w} = {n}"
    return f"CASE WHEN {both} AND max({x}) OVER {w} > min({x}) OVER {w} THEN regr_slope({y}, {x}) OVER {w} END"


def pick(columns: dict[str, str], source: str = "f", window: str = "", keys: str = "product, bar_ts, bar_id", where: str = "", digits: dict[str, int] | None = None, plain: tuple[str, ...] = ()) -> str:
    """SELECT keys and rounded columns; plain ones as they are."""
    shown = ", ".join(f"{x} AS {name}" if name in plain else f"{r(f'({x})', (digits or {}).get(name, 6))} AS {name}" for name, x in columns.items())
    return f"SELECT {keys}, {shown} FROM {source} {where} {window}"
