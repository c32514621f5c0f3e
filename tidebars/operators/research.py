"""Study operators: zone refinement, stop models, approach context, parameter sweeps, sizing ladders, gates, sessions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.windows import by_run, corr, safe_div
from tidebars.operators.joins import range_join
from tidebars.sources.bars import TICK

c = F.col
#: Reasons for refusing a zone, in the order they are looked at. Fixed values.
REJECTIONS = ("gap_too_small", "body_too_small", "no_open_gap", "late_session", "accepted")


def refine_zones(bars: DataFrame, gap_ticks: int = 3, body_share: float = 0.3, last_minute: int = 900) -> DataFrame:
    """Every three-bar proposal with its geometry case (1: gap clear of the body, 2: meets it, 3: overlaps) and the first
    reason to refuse it, or accepted."""
    nxt, before = (lambda x: F.lead(x).over(by_run())), (lambda x: F.lag(x).over(by_run()))
    bars = bars.withColumns({"h0": before("high"), "l0": before("low"), "h2": nxt("high"), "l2": nxt("low"), "o2": nxt("open")}).where("h0 IS NOT NULL AND h2 IS NOT NULL")
    up = c("close") >= c("open")
    bars = bars.withColumn("direction", F.when(up, "bull").otherwise("bear"))
    gap = F.when(up, c("l2") - c("h0")).otherwise(c("l0") - c("h2")) / TICK
    open_gap = F.when(up, c("o2") - c("h0")).otherwise(c("l0") - c("o2")) / TICK
    bars = bars.withColumns({"gap_ticks": gap, "open_gap_ticks": open_gap, "body_share": safe_div(F.abs(c("close") - c("open")), c("high") - c("low"))})
    top, low = F.greatest("open", "close"), F.least("open", "close")
    edge = F.when(up, c("h0") - low).otherwise(top - c("l0"))
    case = F.when(edge < 0, 1).when(edge == 0, 2).otherwise(3)
    reason = F.when(c("gap_ticks") < gap_ticks, REJECTIONS[0]).when(F.coalesce(c("body_share"), F.lit(0.0)) < body_share, REJECTIONS[1]).when(c("open_gap_ticks") <= 0, REJECTIONS[2]).when(c("minute_of_day") > last_minute, REJECTIONS[3]).otherwise(REJECTIONS[4])
    return bars.withColumns({"geometry_case": case, "reason": reason})


def stop_models(bars: DataFrame) -> DataFrame:
    """Per bar, long-side stops: below the bar, below the last three, below the seven before, and the widest with half an ATR; in ticks of risk."""
    models = {
        "touch": c("low"),
        "adjacent": F.min("low").over(by_run().rowsBetween(-2, 0)),
        "micro_swing": F.min("low").over(by_run().rowsBetween(-7, -1)),
        "hybrid": F.least(c("low"), c("close") - 0.5 * c("atr20")),
    }
    rows = bars.withColumns({f"m_{n}": x for n, x in models.items()})
    rows = rows.select("bar_id", "close", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c(f"m_{n}").alias("stop")) for n in models])).alias("x")).select("bar_id", "close", "x.*")
    return rows.where("stop IS NOT NULL").withColumn("risk_ticks", (c("close") - c("stop")) / TICK)


def approach(bars: DataFrame, windows: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Move and path efficiency over the bars before this one; NULL where the window crosses a run or date."""
    out = {}
    for n in windows:
        first = F.lag("close", n + 1).over(by_run())
        same = F.lag("trade_date", n + 1).over(by_run()) == c("trade_date")
        move = F.lag("close").over(by_run()) - first
        path = F.sum("adc").over(by_run().rowsBetween(-n, -1))
        out[f"approach_move_{n}"] = F.when(same, safe_div(move, c("atr20")))
        out[f"approach_efficiency_{n}"] = F.when(same, safe_div(F.abs(move), path))
    return bars.withColumns(out)


def displacement(zones: DataFrame, bars: DataFrame, before: int = 5) -> DataFrame:
    """Range aggregates of the leg that ends at each zone's middle bar: net move, path, largest bar."""
    legs = zones.withColumns({"leg_from": c("middle_bar") - before, "leg_to": c("middle_bar")})
    path = bars.select("product", "bar_id", c("open").alias("o"), c("close").alias("k"), (c("high") - c("low")).alias("span"), F.abs(c("close") - c("open")).alias("b"))
    rows = range_join(legs, path, ["product"], "leg_from", "leg_to", "bar_id")
    return rows.groupBy("zone_id").agg((F.max_by("k", "bar_id") - F.min_by("o", "bar_id")).alias("net"), F.sum("b").alias("path"), F.max("span").alias("largest"), F.count("*").alias("bars"))


def sweep(opps: DataFrame, bars: DataFrame, stops: list[float], targets: list[float], hold: int) -> DataFrame:
    """Mean result of every (stop, target) pair, in ATR and R: parameters exploded, then one first-passage aggregate."""
    from tidebars.operators.events import first_passage

    rows = opps.withColumn("atr", c("risk") / 1.5).withColumn("stop_atr", F.explode(F.array(*[F.lit(s) for s in stops]))).withColumn("target_r", F.explode(F.array(*[F.lit(t) for t in targets])))
    rows = rows.withColumn("risk", c("stop_atr") * c("atr"))
    rows = rows.withColumns({"stop": c("entry_price") - c("side") * c("risk"), "target": c("entry_price") + c("side") * c("target_r") * c("risk")})
    # the parameters ride in the session column's place of the path keys
    rows = rows.withColumn("entry_session", F.concat_ws("|", c("stop_atr").cast("string"), c("target_r").cast("string")))
    out = first_passage(rows, bars, hold)
    return out.groupBy("entry_session").agg(F.count("*").alias("n"), F.avg("gross_r").alias("mean_r"), F.avg((c("exit_reason") == "target").cast("double")).alias("target_rate"))


def sizing_ladder(rows: DataFrame, signal: str, r: str, weights: list[float]) -> DataFrame:
    """Mean result by partition with equal weights and with a ladder of weights over Development quantile buckets of a signal."""
    from tidebars.operators.aggregates import dev_buckets

    n = len(weights)
    rows = dev_buckets(rows.where(c(signal).isNotNull() & c(r).isNotNull()), signal, n)
    w = F.array(*[F.lit(x) for x in weights])[F.least(c("bucket"), F.lit(n - 1)).cast("int")]
    rows = rows.withColumn("w", w)
    return rows.groupBy("research_partition").agg(F.count("*").alias("n"), F.avg(r).alias("flat"), (F.sum(c("w") * c(r)) / F.sum("w")).alias("sized"))


def gate_comparison(rows: DataFrame, gate: Column, r: str, keys: list[str]) -> DataFrame:
    """Baseline and gated means side by side, and what the gate adds."""
    out = rows.withColumn("_g", F.coalesce(gate, F.lit(False))).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(r).alias("baseline"), F.count_if(c("_g")).alias("gated_n"), F.avg(F.when(c("_g"), c(r))).alias("gated"))
    return out.withColumn("improvement", c("gated") - c("baseline"))


def confirmation(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Development against Validation cells of one key: sign agreement, retention and a verdict, by conditional aggregation."""
    pick = lambda p: F.max(F.when(c("research_partition") == p, c(value)))
    out = cells.groupBy(*keys).agg(pick("Development").alias("dev"), pick("Validation").alias("val"))
    out = out.withColumns({"agrees": F.signum("dev") == F.signum("val"), "retention": safe_div(F.abs("val"), F.abs("dev"))})
    verdict = F.when(c("dev").isNull() | c("val").isNull(), "insufficient").when(~c("agrees"), "sign_flip").when(c("retention") < 0.25, "faded").otherwise("advance")
    return out.withColumn("verdict", verdict)


def conditions(rows: DataFrame, named: dict[str, Column], r: str, keys: list[str]) -> DataFrame:
    """Mean of r where each named condition holds: conditional aggregates, one pass, then rows."""
    rows = rows.withColumns({f"k_{n}": F.coalesce(x, F.lit(False)) for n, x in named.items()})
    wide = rows.groupBy(*keys).agg(*[F.struct(F.count_if(c(f"k_{n}")).alias("n"), F.avg(F.when(c(f"k_{n}"), c(r))).alias("m")).alias(n) for n in named])
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), c(n)["n"].alias("n"), c(n)["m"].alias("mean")) for n in named])).alias("x")).select(*keys, "x.*")


def session_stats(rows: DataFrame, r: str, keys: list[str], day: str) -> DataFrame:
    """Annualised Sharpe of daily sums, best and worst day, and the share of days that gain."""
    daily = rows.groupBy(*keys, day).agg(F.sum(r).alias("d"))
    return daily.groupBy(*keys).agg(F.count("*").alias("days"), F.avg("d").alias("mean_day"), (F.avg("d") / F.stddev_samp("d") * math.sqrt(252)).alias("sharpe"), F.max("d").alias("best"), F.min("d").alias("worst"), F.avg((c("d") > 0).cast("double")).alias("win_days"))


def quintiles(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Means of y over five Development buckets of x, spread of the ends, rank correlation of bucket and mean."""
    from tidebars.operators.aggregates import dev_buckets

    rows = dev_buckets(rows, x, 5).where(c("bucket").isNotNull() & c(y).isNotNull())
    cells = rows.groupBy(*keys, "bucket").agg(F.avg(y).alias("m"))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy("m"))
    return cells.withColumn("rank", rank).groupBy(*keys).agg(F.count("*").alias("buckets"), (F.max_by("m", "bucket") - F.min_by("m", "bucket")).alias("spread"), corr(c("bucket"), c("rank")).alias("monotonicity"))


def fibonacci(low: float, high: float) -> dict[str, float]:
    """Retracement and extension levels of a leg. The ratios are fixed values."""
    return {str(k): high - k * (high - low) for k in (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)} | {f"x{k}": low + k * (high - low) for k in (1.272, 1.618, 2.618)}


def measure(price_a: float, price_b: float, bars: int, minutes: int) -> dict[str, float | str]:
    """Distance between two points of a chart."""
    move = price_b - price_a
    text = f"{minutes // 1440}d {minutes % 1440 // 60}h" if minutes >= 1440 else f"{minutes // 60}h {minutes % 60}m" if minutes >= 60 else f"{minutes}m"
    return {"move": move, "percent": 100 * move / price_a if price_a else math.nan, "ticks": move / TICK, "bars": bars, "duration": text}


def viewport(bars: DataFrame, first: int, last: int, pixels: int, ladder: tuple[int, ...] = (1, 4, 16, 96)) -> DataFrame:
    """Bars [first, last] of each product at the finest step that fits the pixels: buckets of bar ids."""
    step = next((s for s in ladder if (last - first + 1) / s <= pixels), ladder[-1])
    rows = bars.where(c("bar_id").between(first, last)).withColumn("tile", F.floor(c("bar_id") / step))
    return rows.groupBy("product", "tile").agg(F.min("bar_ts").alias("bar_ts"), F.min_by("open", "bar_id").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_id").alias("close"), F.sum("volume").alias("volume"))
