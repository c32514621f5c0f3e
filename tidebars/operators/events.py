"""Event detection on bars: swings, breaks, gap zones, retests, candidates; and trade paths.

Everything is relational. Swings and breaks are frames over a product's bars; zones meet later bars of their date in
an equi-join on the date with a range condition; a trade path is a range of bar ids, joined by blocks of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.windows import safe_div
from tidebars.operators.joins import range_join
from tidebars.operators.labels import by_product
from tidebars.sources.bars import TICK

c = F.col
SWINGS, STRUCTURAL = (3, 5, 7), (15, 21, 31)
MIN_GAP_TICKS = 3
#: Stop limits in ticks and targets in R. Fixed values.
STOP_TICKS, TARGETS = (25, 100), (1, 2, 3, 4, 5)
HOLD = 12


def swings(bars: DataFrame, n: int, order=None) -> DataFrame:
    """swing_high, swing_low: strict centre extremes of n bars, known k = n // 2 bars later."""
    k, order = n // 2, order or by_product()
    before, after = order.rowsBetween(-k, -1), order.rowsBetween(1, k)
    full = (F.count("*").over(before) == k) & (F.count("*").over(after) == k)
    return bars.withColumns(
        {
            "swing_high": full & (c("high") > F.greatest(F.max("high").over(before), F.max("high").over(after))),
            "swing_low": full & (c("low") < F.least(F.min("low").over(before), F.min("low").over(after))),
        }
    )


def prior_swing(bars: DataFrame, n: int, order=None) -> DataFrame:
    """prior_high, prior_low and their bar ids: the last swings confirmed before this bar."""
    k, order = n // 2, order or by_product()
    bars = swings(bars, n, order)
    known = {"_h": F.when(c("swing_high"), F.struct("high", "bar_id")), "_l": F.when(c("swing_low"), F.struct("low", "bar_id"))}
    bars = bars.withColumns(known)
    bars = bars.withColumns({"_hk": F.lag("_h", k).over(order), "_lk": F.lag("_l", k).over(order)})
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    bars = bars.withColumns({"_hp": F.last("_hk", ignorenulls=True).over(past), "_lp": F.last("_lk", ignorenulls=True).over(past)})
    return bars.withColumns({"prior_high": c("_hp.high"), "prior_high_bar": c("_hp.bar_id"), "prior_low": c("_lp.low"), "prior_low_bar": c("_lp.bar_id")}).drop("_h", "_l", "_hk", "_lk", "_hp", "_lp")


def structural_breaks(bars: DataFrame, n: int, mode: str = "close") -> DataFrame:
    """direction, bar_id, level: the first bar whose close (or wick) is beyond a confirmed swing of its segment."""
    order = Window.partitionBy("product", "segment").orderBy("bar_id")
    bars = prior_swing(bars, n, order)
    up, down = ("close", "close") if mode == "close" else ("high", "low")
    high = bars.where(c(up) > c("prior_high")).select("product", "segment", F.lit("bull").alias("direction"), "bar_id", c("prior_high").alias("level"), c("prior_high_bar").alias("swing_bar"))
    low = bars.where(c(down) < c("prior_low")).select("product", "segment", F.lit("bear").alias("direction"), "bar_id", c("prior_low").alias("level"), c("prior_low_bar").alias("swing_bar"))
    both = high.unionByName(low)
    first = F.row_number().over(Window.partitionBy("product", "segment", "direction", "swing_bar").orderBy("bar_id"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("structural_window", F.lit(n))


def gap_zones(bars: DataFrame, min_ticks: int = MIN_GAP_TICKS) -> DataFrame:
    """Zones left open between the bars around a middle bar, of three regular bars of one run."""
    run = Window.partitionBy("run_id").orderBy("bar_id")
    bars = bars.withColumns({"h0": F.lag("high").over(run), "l0": F.lag("low").over(run), "h2": F.lead("high").over(run), "l2": F.lead("low").over(run), "o2": F.lead("open").over(run)})
    bull = ((c("l2") - c("h0")) / TICK >= min_ticks) & ((c("o2") - c("close")) / TICK >= min_ticks)
    bear = ((c("l0") - c("h2")) / TICK >= min_ticks) & ((c("close") - c("o2")) / TICK >= min_ticks)
    zones = bars.withColumn("direction", F.when(bull, "bull").when(bear, "bear")).where("direction IS NOT NULL")
    zones = zones.withColumns({"zone_low": F.when(bull, c("h0")).otherwise(c("h2")), "zone_high": F.when(bull, c("l2")).otherwise(c("l0")), "middle_bar": c("bar_id"), "activation_bar": c("bar_id") + 1})
    number = F.row_number().over(Window.partitionBy("product", "trade_date").orderBy("middle_bar"))
    zone_id = F.concat_ws("-", "product", F.date_format("trade_date", "yyyyMMdd"), F.lpad(number.cast("string"), 4, "0"))
    return zones.withColumn("zone_id", zone_id).select("zone_id", "product", "trade_date", "direction", "middle_bar", "activation_bar", "zone_low", "zone_high", c("run_id").alias("zone_run"))


def retests(zones: DataFrame, bars: DataFrame, least_minute: int = 0) -> DataFrame:
    """Later bars of the zone's date whose range meets the zone, numbered; with a prior close beyond its far side."""
    b = bars.where(c("minute_of_day") >= least_minute).select("product", "trade_date", "bar_id", "minute_of_day", "open", "high", "low", "close")
    hit = zones.join(b, ["product", "trade_date"]).where(c("bar_id") > c("activation_bar"))
    far = F.when(c("direction") == "bull", c("close") < c("zone_low")).otherwise(c("close") > c("zone_high"))
    w = Window.partitionBy("zone_id").orderBy("bar_id")
    hit = hit.withColumn("violated_before", F.coalesce(F.max(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    hit = hit.where((c("high") >= c("zone_low")) & (c("low") <= c("zone_high")))
    return hit.withColumns({"retest_number": F.row_number().over(w), "minutes_since_previous": c("minute_of_day") - F.lag("minute_of_day").over(w)})


def candidates(touches: DataFrame, margin_ticks: int = 1) -> DataFrame:
    """Every retest as entries at the near side, the middle and the far side, with two stops and five targets in R."""
    touches = touches.withColumn("variant", F.explode(F.array(F.lit("boundary"), F.lit("midpoint"), F.lit("distal")))).withColumn("stop_model", F.explode(F.array(F.lit("zone"), F.lit("wide"))))
    bull = c("direction") == "bull"
    near, far = F.when(bull, c("zone_high")).otherwise(c("zone_low")), F.when(bull, c("zone_low")).otherwise(c("zone_high"))
    entry = F.when(c("variant") == "boundary", near).when(c("variant") == "midpoint", (near + far) / 2).otherwise(far)
    side = F.when(bull, 1).otherwise(-1)
    room = F.when(c("stop_model") == "zone", margin_ticks * TICK).otherwise(10 * margin_ticks * TICK + F.abs(near - far))
    touches = touches.withColumns({"side": side, "entry": entry, "stop": far - side * room})
    touches = touches.withColumn("risk_ticks", F.abs(c("entry") - c("stop")) / TICK).where(c("risk_ticks").between(*STOP_TICKS))
    return touches.withColumn("target_r", F.explode(F.array(*[F.lit(t) for t in TARGETS]))).withColumn("target", c("entry") + c("side") * c("target_r") * c("risk_ticks") * TICK)


def opportunities(bars: DataFrame, stop_atr: float = 1.5, reward: float = 2.0) -> DataFrame:
    """Both sides of every in-session decision: entry at the next open of the same run and date, stop and target from ATR20."""
    run = Window.partitionBy("run_id").orderBy("bar_id")
    nxt = lambda x: F.lead(x).over(run)
    rows = bars.withColumns({"entry_price": nxt("open"), "entry_bar": nxt("bar_id"), "entry_date": nxt("trade_date"), "entry_session": nxt("session")})
    rows = rows.where((c("entry_date") == c("trade_date")) & c("entry_session").isNotNull() & c("atr20").isNotNull())
    rows = rows.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("risk", stop_atr * c("atr20"))
    return rows.select("product", "trade_date", "run_id", "research_partition", c("bar_id").alias("decision_bar"), "entry_bar", "entry_session", "entry_price", "side", "risk", (c("entry_price") - c("side") * c("risk")).alias("stop"), (c("entry_price") + c("side") * reward * c("risk")).alias("target"))


def first_passage(opps: DataFrame, bars: DataFrame, hold: int = HOLD) -> DataFrame:
    """What each opportunity meets first on its path, stop before target on one bar; else the end of date or run, or time.

    exit_bar, exit_reason, gross_r; paths are joined by blocks of bar ids and reduced to least offsets.
    """
    opps = opps.withColumn("last_bar", c("entry_bar") + hold - 1)
    path = bars.select("product", "bar_id", "open", "high", "low", "close", c("trade_date").alias("path_date"), c("run_id").alias("path_run"))
    rows = range_join(opps, path, ["product"], "entry_bar", "last_bar", "bar_id")
    rows = rows.where((c("path_date") == c("trade_date")) & (c("path_run") == c("run_id")))
    long = c("side") == 1
    stop_hit = F.when(long, c("low") <= c("stop")).otherwise(c("high") >= c("stop"))
    target_hit = F.when(long, c("high") >= c("target")).otherwise(c("low") <= c("target"))
    keys = ["product", "decision_bar", "entry_bar", "side", "trade_date", "research_partition", "entry_session", "entry_price", "risk", "stop", "target"]
    out = rows.groupBy(*keys).agg(
        F.min(F.when(stop_hit, c("bar_id"))).alias("stop_bar"), F.min(F.when(target_hit, c("bar_id"))).alias("target_bar"), F.max("bar_id").alias("end_bar"), F.max_by("close", "bar_id").alias("end_close")
    )
    stopped = c("stop_bar").isNotNull() & (c("target_bar").isNull() | (c("stop_bar") <= c("target_bar")))
    reached = c("target_bar").isNotNull() & ~stopped
    reason = F.when(stopped, "stop").when(reached, "target").when(c("end_bar") < c("entry_bar") + hold - 1, "boundary_exit").otherwise("time_exit")
    price = F.when(stopped, c("stop")).when(reached, c("target")).otherwise(c("end_close"))
    return out.withColumns(
        {"exit_bar": F.when(stopped, c("stop_bar")).when(reached, c("target_bar")).otherwise(c("end_bar")), "exit_reason": reason, "gross_r": safe_div(c("side") * (price - c("entry_price")), c("risk")), "ambiguous": F.coalesce(c("stop_bar") == c("target_bar"), F.lit(False))}
    )


def walk_nonoverlap(trades: DataFrame, keys: list[str]) -> DataFrame:
    """trades (entry_bar, exit_bar, ...) with taken: one position at a time, in order of entry, the next after the last exit.

    Paths end with their date, so a date's trades (a bounded number) are one array, folded in order; nothing waits for
    another date.
    """
    rest = [x for x in trades.columns if x not in keys]
    rows = trades.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("entry_bar", "exit_bar", *[x for x in rest if x not in ("entry_bar", "exit_bar")]))).alias("t"))
    step = lambda s, x: F.struct(
        F.when(x["entry_bar"] > s["last"], x["exit_bar"]).otherwise(s["last"]).alias("last"), F.array_append(s["taken"], x["entry_bar"] > s["last"]).alias("taken")
    )
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<boolean>").alias("taken"))
    rows = rows.withColumn("taken", F.aggregate("t", start, step, lambda s: s["taken"]))
    return rows.select(*keys, F.explode(F.arrays_zip("t", "taken")).alias("x")).select(*keys, *[c(f"x.t.{r}").alias(r) for r in rest], c("x.taken").alias("taken"))


def deadband(x: Column, d: float, fade: bool = False) -> Column:
    """1 above d, -1 below -d, else 0; NULL is 0."""
    s = F.when(x > d, 1).when(x < -d, -1).otherwise(0)
    return -s if fade else s


def signals() -> dict[str, Column]:
    """A rule is a function of feature columns that gives -1, 0 or 1; any mapping of names to such Columns will do."""
    gate = F.coalesce(safe_div(c("rng"), c("atr20")) > 1.0, F.lit(False))
    return {
        "follow_momentum": deadband(c("disp5"), 0.5),
        "fade_momentum": deadband(c("disp5"), 1.0, fade=True),
        "follow_body": deadband(safe_div(c("body"), c("atr20")), 0.25),
        "gated_follow": F.when(gate, deadband(c("disp5"), 0.25)).otherwise(0),
        "both_sign": F.when((deadband(c("disp5"), 0.0) == deadband(c("disp15"), 0.0)), deadband(c("disp5"), 0.0)).otherwise(0),
        "london_fade": F.when(c("session") == "London", deadband(c("clv"), 0.5, fade=True)).otherwise(0),
        "always_long": F.lit(1),
    }


def fire_rates(bars: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Long, short and total share of rows of each rule: one aggregate for all rules."""
    wide = bars.withColumns({f"s_{n}": x for n, x in rules.items()}).agg(F.count("*").alias("n"), *[F.struct(F.sum((c(f"s_{n}") == 1).cast("long")).alias("longs"), F.sum((c(f"s_{n}") == -1).cast("long")).alias("shorts")).alias(n) for n in rules])
    rows = wide.select("n", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c(n)["longs"].alias("longs"), c(n)["shorts"].alias("shorts")) for n in rules])).alias("x"))
    return rows.select("x.rule", "x.longs", "x.shorts", ((c("x.longs") + c("x.shorts")) / c("n")).alias("fire_rate"))
