"""Policies, their trades and their independent checks; zones with their lineage.

Paths are range joins by blocks of bar ids or frames of a bounded number of bars; positions are walked within a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.order import edges_of
from tidebars.functions.windows import safe_div
from tidebars.operators.events import HOLD, SWINGS, first_passage, prior_swing, walk_nonoverlap
from tidebars.operators.joins import range_join
from tidebars.sources.bars import TICK

c = F.col
#: Least and largest stop of signal candidates, in ticks, and of the two-tailed policy, in ticks. Fixed values.
SIGNAL_STOP, POLICY_STOP = (10, 100), (1, 1000)
COST_TICKS = 2.6


def clipped_stop(atr: Column, limits: tuple[int, int], width: float = 1.5) -> Column:
    return F.greatest(F.lit(limits[0] * TICK), F.least(F.lit(limits[1] * TICK), width * atr))


def entries(bars: DataFrame, side: Column, risk: Column, reward: float = 2.0) -> DataFrame:
    """Opportunities of one side a decision bar: entry at the next open of the same run, date and a session; side 0 is none."""
    run = Window.partitionBy("run_id").orderBy("bar_id")
    nxt = lambda x: F.lead(x).over(run)
    rows = bars.withColumns({"entry_price": nxt("open"), "entry_bar": nxt("bar_id"), "entry_date": nxt("trade_date"), "entry_session": nxt("session"), "side": side.cast("int"), "risk": risk})
    rows = rows.where((c("entry_date") == c("trade_date")) & c("entry_session").isNotNull() & c("risk").isNotNull() & (c("side") != 0))
    return rows.select("product", "trade_date", "run_id", "research_partition", c("bar_id").alias("decision_bar"), "entry_bar", "entry_session", "entry_price", "side", "risk", (c("entry_price") - c("side") * c("risk")).alias("stop"), (c("entry_price") + c("side") * reward * c("risk")).alias("target"))


def tails(rows: DataFrame, x: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """rows with side: -1 at or below a negative low tail, 1 at or above a positive high tail of Development, else 0; and the
    edges. An edge on the wrong side of zero opens no position."""
    edges = edges_of(rows.where("research_partition = 'Development'"), x, [low, high]).select(F.get("edges", F.lit(0)).alias("low_edge"), F.get("edges", F.lit(1)).alias("high_edge"))
    side = F.when((c(x) <= c("low_edge")) & (c("low_edge") < 0), -1).when((c(x) >= c("high_edge")) & (c("high_edge") > 0), 1).otherwise(0)
    return rows.join(F.broadcast(edges)).withColumn("side", side)


def simulate(opps: DataFrame, bars: DataFrame, keys: list[str], hold: int = HOLD) -> DataFrame:
    """Trades taken one at a time per key and date: what each opportunity meets first, then the walk."""
    if "trade_date" not in keys:
        raise ValueError("positions are walked within a date")
    extra = [k for k in keys if k not in ("product", "trade_date")]
    found = first_passage(opps.drop(*extra).distinct() if extra else opps, bars, hold)
    if extra:
        found = found.join(opps.select(*extra, "product", "decision_bar", "side"), ["product", "decision_bar", "side"])
    return walk_nonoverlap(found, keys).where("taken").drop("taken")


def resimulate(opps: DataFrame, bars: DataFrame, hold: int = HOLD) -> DataFrame:
    """The exits again by another formulation: the path is a frame of hold bars gathered at the entry bar and searched as an
    array; nothing is joined by range."""
    run = Window.partitionBy("product", "run_id", "trade_date").orderBy("bar_id")
    path = F.collect_list(F.struct("bar_id", "high", "low", "close")).over(run.rowsBetween(0, hold - 1))
    paths = bars.select("product", "run_id", "trade_date", c("bar_id").alias("entry_bar"), path.alias("path"))
    rows = opps.join(paths, ["product", "run_id", "trade_date", "entry_bar"])
    long = c("side") == 1
    first = lambda hit: F.get(F.filter("path", hit), F.lit(0))["bar_id"]
    rows = rows.withColumns(
        {
            "stop_at": first(lambda b: F.when(long, b["low"] <= c("stop")).otherwise(b["high"] >= c("stop"))),
            "target_at": first(lambda b: F.when(long, b["high"] >= c("target")).otherwise(b["low"] <= c("target"))),
            "last": F.element_at("path", -1),
        }
    )
    stopped = c("stop_at").isNotNull() & (c("target_at").isNull() | (c("stop_at") <= c("target_at")))
    price = F.when(stopped, c("stop")).when(c("target_at").isNotNull(), c("target")).otherwise(c("last.close"))
    reason = F.when(stopped, "stop").when(c("target_at").isNotNull(), "target").when(F.size("path") < hold, "boundary_exit").otherwise("time_exit")
    return rows.select("product", "decision_bar", "entry_bar", "side", F.coalesce(F.when(stopped, c("stop_at")), c("target_at"), c("last.bar_id")).alias("exit_bar"), reason.alias("exit_reason"), safe_div(c("side") * (price - c("entry_price")), c("risk")).alias("gross_r"))


def reconcile(recorded: DataFrame, again: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """status, n: recorded trades against re-simulated ones, by decision and side."""
    keys = ["product", "decision_bar", "side"]
    a = recorded.select(*keys, c("exit_bar").alias("a_bar"), c("exit_reason").alias("a_reason"), c("gross_r").alias("a_r"))
    b = again.select(*keys, c("exit_bar").alias("b_bar"), c("exit_reason").alias("b_reason"), c("gross_r").alias("b_r"))
    equal = (c("a_bar") == c("b_bar")) & (c("a_reason") == c("b_reason")) & (F.abs(c("a_r") - c("b_r")) <= tolerance)
    status = F.when(c("b_bar").isNull(), "only_recorded").when(c("a_bar").isNull(), "only_again").when(F.coalesce(equal, F.lit(False)), "equal").otherwise("different")
    return a.join(b, keys, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def time_exit(opps: DataFrame, bars: DataFrame, hold: int) -> DataFrame:
    """R at the horizon or the end of the date's run, -1 where the stop came first; targets don't matter."""
    free = opps.withColumn("target", c("entry_price") + c("side") * F.lit(float("inf")))
    out = first_passage(free, bars, hold)
    return out.withColumn("time_exit_r", F.when(c("exit_reason") == "stop", F.lit(-1.0)).otherwise(c("gross_r")))


def policy_summary(trades: DataFrame, calendar: DataFrame, cost_ticks: float = COST_TICKS, keys: tuple[str, ...] = ("research_partition",)) -> DataFrame:
    """Per key: trades, net ticks, annualised daily Sharpe over all eligible dates (none traded: zero), deepest drawdown and the
    share of the ten best days; trades: keys, trade_date, gross_ticks; calendar: keys, trade_date."""
    daily = trades.groupBy(*keys, "trade_date").agg(F.count("*").alias("trades"), F.sum(c("gross_ticks") - cost_ticks).alias("net"))
    days = calendar.join(daily, [*keys, "trade_date"], "left").na.fill(0, ["trades"]).na.fill(0.0, ["net"])
    w = Window.partitionBy(*keys).orderBy("trade_date")
    days = days.withColumn("equity", F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    days = days.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("net"), "trade_date")))
    gains = F.sum(F.when(c("net") > 0, c("net")))
    return days.groupBy(*keys).agg(
        F.count("*").alias("days"), F.sum("trades").alias("trades"), F.sum("net").alias("net_ticks"), (safe_div(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.max(c("peak") - c("equity")).alias("drawdown"), safe_div(F.sum(F.when((c("place") <= 10) & (c("net") > 0), c("net"))), gains).alias("top10_share"),
    )


def freeze(scores: DataFrame, support: int, k: int = 5) -> DataFrame:
    """The k best policies of those with enough trades in Development and Validation, by the sum of their mean results;
    scores: policy, research_partition, trades, mean_r."""
    wide = scores.groupBy("policy").pivot("research_partition", ["Development", "Validation"]).agg(F.first("trades").alias("trades"), F.first("mean_r").alias("mean_r"))
    wide = wide.select("policy", *[F.coalesce(f"{p}_trades", F.lit(0)).alias(f"{s}_trades") for p, s in (("Development", "dev"), ("Validation", "val"))], c("Development_mean_r").alias("dev_r"), c("Validation_mean_r").alias("val_r"))
    wide = wide.withColumn("score", F.round(c("dev_r") + c("val_r"), 9))
    decision = F.when((c("dev_r") > 0) & (c("val_r") > 0), "frozen").when(c("dev_r") > 0, "watch").otherwise("rejected")
    # k policies, whatever the number of trades
    return wide.where((c("dev_trades") >= support) & (c("val_trades") >= support)).withColumn("decision", decision).orderBy(F.desc("score"), "policy").limit(k)


def break_legs(bars: DataFrame, n: int, mode: str) -> DataFrame:
    """direction, leg_start, break_bar: the first break (close or wick) of a confirmed swing, and the opposite swing before it."""
    order = Window.partitionBy("product", "segment").orderBy("bar_id")
    rows = prior_swing(bars, n, order)
    up, down = ("close", "close") if mode == "close" else ("high", "low")
    keep = ["product", "segment", "trade_date", c("bar_id").alias("break_bar")]
    high = rows.where(c(up) > c("prior_high")).select(*keep, F.lit("bull").alias("direction"), c("prior_high_bar").alias("swing_bar"), c("prior_low_bar").alias("leg_start"))
    low = rows.where(c(down) < c("prior_low")).select(*keep, F.lit("bear").alias("direction"), c("prior_low_bar").alias("swing_bar"), c("prior_high_bar").alias("leg_start"))
    first = F.row_number().over(Window.partitionBy("product", "segment", "direction", "swing_bar").orderBy("break_bar"))
    legs = high.unionByName(low).withColumn("nth", first).where("nth = 1 AND leg_start IS NOT NULL").drop("nth")
    return legs.withColumns({"swing_n": F.lit(n), "break_mode": F.lit(mode)})


def zones_on_legs(zones: DataFrame, legs: DataFrame) -> DataFrame:
    """Zones whose middle bar lies between the start of a leg of their direction and its break, a range join by blocks."""
    own = zones.select("zone_id", "product", "direction", "trade_date", "middle_bar", "activation_bar", "zone_low", "zone_high")
    spans = legs.select("product", "direction", "trade_date", "swing_n", "break_mode", "leg_start", "break_bar", (c("leg_start") + 1).alias("leg_from"), (c("break_bar") - 1).alias("leg_to")).where("leg_from <= leg_to")
    return range_join(spans, own, ["product", "direction", "trade_date"], "leg_from", "leg_to", "middle_bar")


def detected(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones on legs over all swing sizes and both ways to break."""
    out = None
    for n in SWINGS:
        for mode in ("close", "wick"):
            rows = zones_on_legs(zones, break_legs(bars, n, mode))
            out = rows if out is None else out.unionByName(rows)
    return out


def collapsed(found: DataFrame) -> DataFrame:
    """One row a zone: how many variants have it, their smallest and largest swing, ways to break, and the variant of first
    priority (close before wick, larger swings first, then the earlier break)."""
    variant = F.concat_ws("/", "break_mode", "swing_n")
    first = F.min_by(F.struct(variant.alias("variant"), "break_bar"), F.struct("break_mode", -c("swing_n"), "break_bar"))
    out = found.groupBy("zone_id", "product", "trade_date", "direction", "middle_bar", "zone_low", "zone_high").agg(
        F.count_distinct(variant).alias("variants"), F.min("swing_n").alias("least_swing"), F.max("swing_n").alias("most_swing"), F.bool_or(c("break_mode") == "close").alias("by_close"), F.bool_or(c("break_mode") == "wick").alias("by_wick"), first.alias("first")
    )
    return out.withColumns({"variant": c("first.variant"), "break_bar": c("first.break_bar")}).drop("first")


def one_event_a_bar(events: DataFrame) -> DataFrame:
    """The frozen order among events of one decision bar: first touches, then structural zones, younger, narrower, then id."""
    order = Window.partitionBy("product", "bar_id").orderBy(F.desc(c("retest_number") == 1), F.desc("structural"), "age", "width", "zone_id")
    return events.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def paired_outcomes(events: DataFrame, bars: DataFrame, hold: int = HOLD) -> DataFrame:
    """Both hypotheses of every event, going on in the zone's direction and turning against it: best and worst excursion and R
    at the end of the path, and which side had the larger one; events: product, trade_date, run_id, bar_id, side, entry_price,
    risk, research_partition."""
    both = events.withColumn("hypothesis", F.explode(F.array(F.lit("continuation"), F.lit("reversal"))))
    both = both.withColumns({"way": F.when(c("hypothesis") == "continuation", c("side")).otherwise(-c("side")), "from_bar": c("bar_id") + 1, "to_bar": c("bar_id") + hold})
    path = bars.select("product", c("bar_id").alias("path_bar"), "high", "low", "close", c("trade_date").alias("path_date"), c("run_id").alias("path_run"))
    rows = range_join(both.withColumnRenamed("bar_id", "event_bar"), path, ["product"], "from_bar", "to_bar", "path_bar").where("path_date = trade_date AND path_run = run_id")
    up, down = F.max("high") - c("entry_price"), c("entry_price") - F.min("low")
    keys = ["zone_id", "event_bar", "hypothesis", "way", "entry_price", "risk", "research_partition"]
    out = rows.groupBy("product", *keys).agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.max_by("close", "path_bar").alias("end"), F.count("*").alias("bars"))
    up, down = c("top") - c("entry_price"), c("entry_price") - c("bottom")
    long = c("way") == 1
    out = out.withColumns({"mfe_r": safe_div(F.when(long, up).otherwise(down), c("risk")), "mae_r": safe_div(F.when(long, down).otherwise(up), c("risk")), "end_r": safe_div(c("way") * (c("end") - c("entry_price")), c("risk"))})
    wide = out.groupBy("zone_id", "event_bar", "research_partition", "bars").pivot("hypothesis", ["continuation", "reversal"]).agg(F.first("mfe_r").alias("mfe_r"), F.first("mae_r").alias("mae_r"), F.first("end_r").alias("end_r"))
    dominant = F.when(c("continuation_mfe_r") > c("reversal_mfe_r"), "continuation").when(c("continuation_mfe_r") < c("reversal_mfe_r"), "reversal").otherwise("neither")
    return wide.withColumns({"dominant": dominant, "held": c("continuation_mae_r") < 1.0})
