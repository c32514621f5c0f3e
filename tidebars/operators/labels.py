"""Forward labels: paths of h bars from the entry bar, which follows the decision bar.

All are frames that look ahead, rows 1 to h after the decision bar, in the order of a product's bars. A path that
crosses a gap, a segment or a date, or passes the forced exit, has a reason instead of labels; the first reason counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.order import edges_of
from tidebars.functions.windows import log_ratio, safe_div
from tidebars.sources.bars import FORCED_EXIT, LONDON, NEW_YORK, TICK

HORIZONS = (4, 8, 20)
EXPANSION = 0.8
c = F.col


def by_product():
    return Window.partitionBy("product").orderBy("bar_id")


def ahead(first: int, last: int):
    return by_product().rowsBetween(first, last)


def ordinal_position(h: int, extreme: Column, sign: int) -> Column:
    """1-based place of the first extreme on the path."""
    return F.min_by(c("bar_id"), F.struct(sign * extreme, c("bar_id"))).over(ahead(1, h)) - c("bar_id")


def decisions(bars: DataFrame) -> DataFrame:
    """Bars with the entry bar's price and clock."""
    return bars.withColumns({"entry_price": F.lead("open").over(by_product()), "entry_minute": F.lead("minute_of_day").over(by_product()), "entry_date": F.lead("trade_date").over(by_product()), "entry_session": F.lead("session").over(by_product())})


def with_reason(bars: DataFrame, h: int) -> DataFrame:
    """reason: available, or the first rule that the path of h bars breaks."""
    inner = ahead(2, h)
    broken = lambda code: F.coalesce(F.max((c("boundary_reason") == code).cast("int")).over(inner), F.lit(0)) == 1
    last_minute, last_date = F.last("minute_of_day").over(ahead(1, h)), F.last("trade_date").over(ahead(1, h))
    reason = (
        F.when(F.count("*").over(ahead(1, h)) < h, "insufficient_rows")
        .when(broken(2), "time_gap")
        .when(broken(5), "segment_change")
        .when(last_date != c("entry_date"), "date_change")
        .when((c("entry_minute") < FORCED_EXIT) & (last_minute >= FORCED_EXIT), "forced_exit")
        .otherwise("available")
    )
    return bars.withColumn("reason", reason)


def labelled(bars: DataFrame, h: int) -> DataFrame:
    """Decision rows with the labels of one horizon; NULL where the path isn't available."""
    bars = with_reason(decisions(bars), h).withColumn("step2", F.pow(log_ratio(c("close"), F.lag("close").over(by_product())), F.lit(2.0)))
    path, later = ahead(1, h), ahead(2, h)
    bars = bars.withColumns(
        {
            "exit_close": F.last("close").over(path),
            "n_path": F.count("*").over(path),
            "path_high": F.max("high").over(path),
            "path_low": F.min("low").over(path),
            "t_high": ordinal_position(h, c("high"), -1),
            "t_low": ordinal_position(h, c("low"), 1),
            "entry_close": F.lead("close").over(by_product()),
            "steps": F.coalesce(F.sum("step2").over(later), F.lit(0.0)),
        }
    )
    ok = lambda x: F.when(c("reason") == "available", x)
    move = c("exit_close") - c("entry_price")
    out = bars.withColumns(
        {
            "return_ticks": ok(F.rint(move / TICK).cast("int")),
            "return_bps": ok(1e4 * log_ratio(c("exit_close"), c("entry_price"))),
            "return_atr": ok(safe_div(move, c("atr20"))),
            "mfe_long": ok(c("path_high") - c("entry_price")),
            "mae_long": ok(c("entry_price") - c("path_low")),
            "mfe_short": ok(c("entry_price") - c("path_low")),
            "mae_short": ok(c("path_high") - c("entry_price")),
            "bars_to_high": ok(c("t_high").cast("int")),
            "bars_to_low": ok(c("t_low").cast("int")),
            "realized_vol": ok(1e4 * F.sqrt(F.pow(log_ratio(c("entry_close"), c("entry_price")), F.lit(2.0)) + c("steps"))),
            "range_atr": ok(safe_div(c("path_high") - c("path_low"), c("atr20"))),
        }
    )
    return out.withColumn("direction", F.signum("return_ticks").cast("int")).withColumn("horizon", F.lit(h))


def with_expansion(labels: DataFrame, q: float = EXPANSION) -> DataFrame:
    """expansion: whether the path's range reaches the Development quantile, which is one row to broadcast."""
    edge = edges_of(labels.where(c("research_partition") == "Development"), "range_atr", [q]).select(F.get("edges", F.lit(0)).alias("edge"))
    return labels.join(F.broadcast(edge)).withColumn("expansion", c("range_atr") >= c("edge"))


#: Rules of the decision/entry pair, in order.
RULES = ("has_entry", "exact_gap", "same_segment", "same_date", "entry_in_session", "entry_traded")


def eligible(bars: DataFrame) -> DataFrame:
    """Bars with one boolean per rule, true where it and all before hold."""
    nxt = lambda x: F.lead(x).over(by_product())
    minute = nxt("minute_of_day")
    rules = [
        nxt("bar_id").isNotNull(),
        F.coalesce(nxt("boundary_reason") != 2, F.lit(False)),
        F.coalesce(nxt("segment") == c("segment"), F.lit(False)),
        F.coalesce(nxt("trade_date") == c("trade_date"), F.lit(False)),
        F.coalesce(minute.between(LONDON[0], LONDON[1] - 1) | minute.between(NEW_YORK[0], NEW_YORK[1] - 1), F.lit(False)),
        F.coalesce(nxt("volume") >= 2, F.lit(False)),
    ]
    bars = bars.withColumns({f"rule_{n}": x for n, x in zip(RULES, rules, strict=True)})
    held: Column | None = None
    passed = {}
    for n in RULES:
        held = c(f"rule_{n}") if held is None else held & c(f"rule_{n}")
        passed[f"pass_{n}"] = held
    return bars.withColumns(passed)


def funnel(bars: DataFrame) -> DataFrame:
    """rule_no, rule, survivors: one aggregate, then its columns as rows."""
    counts = eligible(bars).agg(*[F.count_if(c(f"pass_{n}")).alias(n) for n in RULES])
    rows = counts.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("rule"), c(n).alias("survivors")) for n in RULES])).alias("pos", "x"))
    return rows.select((c("pos") + 1).cast("int").alias("rule_no"), "x.rule", "x.survivors")


def availability(labels: DataFrame) -> DataFrame:
    """Rows and share of each reason by horizon, session and partition."""
    keys = ["horizon", "entry_session", "research_partition"]
    counts = labels.where("entry_session IS NOT NULL").groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", c("n") / total)


def continuity_lag_pairs(bars: DataFrame, lag: int) -> DataFrame:
    """Bars paired with the one exactly lag buckets earlier of the same date and segment: an equi-join on time."""
    own = bars.select("product", "bar_ts", "trade_date", "segment", "close")
    before = own.select("product", (c("bar_ts") + F.expr(f"INTERVAL {15 * lag} MINUTES")).alias("bar_ts"), "trade_date", "segment", c("close").alias("close_before"))
    return own.join(before, ["product", "bar_ts", "trade_date", "segment"])


def forward_vol(bars: DataFrame, h: int) -> DataFrame:
    """Square root of the next h squared returns of the run; NULL where it ends earlier."""
    run = Window.partitionBy("run_id").orderBy("bar_id")
    bars = bars.withColumn("r2", F.pow(log_ratio(c("close"), F.lag("close").over(run)), F.lit(2.0)))
    w = run.rowsBetween(1, h)
    return bars.withColumn("forward_vol", F.when(F.count("r2").over(w) == h, F.sqrt(F.sum("r2").over(w))))
