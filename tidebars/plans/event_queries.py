"""Queries of joins, events, trade paths and signals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.order import edges_of
from tidebars.operators import aggregates, events, features, joins
from tidebars.plans import sql
from tidebars.plans.sql import r, rounded
from tidebars.sources.bars import TICK, daily_prices, event_bars, table

c = F.col
HOUR = "INTERVAL 60 MINUTES"


def _spikes(spark: SparkSession, sf_dir: str, above: float = 150.0) -> DataFrame:
    return table(spark, sf_dir, "events").where(c("value") > above).select("event_id", c("event_type").alias("product"), "ts", "value")


def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir, 60, True).select("product", "bar_ts", "open")
    return joins.asof_next(_spikes(spark, sf_dir), bars, ["product"], "ts", "bar_ts", ["bar_ts", "open"]).select("event_id", "product", "bar_ts", rounded("open").alias("open"))


def asof_last_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir, 60, True).select("product", (c("bar_ts") + F.expr(HOUR)).alias("done"), "bar_ts", "close")
    return joins.asof_prior(_spikes(spark, sf_dir), bars, ["product"], "ts", "done", ["bar_ts", "close"]).select("event_id", "product", "bar_ts", rounded("close").alias("close"))


def exact_bar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the bar that must exist for their bucket: equal product and time."""
    bars = event_bars(spark, sf_dir, 60, True).select("product", "bar_ts", "bar_id")
    own = _spikes(spark, sf_dir).withColumn("bar_ts", F.window("ts", "60 minutes")["start"])
    return joins.validated_many_to_one(own, bars, ["product", "bar_ts"], "inner").select("event_id", "product", "bar_id")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir, 60, True)
    keep = ["bar_ts", "close", "high", "low", "session"]
    return joins.align(bars.where("product = 'click'").select(*keep), bars.where("product = 'purchase'").select(*keep), "bar_ts", TICK)


def minute_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("bar_ts", rounded("basis_ticks", 4).alias("basis_ticks"), c("contained").cast("int").alias("contained"))


def basis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir)
    return rows.groupBy("session").agg(
        F.count("*").alias("bars"), F.count("basis_ticks").alias("matched"), rounded(F.median(F.abs("basis_ticks")), 4).alias("median_basis"), rounded(F.percentile(F.abs("basis_ticks"), F.lit(0.95)), 4).alias("p95_basis"), rounded(F.avg(c("contained").cast("double"))).alias("containment")
    )


def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir).where("session IS NOT NULL").withColumn("weekday", F.dayofweek("trade_date"))
    hot = c("volume") >= 7
    out = joins.matched_controls(bars.where(hot).select("bar_id", "session", "weekday", "bar_ts"), bars.where(~hot), ["session", "weekday"], ["bar_id"], ["bar_id"], "bar_id")
    return out.select("bar_id", "session", c("weekday").cast("int").alias("weekday"), "control")


def anti_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line returned, counted by priority."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


def semi_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(c("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


def except_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with rows of flag A and none of flag N."""
    days = daily_prices(spark, sf_dir)
    return days.where("l_returnflag = 'A'").select("trade_date").exceptAll(days.where("l_returnflag = 'N'").select("trade_date"))


def intersect_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_prices(spark, sf_dir)
    return days.where("l_returnflag = 'A'").select("trade_date").intersect(days.where("l_returnflag = 'R'").select("trade_date"))


def recon_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of flag A against days of flag R, by date: which is missing, which differ by more than half."""
    days = daily_prices(spark, sf_dir)
    side = lambda f: days.where(c("l_returnflag") == f).select("trade_date", "close", "volume")
    return joins.reconcile(side("A"), side("R"), ["trade_date"], ["close", "volume"], 50.0).select("trade_date", "status")


def lead_one_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries joined to the bar one bucket before."""
    bars = event_bars(spark, sf_dir)
    before = bars.select((c("bar_ts") + F.expr("INTERVAL 15 MINUTES")).alias("bar_ts"), c("bar_id").alias("decision_bar"))
    return bars.where("session IS NOT NULL").select("bar_ts", "bar_id").join(before, "bar_ts").select("bar_ts", "bar_id", "decision_bar")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per user and day: dearest first, then earliest, then smallest id."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return joins.keep_first(rows, ["user_id", "day"], [F.desc("value"), c("ts"), c("event_id")]).select("user_id", "day", "event_id", rounded("value").alias("value"))


def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_key"))
    return joins.stratified_sample(rows, ["l_returnflag"], "line_key", 50, "audit")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_prices(spark, sf_dir).where("high > low")
    rows = joins.variants(days, {"stop_share": [0.25, 0.5], "target_r": [1, 2, 3]})
    risk = c("stop_share") * (c("high") - c("low"))
    rows = rows.withColumn("hit", c("high") - c("open") >= c("target_r") * risk)
    return rows.groupBy("l_returnflag", "stop_share", "target_r").agg(F.count("*").alias("n"), rounded(F.avg(c("hit").cast("double"))).alias("hit_rate"))


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.gap_zones(event_bars(spark, sf_dir))
    return rows.select("zone_id", "direction", "middle_bar", "activation_bar", rounded("zone_low").alias("zone_low"), rounded("zone_high").alias("zone_high"))


def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    out = None
    for n in events.SWINGS:
        own = events.swings(bars, n).select(F.lit(n).alias("swing_n"), "bar_id", "swing_high", "swing_low").where("swing_high OR swing_low")
        out = own if out is None else out.unionByName(own)
    return out


def prior_swing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.prior_swing(event_bars(spark, sf_dir), 5).select("bar_id", rounded("prior_high").alias("prior_high"), "prior_high_bar", rounded("prior_low").alias("prior_low"), "prior_low_bar")


def structural_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    out = None
    for n in events.STRUCTURAL:
        own = events.structural_breaks(bars, n)
        out = own if out is None else out.unionByName(own)
    return out.select("structural_window", "direction", "bar_id", "swing_bar", rounded("level").alias("level"))


def structural_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each zone's first structural break of its direction from five bars before the middle up to activation + 20."""
    bars = event_bars(spark, sf_dir)
    zones = events.gap_zones(bars).withColumns({"from_bar": c("middle_bar") - 5, "to_bar": c("activation_bar") + 20})
    breaks = events.structural_breaks(bars, 15).select("product", "direction", c("bar_id").alias("break_bar"), "level")
    hit = joins.range_join(zones, breaks, ["product", "direction"], "from_bar", "to_bar", "break_bar", 32)
    return hit.groupBy("zone_id").agg(F.min("break_bar").alias("break_bar"), F.count("*").alias("breaks"), rounded(F.min_by("level", F.struct("break_bar", "level"))).alias("level"))


def retest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    out = events.retests(events.gap_zones(bars), bars)
    return out.select("zone_id", "bar_id", "retest_number", "minutes_since_previous", "violated_before")


def lineage_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone with its first retest, if it has one."""
    bars = event_bars(spark, sf_dir)
    zones = events.gap_zones(bars)
    first = events.retests(zones, bars).where("retest_number = 1").select("zone_id", c("bar_id").alias("first_retest_bar"))
    return zones.select("zone_id", "direction").join(first, "zone_id", "left")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    out = events.candidates(events.retests(events.gap_zones(bars, 20), bars).where("retest_number = 1").withColumn("direction", c("direction")))
    return out.groupBy("direction", "variant", "stop_model", "target_r").agg(F.count("*").alias("n"), rounded(F.avg("risk_ticks"), 4).alias("mean_risk"), rounded(F.avg("target"), 4).alias("mean_target"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = features.prepared(event_bars(spark, sf_dir))
    return events.first_passage(events.opportunities(bars), bars)


def first_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("entry_bar", "side", "exit_bar", "exit_reason", rounded("gross_r").alias("gross_r"), "ambiguous")


def first_passage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _paths(spark, sf_dir).groupBy("research_partition", "entry_session", "side", "exit_reason").agg(F.count("*").alias("n"), rounded(F.avg("gross_r")).alias("mean_r"))
    return out


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).where("side = 1").select("product", "trade_date", "entry_bar", "exit_bar", "exit_reason", "gross_r", "research_partition", "entry_session", "risk")
    return events.walk_nonoverlap(rows, ["product", "trade_date"]).where("taken")


def walk_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir).select("trade_date", "entry_bar", "exit_bar", "exit_reason", rounded("gross_r").alias("gross_r"))


def cost_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net results under 0, 2.6 and 4.6 ticks of cost a trade."""
    rows = _trades(spark, sf_dir).withColumn("cost_ticks", F.explode(F.array(F.lit(0.0), F.lit(2.6), F.lit(4.6))))
    rows = rows.withColumn("net_r", c("gross_r") - c("cost_ticks") * TICK / c("risk"))
    return rows.groupBy("cost_ticks", "research_partition").agg(F.count("*").alias("trades"), rounded(F.avg("net_r")).alias("mean_net_r"), rounded(F.sum("net_r")).alias("total_net_r"))


def audit_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop and target exits within their exit bar's range, or beyond its open (a gap through)."""
    bars = features.prepared(event_bars(spark, sf_dir))
    rows = events.first_passage(events.opportunities(bars), bars).where("exit_reason IN ('stop', 'target')")
    rows = rows.withColumn("price", F.when(c("exit_reason") == "stop", c("stop")).otherwise(c("target")))
    at = bars.select("product", c("bar_id").alias("exit_bar"), c("open").alias("bar_open"), c("high").alias("bar_high"), c("low").alias("bar_low"))
    rows = rows.join(at, ["product", "exit_bar"])
    return rows.groupBy("exit_reason", "side").agg(F.count("*").alias("n"), F.count_if(c("price").between(c("bar_low"), c("bar_high"))).alias("inside"), F.count_if(~c("price").between(c("bar_low"), c("bar_high"))).alias("gapped"))


def strategy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = features.prepared(event_bars(spark, sf_dir))
    return bars.select("bar_id", *[x.cast("int").alias(n) for n, x in events.signals().items()])


def catalog_fire_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.fire_rates(features.prepared(event_bars(spark, sf_dir)), events.signals())
    return out.withColumn("fire_rate", rounded("fire_rate")).where("fire_rate >= 0.005")


def catalog_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development p10, p20, p50, p80, p90 of the features that rules refer to."""
    bars = features.prepared(event_bars(spark, sf_dir)).where("research_partition = 'Development'")
    qs = F.array(*[F.lit(q) for q in (0.1, 0.2, 0.5, 0.8, 0.9)])
    wide = bars.agg(*[F.percentile(n, qs).alias(n) for n in ("disp5", "clv", "relvol20", "rng")])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c(n).alias("q")) for n in ("disp5", "clv", "relvol20", "rng")])).alias("x"))
    return rows.select("x.feature", *[rounded(c("x.q")[i]).alias(n) for i, n in enumerate(("p10", "p20", "p50", "p80", "p90"))])


def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's trades: signals on decision bars meet the exits of that side, walked one at a time, then scored."""
    bars = features.prepared(event_bars(spark, sf_dir))
    rules = events.signals()
    signs = bars.select("product", c("bar_id").alias("decision_bar"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), x.cast("int").alias("side")) for n, x in rules.items()])).alias("x")).select("product", "decision_bar", "x.rule", "x.side")
    exits = events.first_passage(events.opportunities(bars), bars)
    rows = exits.join(signs.where("side <> 0"), ["product", "decision_bar", "side"]).select("rule", "product", "trade_date", "entry_bar", "exit_bar", "gross_r")
    taken = events.walk_nonoverlap(rows, ["rule", "product", "trade_date"]).where("taken")
    return taken.groupBy("rule").agg(F.count("*").alias("trades"), F.count_distinct("trade_date").alias("dates"), rounded(F.avg("gross_r")).alias("mean_r"), rounded(F.avg((c("gross_r") > 0).cast("double"))).alias("win_rate"))


def excursion_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running favourable and adverse excursion of long trades, bar by bar."""
    bars = features.prepared(event_bars(spark, sf_dir))
    trades = events.first_passage(events.opportunities(bars), bars).where("side = 1 AND exit_reason <> 'boundary_exit'").select("product", "entry_bar", "exit_bar", "entry_price", "risk")
    path = bars.select("product", c("bar_id").alias("path_bar"), "high", "low")
    rows = joins.range_join(trades, path, ["product"], "entry_bar", "exit_bar", "path_bar")
    from pyspark.sql import Window

    w = Window.partitionBy("product", "entry_bar").orderBy("path_bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"mfe_r": (F.max("high").over(w) - c("entry_price")) / c("risk"), "mae_r": (c("entry_price") - F.min("low").over(w)) / c("risk")})
    return rows.select("entry_bar", "path_bar", rounded("mfe_r").alias("mfe_r"), rounded("mae_r").alias("mae_r"))


def resample_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour bars from quarter-hour bars: buckets end with the date and the run, as stretches."""
    bars = features.islands(event_bars(spark, sf_dir), F.concat_ws("/", "trade_date", F.floor(c("minute_of_day") / 60)), "bucket")
    out = bars.groupBy("bucket").agg(F.min("bar_ts").alias("bar_ts"), F.min_by("open", "bar_id").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_id").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"))
    return out.select("bar_ts", "open", "high", "low", "close", "volume", "bars")


def context_same_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean volume of earlier bars of the same minute; before there is one, of all earlier bars of the product's day count so far."""
    from pyspark.sql import Window

    bars = event_bars(spark, sf_dir)
    past = Window.partitionBy("product", "minute_of_day").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, -1)
    return bars.select("bar_id", rounded(F.avg("volume").over(past)).alias("prior_mean_volume"), F.count("*").over(past).alias("prior_bars"))


def volatility_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by Development quartile class of ATR20: low, normal, high, extreme."""
    bars = features.prepared(event_bars(spark, sf_dir))
    edges = edges_of(bars.where("research_partition = 'Development'"), "atr20", [0.25, 0.75, 0.9], "e")
    x = c("atr20")
    bars = bars.join(F.broadcast(edges)).withColumn("bucket", F.when(x.isNull(), "unknown").when(x <= F.get("e", F.lit(0)), "low").when(x <= F.get("e", F.lit(1)), "normal").when(x <= F.get("e", F.lit(2)), "high").otherwise("extreme"))
    return bars.groupBy("research_partition", "bucket").agg(F.count("*").alias("bars"))


_ALL = (
    asof_next, asof_last_complete, exact_bar_join, minute_align, basis_stats, matched_controls, anti_join_orders, semi_join_orders, except_dates, intersect_dates, recon_full_outer, lead_one_bar, dedup_first, sample_stratified,
    variants, sequence_ids, swings, prior_swing_state, structural_breaks, structural_asof, retest_join, lineage_first, candidates, first_passage, first_passage_summary, walk_nonoverlap, cost_scenarios, audit_fills, strategy_signals,
    catalog_fire_rates, catalog_thresholds, strategy_scores, excursion_running, resample_tf, context_same_minute, volatility_buckets,
)
QUERIES: dict[str, sql.Query] = {{"swings": "swings", "sequence_ids": "fvg_zones"}.get(f.__name__, f.__name__): f for f in _ALL}

_B60 = f"WITH {sql.bars(60, True)}"
_B = f"WITH {sql.bars()}"
_F = f"WITH {sql.features()}"
_SPIKES = "spikes AS (SELECT event_id, event_type AS product, ts, value FROM events WHERE value > 150)"
_DAYS = """days AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS trade_date, first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"""
_ALIGNED = f"""al AS (SELECT a.bar_ts, a.session, (a.close - b.close) / {TICK} AS basis, a.close BETWEEN b.low AND b.high AS contained FROM (SELECT * FROM bars WHERE product = 'click') a LEFT JOIN (SELECT * FROM bars WHERE product = 'purchase') b USING (bar_ts))"""


def _swing(n: int, name: str, part: str = "product") -> str:
    k = n // 2
    p = f"PARTITION BY {part} ORDER BY bar_id"
    return f"""{name}a AS (SELECT *, count(*) OVER b = {k} AND count(*) OVER a = {k} AND high > greatest(max(high) OVER b, max(high) OVER a) AS swing_high,
  count(*) OVER b = {k} AND count(*) OVER a = {k} AND low < least(min(low) OVER b, min(low) OVER a) AS swing_low FROM bars
  WINDOW b AS ({p} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), a AS ({p} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)),
{name}b AS (SELECT *, lag(CASE WHEN swing_high THEN bar_id END, {k}) OVER ({p}) AS hk, lag(CASE WHEN swing_low THEN bar_id END, {k}) OVER ({p}) AS lk FROM {name}a),
{name}c AS (SELECT *, last_value(hk IGNORE NULLS) OVER q AS prior_high_bar, last_value(lk IGNORE NULLS) OVER q AS prior_low_bar FROM {name}b WINDOW q AS ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT x.*, h.high AS prior_high, l.low AS prior_low FROM {name}c x LEFT JOIN bars h ON h.product = x.product AND h.bar_id = x.prior_high_bar LEFT JOIN bars l ON l.product = x.product AND l.bar_id = x.prior_low_bar)"""


def _breaks(n: int, name: str) -> str:
    return f"""{_swing(n, name + 's', 'product, segment')},
{name}u AS (SELECT product, segment, 'bull' AS direction, bar_id, prior_high AS level, prior_high_bar AS swing_bar FROM {name}s WHERE close > prior_high
  UNION ALL SELECT product, segment, 'bear', bar_id, prior_low, prior_low_bar FROM {name}s WHERE close < prior_low),
{name} AS (SELECT {n} AS structural_window, product, segment, direction, swing_bar, min(bar_id) AS bar_id, arg_min(level, bar_id) AS level FROM {name}u GROUP BY ALL)"""


def _zones(ticks: int = 3, source: str = "bars") -> str:
    return f"""z0 AS (SELECT *, lag(high) OVER o AS h0, lag(low) OVER o AS l0, lead(high) OVER o AS h2, lead(low) OVER o AS l2, lead(open) OVER o AS o2 FROM {source} {sql.windows()}),
z1 AS (SELECT *, CASE WHEN (l2 - h0) / {TICK} >= {ticks} AND (o2 - close) / {TICK} >= {ticks} THEN 'bull' WHEN (l0 - h2) / {TICK} >= {ticks} AND (close - o2) / {TICK} >= {ticks} THEN 'bear' END AS direction FROM z0),
zones AS (SELECT product || '-' || strftime(trade_date, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (PARTITION BY product, trade_date ORDER BY bar_id) AS VARCHAR), 4, '0') AS zone_id, product, trade_date, direction, bar_id AS middle_bar, bar_id + 1 AS activation_bar,
  CASE WHEN direction = 'bull' THEN h0 ELSE h2 END AS zone_low, CASE WHEN direction = 'bull' THEN l2 ELSE l0 END AS zone_high FROM z1 WHERE direction IS NOT NULL)"""


_RETESTS = """rt0 AS (SELECT z.*, b.bar_id, b.minute_of_day, b.high, b.low, b.close, CASE WHEN z.direction = 'bull' THEN b.close < z.zone_low ELSE b.close > z.zone_high END AS far FROM zones z JOIN bars b ON b.product = z.product AND b.trade_date = z.trade_date AND b.bar_id > z.activation_bar),
rt1 AS (SELECT *, coalesce(bool_or(far) OVER (PARTITION BY zone_id ORDER BY bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS violated_before FROM rt0),
rt AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS retest_number, minute_of_day - lag(minute_of_day) OVER w AS minutes_since_previous FROM rt1 WHERE high >= zone_low AND low <= zone_high WINDOW w AS (PARTITION BY zone_id ORDER BY bar_id))"""
_PASSAGE = f"""op0 AS (SELECT *, lead(open) OVER o AS entry_price, lead(bar_id) OVER o AS entry_bar, lead(trade_date) OVER o AS entry_date, lead(session) OVER o AS entry_session FROM f {sql.windows()}),
op AS (SELECT product, trade_date, run_id, research_partition, bar_id AS decision_bar, entry_bar, entry_session, entry_price, side, 1.5 * atr20 AS risk, entry_price - side * 1.5 * atr20 AS stop, entry_price + side * 3.0 * atr20 AS target
  FROM op0, (VALUES (1), (-1)) s(side) WHERE entry_date = trade_date AND entry_session IS NOT NULL AND atr20 IS NOT NULL),
pt AS (SELECT op.*, b.bar_id, b.close AS c_, CASE WHEN side = 1 THEN b.low <= stop ELSE b.high >= stop END AS s_hit, CASE WHEN side = 1 THEN b.high >= target ELSE b.low <= target END AS t_hit
  FROM op JOIN f b ON b.product = op.product AND b.bar_id BETWEEN op.entry_bar AND op.entry_bar + {events.HOLD - 1} AND b.trade_date = op.trade_date AND b.run_id = op.run_id),
ex0 AS (SELECT product, trade_date, research_partition, decision_bar, entry_bar, entry_session, entry_price, side, risk, stop, target, min(bar_id) FILTER (s_hit) AS sb, min(bar_id) FILTER (t_hit) AS tb, max(bar_id) AS eb, arg_max(c_, bar_id) AS ec FROM pt GROUP BY ALL),
ex1 AS (SELECT *, coalesce(sb IS NOT NULL AND (tb IS NULL OR sb <= tb), false) AS stopped FROM ex0),
ex AS (SELECT *, CASE WHEN stopped THEN sb WHEN tb IS NOT NULL THEN tb ELSE eb END AS exit_bar, CASE WHEN stopped THEN 'stop' WHEN tb IS NOT NULL THEN 'target' WHEN eb < entry_bar + {events.HOLD - 1} THEN 'boundary_exit' ELSE 'time_exit' END AS exit_reason,
  side * (CASE WHEN stopped THEN stop WHEN tb IS NOT NULL THEN target ELSE ec END - entry_price) / nullif(risk, 0) AS gross_r, coalesce(sb = tb, false) AS ambiguous FROM ex1)"""
_WALK = """lg AS (SELECT * FROM ex WHERE side = 1),
wk AS (SELECT product, trade_date, min(entry_bar) AS entry_bar FROM lg GROUP BY ALL
  UNION ALL SELECT w.product, w.trade_date, (SELECT min(n.entry_bar) FROM lg n WHERE n.product = w.product AND n.trade_date = w.trade_date AND n.entry_bar > l.exit_bar) FROM wk w JOIN lg l ON l.product = w.product AND l.trade_date = w.trade_date AND l.entry_bar = w.entry_bar),
tr AS (SELECT lg.* FROM wk JOIN lg USING (product, trade_date, entry_bar))"""


def _recursive(with_clause: str) -> str:
    return with_clause.replace("WITH ", "WITH RECURSIVE ", 1)


def _band(x: str, d: float, sign: int = 1) -> str:
    return f"CASE WHEN ({x}) > {d} THEN {sign} WHEN ({x}) < -{d} THEN {-sign} ELSE 0 END"


_SIGNALS = {
    "follow_momentum": _band("disp5", 0.5),
    "fade_momentum": _band("disp5", 1.0, -1),
    "follow_body": _band("body / nullif(atr20, 0)", 0.25),
    "gated_follow": f"CASE WHEN coalesce(rng / nullif(atr20, 0) > 1.0, false) THEN {_band('disp5', 0.25)} ELSE 0 END",
    "both_sign": f"CASE WHEN {_band('disp5', 0.0)} = {_band('disp15', 0.0)} THEN {_band('disp5', 0.0)} ELSE 0 END",
    "london_fade": f"CASE WHEN session = 'London' THEN {_band('clv', 0.5, -1)} ELSE 0 END",
    "always_long": "1",
}
_SIG = "sg AS (SELECT product, bar_id, " + ", ".join(f"CAST({x} AS INTEGER) AS {n}" for n, x in _SIGNALS.items()) + " FROM f)"
_RULES = " UNION ALL ".join(f"SELECT '{n}' AS rule, product, bar_id, {n} AS side FROM sg" for n in _SIGNALS)
_SCORE = f"""rl AS ({_RULES}), lg AS (SELECT rule, ex.* FROM ex JOIN rl ON rl.product = ex.product AND rl.bar_id = ex.decision_bar AND rl.side = ex.side WHERE rl.side <> 0),
wk AS (SELECT rule, product, trade_date, min(entry_bar) AS entry_bar FROM lg GROUP BY ALL
  UNION ALL SELECT w.rule, w.product, w.trade_date, (SELECT min(n.entry_bar) FROM lg n WHERE n.rule = w.rule AND n.product = w.product AND n.trade_date = w.trade_date AND n.entry_bar > l.exit_bar) FROM wk w JOIN lg l ON l.rule = w.rule AND l.product = w.product AND l.trade_date = w.trade_date AND l.entry_bar = w.entry_bar),
tr AS (SELECT lg.* FROM wk JOIN lg USING (rule, product, trade_date, entry_bar))"""
_THRESHOLD = " UNION ALL ".join(f"SELECT '{n}' AS feature, " + ", ".join(f"{r(f'quantile_cont({n}, {q})')} AS {p}" for p, q in (("p10", 0.1), ("p20", 0.2), ("p50", 0.5), ("p80", 0.8), ("p90", 0.9))) + " FROM f WHERE research_partition = 'Development'" for n in ("disp5", "clv", "relvol20", "rng"))

ORACLE_SQL: dict[str, str] = {
    "asof_next": f"{_B60}, {_SPIKES} SELECT s.event_id, s.product, b.bar_ts, {r('b.open')} AS open FROM spikes s ASOF LEFT JOIN bars b ON s.product = b.product AND s.ts <= b.bar_ts",
    "asof_last_complete": f"{_B60}, {_SPIKES}, d AS (SELECT product, bar_ts + {HOUR} AS done, bar_ts, close FROM bars) SELECT s.event_id, s.product, b.bar_ts, {r('b.close')} AS close FROM spikes s ASOF LEFT JOIN d b ON s.product = b.product AND s.ts >= b.done",
    "exact_bar_join": f"{_B60}, {_SPIKES} SELECT s.event_id, s.product, b.bar_id FROM spikes s JOIN bars b ON b.product = s.product AND b.bar_ts = time_bucket({HOUR}, s.ts)",
    "minute_align": f"{_B60}, {_ALIGNED} SELECT bar_ts, {r('basis', 4)} AS basis_ticks, CAST(contained AS INTEGER) AS contained FROM al",
    "basis_stats": f"{_B60}, {_ALIGNED} SELECT session, count(*) AS bars, count(basis) AS matched, {r('median(abs(basis))', 4)} AS median_basis, {r('quantile_cont(abs(basis), 0.95)', 4)} AS p95_basis, {r('avg(CAST(contained AS DOUBLE))')} AS containment FROM al GROUP BY 1",
    "matched_controls": f"""{_B}, k AS (SELECT *, CAST(dayofweek(trade_date) + 1 AS INTEGER) AS weekday FROM bars WHERE session IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY session, weekday ORDER BY bar_id) AS i FROM k WHERE volume >= 7),
q AS (SELECT *, row_number() OVER (PARTITION BY session, weekday ORDER BY bar_id) AS n, count(*) OVER (PARTITION BY session, weekday) AS pool FROM k WHERE volume < 7)
SELECT e.bar_id, e.session, e.weekday, q.bar_id AS control FROM e JOIN q ON q.session = e.session AND q.weekday = e.weekday AND (e.i - 1) % q.pool + 1 = q.n""",
    "anti_join_orders": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1",
    "semi_join_orders": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45) GROUP BY 1",
    "except_dates": f"WITH {_DAYS} SELECT trade_date FROM days WHERE l_returnflag = 'A' EXCEPT ALL SELECT trade_date FROM days WHERE l_returnflag = 'N'",
    "intersect_dates": f"WITH {_DAYS} SELECT trade_date FROM days WHERE l_returnflag = 'A' INTERSECT SELECT trade_date FROM days WHERE l_returnflag = 'R'",
    "recon_full_outer": f"""WITH {_DAYS}, a AS (SELECT * FROM days WHERE l_returnflag = 'A'), b AS (SELECT * FROM days WHERE l_returnflag = 'R')
SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, CASE WHEN b.trade_date IS NULL THEN 'only_left' WHEN a.trade_date IS NULL THEN 'only_right' WHEN abs(a.close - b.close) <= 50 AND abs(a.volume - b.volume) <= 50 THEN 'equal' ELSE 'mismatch' END AS status
FROM a FULL JOIN b ON a.trade_date = b.trade_date""",
    "lead_one_bar": f"{_B} SELECT x.bar_ts, x.bar_id, y.bar_id AS decision_bar FROM bars x JOIN bars y ON y.bar_ts = x.bar_ts - INTERVAL 15 MINUTES WHERE x.session IS NOT NULL",
    "dedup_first": f"SELECT user_id, CAST(ts AS DATE) AS day, event_id, {r('value')} AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, ts, event_id) = 1",
    "sample_stratified": "SELECT l_returnflag, l_orderkey || '-' || l_linenumber AS line_key FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('audit:' || l_orderkey || '-' || l_linenumber)) <= 50",
    "variants": f"WITH {_DAYS} SELECT l_returnflag, stop_share, target_r, count(*) AS n, {r('avg(CASE WHEN high - open >= target_r * (stop_share * (high - low)) THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM days, (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) s(stop_share), (VALUES (1), (2), (3)) t(target_r) WHERE high > low GROUP BY ALL",
    "fvg_zones": f"{_B}, {_zones()} SELECT zone_id, direction, middle_bar, activation_bar, {r('zone_low')} AS zone_low, {r('zone_high')} AS zone_high FROM zones",
    "swings": f"{_B}, {', '.join(_swing(n, f'w{n}') for n in events.SWINGS)} " + " UNION ALL ".join(f"SELECT {n} AS swing_n, bar_id, swing_high, swing_low FROM w{n} WHERE swing_high OR swing_low" for n in events.SWINGS),
    "prior_swing_state": f"{_B}, {_swing(5, 'w')} SELECT bar_id, {r('prior_high')} AS prior_high, prior_high_bar, {r('prior_low')} AS prior_low, prior_low_bar FROM w",
    "structural_breaks": f"{_B}, {', '.join(_breaks(n, f'k{n}') for n in events.STRUCTURAL)} " + " UNION ALL ".join(f"SELECT structural_window, direction, bar_id, swing_bar, {r('level')} AS level FROM k{n}" for n in events.STRUCTURAL),
    "structural_asof": f"{_B}, {_zones()}, {_breaks(15, 'k')} SELECT zone_id, min(k.bar_id) AS break_bar, count(*) AS breaks, {r('first(level ORDER BY k.bar_id, level)')} AS level FROM zones z JOIN k ON k.product = z.product AND k.direction = z.direction AND k.bar_id BETWEEN z.middle_bar - 5 AND z.activation_bar + 20 GROUP BY 1",
    "retest_join": f"{_B}, {_zones()}, {_RETESTS} SELECT zone_id, bar_id, retest_number, minutes_since_previous, violated_before FROM rt",
    "lineage_first": f"{_B}, {_zones()}, {_RETESTS} SELECT z.zone_id, z.direction, rt.bar_id AS first_retest_bar FROM zones z LEFT JOIN rt ON rt.zone_id = z.zone_id AND rt.retest_number = 1",
    "candidates": f"""{_B}, {_zones(20)}, {_RETESTS},
cv AS (SELECT *, CASE WHEN direction = 'bull' THEN zone_high ELSE zone_low END AS near, CASE WHEN direction = 'bull' THEN zone_low ELSE zone_high END AS far_, CASE WHEN direction = 'bull' THEN 1 ELSE -1 END AS side FROM rt, (VALUES ('boundary'), ('midpoint'), ('distal')) v(variant), (VALUES ('zone'), ('wide')) m(stop_model) WHERE retest_number = 1),
ce AS (SELECT *, CASE variant WHEN 'boundary' THEN near WHEN 'midpoint' THEN (near + far_) / 2 ELSE far_ END AS entry, far_ - side * CASE WHEN stop_model = 'zone' THEN {TICK} ELSE {10 * TICK} + abs(near - far_) END AS stop FROM cv),
cr AS (SELECT *, abs(entry - stop) / {TICK} AS risk_ticks FROM ce)
SELECT direction, variant, stop_model, target_r, count(*) AS n, {r('avg(risk_ticks)', 4)} AS mean_risk, {r(f'avg(entry + side * target_r * risk_ticks * {TICK})', 4)} AS mean_target FROM cr, (VALUES (1), (2), (3), (4), (5)) t(target_r) WHERE risk_ticks BETWEEN 25 AND 100 GROUP BY ALL""",
    "first_passage": f"{_F}, {_PASSAGE} SELECT entry_bar, side, exit_bar, exit_reason, {r('gross_r')} AS gross_r, ambiguous FROM ex",
    "first_passage_summary": f"{_F}, {_PASSAGE} SELECT research_partition, entry_session, side, exit_reason, count(*) AS n, {r('avg(gross_r)')} AS mean_r FROM ex GROUP BY ALL",
    "walk_nonoverlap": f"{_recursive(_F)}, {_PASSAGE}, {_WALK} SELECT trade_date, entry_bar, exit_bar, exit_reason, {r('gross_r')} AS gross_r FROM tr",
    "cost_scenarios": f"{_recursive(_F)}, {_PASSAGE}, {_WALK} SELECT cost_ticks, research_partition, count(*) AS trades, {r(f'avg(gross_r - cost_ticks * {TICK} / risk)')} AS mean_net_r, {r(f'sum(gross_r - cost_ticks * {TICK} / risk)')} AS total_net_r FROM tr, (VALUES (0.0::DOUBLE), (2.6::DOUBLE), (4.6::DOUBLE)) k(cost_ticks) GROUP BY ALL",
    "audit_fills": f"""{_F}, {_PASSAGE}, pr AS (SELECT ex.*, CASE WHEN exit_reason = 'stop' THEN stop ELSE target END AS price, b.low AS bl, b.high AS bh FROM ex JOIN bars b ON b.product = ex.product AND b.bar_id = ex.exit_bar WHERE exit_reason IN ('stop', 'target'))
SELECT exit_reason, side, count(*) AS n, count(*) FILTER (price BETWEEN bl AND bh) AS inside, count(*) FILTER (NOT price BETWEEN bl AND bh) AS gapped FROM pr GROUP BY ALL""",
    "strategy_signals": f"{_F}, {_SIG} SELECT * EXCLUDE (product) FROM sg",
    "catalog_fire_rates": f"{_F}, {_SIG}, rl AS ({_RULES}) SELECT rule, count(*) FILTER (side = 1) AS longs, count(*) FILTER (side = -1) AS shorts, {r('avg(CASE WHEN side <> 0 THEN 1.0 ELSE 0.0 END)')} AS fire_rate FROM rl GROUP BY 1 HAVING avg(CASE WHEN side <> 0 THEN 1.0 ELSE 0.0 END) >= 0.005",
    "catalog_thresholds": f"{_F} {_THRESHOLD}",
    "strategy_scores": f"{_recursive(_F)}, {_PASSAGE}, {_SIG}, {_SCORE} SELECT rule, count(*) AS trades, count(DISTINCT trade_date) AS dates, {r('avg(gross_r)')} AS mean_r, {r('avg(CASE WHEN gross_r > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate FROM tr GROUP BY 1",
    "excursion_running": f"""{_F}, {_PASSAGE} SELECT ex.entry_bar, b.bar_id AS path_bar, {r('(max(b.high) OVER w - entry_price) / risk')} AS mfe_r, {r('(entry_price - min(b.low) OVER w) / risk')} AS mae_r
FROM ex JOIN bars b ON b.product = ex.product AND b.bar_id BETWEEN ex.entry_bar AND ex.exit_bar WHERE side = 1 AND exit_reason <> 'boundary_exit' WINDOW w AS (PARTITION BY ex.product, ex.entry_bar ORDER BY b.bar_id)""",
    "resample_tf": f"{_B}, {sql.islands('bars', '''trade_date || '/' || CAST(minute_of_day // 60 AS VARCHAR)''', 'bucket', 'k')} SELECT min(bar_ts) AS bar_ts, arg_min(open, bar_id) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_id) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars FROM k GROUP BY bucket",
    "context_same_minute": f"{_B} SELECT bar_id, {r('avg(volume) OVER p')} AS prior_mean_volume, count(*) OVER p AS prior_bars FROM bars WINDOW p AS (PARTITION BY product, minute_of_day ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "volatility_buckets": f"{_F}, q AS (SELECT quantile_cont(atr20, [0.25, 0.75, 0.9]) AS e FROM f WHERE research_partition = 'Development') SELECT research_partition, CASE WHEN atr20 IS NULL THEN 'unknown' WHEN atr20 <= e[1] THEN 'low' WHEN atr20 <= e[2] THEN 'normal' WHEN atr20 <= e[3] THEN 'high' ELSE 'extreme' END AS bucket, count(*) AS bars FROM f, q GROUP BY ALL",
}
