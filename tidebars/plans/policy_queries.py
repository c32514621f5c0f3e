"""Queries of policies and their checks, of zones with their lineage, and of reads and sinks; and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.windows import safe_div
from tidebars.operators import events, features, inference, labels, trades
from tidebars.plans import sql
from tidebars.plans.event_queries import _PASSAGE, _RETESTS, _SIGNALS, _swing, _zones
from tidebars.plans.label_queries import _path
from tidebars.plans.sql import r, rounded
from tidebars.sources import governed
from tidebars.sources.bars import TICK, daily_prices, event_bars, table

c = F.col
BETA = {"disp5": 0.4, "clv": -0.2, "relvol20": 0.1}
DAY = "2024-01-10"


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.prepared(event_bars(spark, sf_dir))


def policy_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a tail of the prediction, oriented, with the gross move in ticks of eight bars."""
    rows = trades.tails(labels.labelled(_prepared(spark, sf_dir), 8).withColumn("x", F.round("disp5", 6)), "x")
    rows = rows.where("side <> 0 AND reason = 'available' AND entry_session IS NOT NULL")
    return rows.select("product", "bar_id", "research_partition", "side", (c("side") * c("return_ticks")).alias("gross_ticks"))


def agg_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.tails(labels.labelled(_prepared(spark, sf_dir), 8).withColumn("x", F.round("disp5", 6)), "x").where("reason = 'available' AND entry_session IS NOT NULL")
    taken = rows.where("side <> 0").select("research_partition", "trade_date", (c("side") * c("return_ticks")).cast("double").alias("gross_ticks"))
    out = trades.policy_summary(taken, rows.select("research_partition", "trade_date").distinct())
    return out.select("research_partition", "days", "trades", rounded("net_ticks", 4).alias("net_ticks"), rounded("sharpe", 4).alias("sharpe"), rounded("drawdown", 4).alias("drawdown"), rounded("top10_share", 5).alias("top10_share"))


def signal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction as a weighted sum of Development z-scores, gated at the Development p80 of the session, with clipped stop and target."""
    rows = _prepared(spark, sf_dir).where("session IS NOT NULL")
    dev = rows.where("research_partition = 'Development'").agg(*[x for n in BETA for x in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))])
    z = lambda n: safe_div(c(n) - c(f"m_{n}"), c(f"s_{n}"))
    prediction = sum((F.lit(b) * z(n) for n, b in list(BETA.items())[1:]), F.lit(BETA["disp5"]) * z("disp5"))
    rows = rows.join(F.broadcast(dev)).withColumn("prediction", F.round(prediction, 6)).where("prediction IS NOT NULL")
    # a quantile a session: two sessions
    gates = rows.where("research_partition = 'Development'").groupBy("session").agg(F.percentile("prediction", F.lit(0.8)).alias("gate"))
    rows = rows.join(F.broadcast(gates), "session").where(c("prediction") >= c("gate")).withColumn("stop_distance", trades.clipped_stop(c("atr20"), trades.SIGNAL_STOP))
    return rows.select("product", "bar_id", "session", rounded("prediction", 5).alias("prediction"), rounded("stop_distance").alias("stop_distance"), rounded(2 * c("stop_distance")).alias("target_distance"))


def _policy_opportunities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = _prepared(spark, sf_dir)
    rows = trades.tails(bars.withColumn("x", F.round("disp5", 6)), "x")
    return trades.entries(rows, c("side"), trades.clipped_stop(c("atr20"), trades.POLICY_STOP)), bars


def tsay_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail signals held one at a time: a decision bar within an open position opens none."""
    opps, bars = _policy_opportunities(spark, sf_dir)
    out = trades.simulate(opps, bars, ["product", "trade_date"])
    return out.select("decision_bar", "side", "exit_bar", "exit_reason", rounded("gross_r").alias("gross_r"))


def verification_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits of all opportunities by the two formulations, reconciled."""
    bars = _prepared(spark, sf_dir)
    opps = events.opportunities(bars)
    return trades.reconcile(events.first_passage(opps, bars), trades.resimulate(opps, bars))


def resimulate_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _prepared(spark, sf_dir)
    return trades.resimulate(events.opportunities(bars), bars).select("entry_bar", "side", "exit_bar", "exit_reason", rounded("gross_r").alias("gross_r"))


def time_exit_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _prepared(spark, sf_dir)
    out = trades.time_exit(events.opportunities(bars), bars, 8)
    return out.groupBy("research_partition", "side").agg(F.count("*").alias("n"), F.count_if(c("time_exit_r") == -1).alias("stopped"), rounded(F.avg("time_exit_r"), 5).alias("mean_r"))


def cross_check_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry price and ATR of opportunities against the label table, one to one."""
    bars = _prepared(spark, sf_dir)
    opps = events.opportunities(bars).where("side = 1").select("product", c("decision_bar").alias("bar_id"), c("entry_price").alias("price"), (c("risk") / 1.5).alias("atr"))
    rows = opps.join(labels.decisions(bars).select("product", "bar_id", "entry_price", "atr20"), ["product", "bar_id"], "left")
    off = lambda a, b: ~F.coalesce(F.abs(c(a) - c(b)) <= 1e-9, F.lit(False))
    return rows.agg(F.count("*").alias("rows"), F.count_if(off("price", "entry_price")).alias("price_differs"), F.count_if(off("atr", "atr20")).alias("atr_differs"))


def _rule_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, trade columns: every rule's positions, walked on their own."""
    bars = _prepared(spark, sf_dir)
    rules = events.signals()
    sides = bars.select("product", "bar_id", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), x.cast("int").alias("side")) for n, x in rules.items()])).alias("x")).select("product", c("bar_id").alias("decision_bar"), "x.rule", "x.side").where("side <> 0")
    found = events.first_passage(events.opportunities(bars), bars).join(sides, ["product", "decision_bar", "side"])
    return events.walk_nonoverlap(found, ["rule", "product", "trade_date"]).where("taken")


def policy_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _rule_trades(spark, sf_dir).groupBy(c("rule").alias("policy"), "research_partition").agg(F.count("*").alias("trades"), F.avg("gross_r").alias("mean_r"))
    out = trades.freeze(scores, 10)
    return out.select("policy", "dev_trades", "val_trades", rounded("score", 5).alias("score"), "decision")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule's trades over a range of dates, with the clock of their entries."""
    bars = event_bars(spark, sf_dir)
    rows = _rule_trades(spark, sf_dir).where("rule = 'follow_momentum' AND trade_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'")
    at = bars.select("product", c("bar_id").alias("entry_bar"), c("bar_ts").alias("entry_ts"))
    return rows.join(at, ["product", "entry_bar"]).select("entry_bar", "entry_ts", "side", "exit_bar", "exit_reason", rounded("gross_r").alias("gross_r"))


def strategy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's run with its integrity checks: trades that overlap, end before they start, or leave their session's rules."""
    rows = _rule_trades(spark, sf_dir)
    w = Window.partitionBy("rule", "product", "trade_date").orderBy("entry_bar")
    rows = rows.withColumn("overlap", F.coalesce(c("entry_bar") <= F.lag("exit_bar").over(w), F.lit(False)))
    return rows.groupBy("rule").agg(
        F.count("*").alias("trades"), F.count_if("overlap").alias("overlapping"), F.count_if(c("exit_bar") < c("entry_bar")).alias("backward"), F.count_if(c("exit_bar") - c("entry_bar") >= events.HOLD).alias("too_long"),
        F.count_if((c("exit_reason") == "stop") & (F.abs(c("gross_r") + 1) > 1e-9)).alias("wrong_stop"), rounded(F.avg("gross_r"), 5).alias("mean_r"),
    )


def max_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per partition, the best rule by daily Sharpe ratio and its p-value against the best of all rules: a day by rule matrix a group."""
    import numpy as np
    import pandas as pd

    names = sorted(_SIGNALS)
    daily = _rule_trades(spark, sf_dir).groupBy("research_partition", "trade_date").pivot("rule", names).agg(F.sum("gross_r")).na.fill(0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("trade_date")[names].to_numpy(float)
        ratios = [inference.sharpe(m[:, i]) if len(m) > 1 else float("nan") for i in range(len(names))]
        if np.isnan(ratios).all():
            return pd.DataFrame([(pdf["research_partition"].iloc[0], len(m), None, None, None)], columns=["research_partition", "days", "rule", "sharpe", "p"])
        best = int(np.nanargmax(ratios))
        return pd.DataFrame([(pdf["research_partition"].iloc[0], len(m), names[best], ratios[best], inference.max_sharpe_p(m, best, 17))], columns=["research_partition", "days", "rule", "sharpe", "p"])

    return daily.groupBy("research_partition").applyInPandas(run, "research_partition string, days long, rule string, sharpe double, p double")


def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily result of a candidate less that of its comparator; a day without trades is zero for either."""
    daily = _rule_trades(spark, sf_dir).where("rule IN ('follow_momentum', 'always_long')").groupBy("rule", "trade_date").agg(F.sum("gross_r").alias("r"))
    a = daily.where("rule = 'follow_momentum'").select("trade_date", c("r").alias("candidate"))
    b = daily.where("rule = 'always_long'").select("trade_date", c("r").alias("comparator"))
    out = a.join(b, "trade_date", "full").na.fill(0.0)
    return out.select("trade_date", rounded("candidate").alias("candidate"), rounded("comparator").alias("comparator"), rounded(c("candidate") - c("comparator")).alias("delta"))


def break_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return trades.detected(bars, events.gap_zones(bars)).select("zone_id", "swing_n", "break_mode", "leg_start", "break_bar")


def poi_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return trades.collapsed(trades.detected(bars, events.gap_zones(bars))).select("zone_id", "direction", "variants", "least_swing", "most_swing", "by_close", "by_wick", "variant", "break_bar")


def _touch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retests with the lineage of their zone: whether a leg has it, age and width."""
    bars = event_bars(spark, sf_dir)
    zones = events.gap_zones(bars)
    legs = trades.detected(bars, zones).select("zone_id").distinct().withColumn("structural", F.lit(True))
    touches = events.retests(zones, bars).join(legs, "zone_id", "left").withColumn("structural", F.coalesce("structural", F.lit(False)))
    return touches.withColumns({"age": c("bar_id") - c("middle_bar"), "width": F.round(c("zone_high") - c("zone_low"), 6)})


def enrich_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retests with a canonical number: zones of one direction and the same edges in cents on a date are one, bars count once."""
    rows = _touch_events(spark, sf_dir).withColumn("canonical", F.concat_ws("/", "product", "trade_date", "direction", F.round("zone_low", 0).cast("int"), F.round("zone_high", 0).cast("int")))
    number = F.dense_rank().over(Window.partitionBy("canonical").orderBy("bar_id"))
    return rows.select("zone_id", "bar_id", "structural", "age", number.alias("canonical_number"))


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.one_event_a_bar(_touch_events(spark, sf_dir)).select("bar_id", "zone_id", "retest_number", "structural", "age")


def population_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches, first touches, and one event a bar, by direction."""
    rows = _touch_events(spark, sf_dir)
    one = trades.one_event_a_bar(rows)
    named = [(rows, "raw"), (rows.where("retest_number = 1"), "first"), (one, "one_a_bar")]
    out = None
    for part, name in named:
        n = part.groupBy("direction").agg(F.count("*").alias("n"), F.count_if("structural").alias("structural")).withColumn("population", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


def signal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches by buckets of age, width, number and time since the touch before."""
    rows = _touch_events(spark, sf_dir)
    ladder = lambda x, steps: F.coalesce(*[F.when(c(x) <= s, F.lit(f"to_{s}")) for s in steps], F.when(c(x).isNotNull(), F.lit("more")), F.lit("none"))
    rows = rows.withColumns({"age_bucket": ladder("age", (4, 12, 24)), "number_bucket": ladder("retest_number", (1, 2, 4)), "since_bucket": ladder("minutes_since_previous", (15, 60)), "clock_bucket": F.when(c("minute_of_day") < 720, "am").otherwise("pm")})
    return rows.groupBy("age_bucket", "number_bucket", "since_bucket", "clock_bucket").agg(F.count("*").alias("n"), F.count_if("violated_before").alias("violated"))


def candidate_policy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen eligibility predicates over touches, each counted alone and together."""
    rows = _touch_events(spark, sf_dir)
    masks = {"structural_only": c("structural"), "first_touch": c("retest_number") == 1, "young": c("age") <= 12, "intact": ~c("violated_before"), "morning": c("minute_of_day") < 720}
    both = c("structural") & (c("retest_number") == 1) & ~c("violated_before")
    wide = rows.agg(*[F.count_if(x).alias(n) for n, x in {**masks, "frozen": both}.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), c(n).alias("rows")) for n in (*masks, "frozen")])).alias("x")).select("x.*")


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, one a bar, with side, price and risk."""
    bars = _prepared(spark, sf_dir).select("product", "bar_id", "run_id", "research_partition", "atr20")
    rows = trades.one_event_a_bar(_touch_events(spark, sf_dir)).select("zone_id", "product", "trade_date", "direction", "bar_id", "close", "zone_low", "zone_high")
    rows = rows.join(bars, ["product", "bar_id"]).where("atr20 IS NOT NULL")
    return rows.withColumns({"side": F.when(c("direction") == "bull", 1).otherwise(-1), "entry_price": c("close"), "risk": 1.5 * c("atr20")})


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trades.paired_outcomes(_event_rows(spark, sf_dir).drop("close"), event_bars(spark, sf_dir))
    names = ("continuation_mfe_r", "continuation_mae_r", "continuation_end_r", "reversal_mfe_r")
    return out.select("zone_id", "event_bar", "bars", *[rounded(n).alias(n) for n in names], "dominant", "held")


def poi_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches entered at the zone's near edge within the bar, stop beyond the far edge, target from the risk; one position at a time."""
    bars = event_bars(spark, sf_dir)
    rows = _event_rows(spark, sf_dir)
    bull = c("side") == 1
    near, far = F.when(bull, c("zone_high")).otherwise(c("zone_low")), F.when(bull, c("zone_low")).otherwise(c("zone_high"))
    risk = F.abs(near - far) + 10 * TICK
    opps = rows.select("product", "trade_date", "run_id", "research_partition", c("bar_id").alias("decision_bar"), c("bar_id").alias("entry_bar"), F.lit("zone").alias("entry_session"), near.alias("entry_price"), "side", risk.alias("risk"), (near - c("side") * risk).alias("stop"), (near + c("side") * 2 * risk).alias("target"))
    out = trades.simulate(opps, bars, ["product", "trade_date"])
    return out.select("entry_bar", "side", "exit_bar", "exit_reason", rounded("gross_r").alias("gross_r"))


def simulate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' positions, each walked on its own."""
    bars = _prepared(spark, sf_dir)
    found = events.first_passage(events.opportunities(bars), bars)
    out = events.walk_nonoverlap(found, ["side", "product", "trade_date"]).where("taken")
    return out.groupBy("side", "research_partition", "exit_reason").agg(F.count("*").alias("n"), rounded(F.avg("gross_r"), 5).alias("mean_r"))


def nlargest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best and the ten worst days of a flag: a report."""
    days = daily_prices(spark, sf_dir).where("l_returnflag = 'N'").select("trade_date", rounded(c("close") - c("open"), 4).alias("move"))
    best = days.orderBy(F.desc("move"), "trade_date").limit(10).withColumn("end", F.lit("best"))
    return best.unionByName(days.orderBy("move", "trade_date").limit(10).withColumn("end", F.lit("worst")))


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for figures and tables from bar columns: clock, session, direction, range in ticks."""
    rows = event_bars(spark, sf_dir)
    clock = F.concat_ws(":", F.lpad(F.floor(c("minute_of_day") / 60).cast("string"), 2, "0"), F.lpad((c("minute_of_day") % 60).cast("string"), 2, "0"))
    way = F.when(c("close") > c("open"), "up").when(c("close") < c("open"), "down").otherwise("flat")
    return rows.select("bar_id", F.concat_ws(" ", F.coalesce("session", F.lit("off")), clock, way, F.initcap(F.lower("research_partition"))).alias("label"))


def verif_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices alone, read again from the ticks without the library's bars, for independent checks."""
    ticks = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    bucket = F.floor(F.unix_micros(c("ts").cast("timestamp")) / 900_000_000).cast("long")
    first, last = F.min(F.struct("ts", "event_id", "value")), F.max(F.struct("ts", "event_id", "value"))
    rows = ticks.groupBy(bucket.alias("bucket")).agg(first.alias("f"), last.alias("l"), F.max("value").alias("high"), F.min("value").alias("low"))
    return rows.select(F.timestamp_seconds(c("bucket") * 900).cast("timestamp_ntz").alias("bar_ts"), c("f.value").alias("open"), "high", "low", c("l.value").alias("close"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order with its lines by key: the predicate reaches both scans."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey = 32").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey = 32").select("l_orderkey", "l_linenumber", "l_quantity")
    return orders.join(lines, c("o_orderkey") == c("l_orderkey")).select("o_orderkey", "o_orderpriority", "l_linenumber", "l_quantity")


def day_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks of one day and type: both predicates reach the scan."""
    rows = table(spark, sf_dir, "events").where(f"ts >= TIMESTAMP_NTZ '{DAY} 00:00:00' AND ts < TIMESTAMP_NTZ '{DAY} 00:00:00' + INTERVAL 1 DAY AND event_type = 'click'")
    return rows.select("event_id", "ts", rounded("value").alias("value"))


def labels_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the labels that an evaluation reads, by quality."""
    return table(spark, sf_dir, "labels").select("quality", "toxic").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def _scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tidebars/{name}-{uuid.uuid4().hex}"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_prices(spark, sf_dir).select("l_returnflag", "trade_date", "close", c("volume").cast("long").alias("volume"))


def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV in order of its keys, with its manifest, verified and read back."""
    entry = governed.save_csv(_daily(spark, sf_dir), _scratch(spark, "csv"), ["l_returnflag", "trade_date"])
    return governed.load_csv(spark, entry)


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = governed.save_json(_daily(spark, sf_dir), _scratch(spark, "json"), ["l_returnflag", "trade_date"])
    return governed.load_json(spark, entry)


def publish_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables staged, swapped in together over older ones, and read from where they were published."""
    base = _scratch(spark, "published")
    rows = _daily(spark, sf_dir)
    for name in ("days", "flags"):
        rows.limit(0).write.parquet(f"{base}/{name}")
    rows.write.parquet(f"{base}/staged/days")
    rows.select("l_returnflag").distinct().write.parquet(f"{base}/staged/flags")
    governed.publish(spark, {f"{base}/staged/{n}": f"{base}/{n}" for n in ("days", "flags")})
    return spark.read.parquet(f"{base}/days").join(spark.read.parquet(f"{base}/flags"), "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("days"), F.sum("volume").alias("volume"))


_ALL = (
    policy_tails, agg_policy, signal_candidates, tsay_policy, verification_run, resimulate_independent, time_exit_r, cross_check_labels, policy_freeze, replay, strategy_run, max_stat, paired_diff, break_legs, poi_tables, enrich_lineage, dedup_events,
    population_variants, signal_buckets, candidate_policy_mask, paired_outcomes, poi_sequential, simulate_positions, nlargest, text_labels, verif_bars, point_lookup, day_read, labels_eval, sink_csv, sink_json, publish_dirs,
)
QUERIES: dict[str, sql.Query] = {f.__name__: f for f in _ALL}

_B = f"WITH {sql.bars()}"
_F = f"WITH {sql.features()}"
_TAIL = "ed AS (SELECT quantile_cont(round(disp5, 6), 0.1) AS lo, quantile_cont(round(disp5, 6), 0.9) AS hi FROM {source} WHERE research_partition = 'Development'), tl AS (SELECT s.*, CASE WHEN round(disp5, 6) <= lo AND lo < 0 THEN -1 WHEN round(disp5, 6) >= hi AND hi > 0 THEN 1 ELSE 0 END AS side FROM {source} s, ed)"
_CAL = f"{_F}, {_path(8)}, {_TAIL.format(source='l')}, av AS (SELECT * FROM tl WHERE reason = 'available' AND entry_session IS NOT NULL)"
_CLIP = lambda lo, hi: f"greatest({lo * TICK}, least({hi * TICK}, 1.5 * atr20))"


def _exits(opps: str, name: str = "ex", hold: int = events.HOLD) -> str:
    """CTEs of exits over opportunities (product, run_id, trade_date, decision_bar, entry_bar, entry_price, side, risk, stop, target, ...)."""
    return f"""{name}p AS (SELECT o.*, b.bar_id, b.close AS c_, CASE WHEN side = 1 THEN b.low <= stop ELSE b.high >= stop END AS s_hit, CASE WHEN side = 1 THEN b.high >= target ELSE b.low <= target END AS t_hit
  FROM {opps} o JOIN bars b ON b.product = o.product AND b.bar_id BETWEEN o.entry_bar AND o.entry_bar + {hold - 1} AND b.trade_date = o.trade_date AND b.run_id = o.run_id),
{name}0 AS (SELECT product, trade_date, research_partition, decision_bar, entry_bar, entry_price, side, risk, stop, target, min(bar_id) FILTER (s_hit) AS sb, min(bar_id) FILTER (t_hit) AS tb, max(bar_id) AS eb, arg_max(c_, bar_id) AS ec FROM {name}p GROUP BY ALL),
{name}1 AS (SELECT *, coalesce(sb IS NOT NULL AND (tb IS NULL OR sb <= tb), false) AS stopped FROM {name}0),
{name} AS (SELECT *, CASE WHEN stopped THEN sb WHEN tb IS NOT NULL THEN tb ELSE eb END AS exit_bar, CASE WHEN stopped THEN 'stop' WHEN tb IS NOT NULL THEN 'target' WHEN eb < entry_bar + {hold - 1} THEN 'boundary_exit' ELSE 'time_exit' END AS exit_reason,
  side * (CASE WHEN stopped THEN stop WHEN tb IS NOT NULL THEN target ELSE ec END - entry_price) / nullif(risk, 0) AS gross_r FROM {name}1)"""


def _walked(source: str, keys: str) -> str:
    """wk, tr: positions one at a time per keys."""
    names = [k.strip() for k in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)
    return f"""wk AS (SELECT {keys}, min(entry_bar) AS entry_bar FROM {source} GROUP BY ALL
  UNION ALL SELECT {', '.join(f'w.{k}' for k in names)}, (SELECT min(n.entry_bar) FROM {source} n WHERE {same('n', 'w')} AND n.entry_bar > l.exit_bar) FROM wk w JOIN {source} l ON {same('l', 'w')} AND l.entry_bar = w.entry_bar),
tr AS (SELECT s.* FROM wk JOIN {source} s USING ({keys}, entry_bar))"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_SIDES = " UNION ALL ".join(f"SELECT '{n}' AS rule, product, bar_id, CAST({x} AS INTEGER) AS side FROM f" for n, x in _SIGNALS.items())
_RULE_TRADES = f"{_recursive(_F)}, {_PASSAGE}, rl AS ({_SIDES}), rx AS (SELECT rule, ex.* FROM ex JOIN rl ON rl.product = ex.product AND rl.bar_id = ex.decision_bar AND rl.side = ex.side WHERE rl.side <> 0), {_walked('rx', 'rule, product, trade_date')}"


def _legs(n: int, mode: str) -> str:
    up, down = ("close", "close") if mode == "close" else ("high", "low")
    s = f"sw{n}"
    return f"""SELECT {n} AS swing_n, '{mode}' AS break_mode, product, segment, direction, swing_bar, arg_min(trade_date, bar_id) AS trade_date, min(bar_id) AS break_bar, arg_min(leg_start, bar_id) FILTER (leg_start IS NOT NULL OR true) AS leg_start FROM (
SELECT product, segment, trade_date, bar_id, 'bull' AS direction, prior_high_bar AS swing_bar, coalesce(prior_low_bar, -1) AS leg_start FROM {s} WHERE {up} > prior_high UNION ALL SELECT product, segment, trade_date, bar_id, 'bear', prior_low_bar, coalesce(prior_high_bar, -1) FROM {s} WHERE {down} < prior_low) GROUP BY product, segment, direction, swing_bar"""


_LEGS = ", ".join(_swing(n, f"sw{n}", "product, segment") for n in events.SWINGS) + ", legs AS (" + " UNION ALL ".join(_legs(n, m) for n in events.SWINGS for m in ("close", "wick")) + ")"
_DETECTED = f"{_zones()}, {_LEGS}, dt AS (SELECT z.*, swing_n, break_mode, leg_start, break_bar FROM zones z JOIN legs g ON g.product = z.product AND g.direction = z.direction AND g.trade_date = z.trade_date AND leg_start >= 0 AND z.middle_bar BETWEEN leg_start + 1 AND break_bar - 1)"
_TOUCHES = f"{_DETECTED}, {_RETESTS}, tv AS (SELECT rt.*, EXISTS (SELECT 1 FROM dt WHERE dt.zone_id = rt.zone_id) AS structural, bar_id - middle_bar AS age, round(zone_high - zone_low, 6) AS width FROM rt)"
_ONE = "one AS (SELECT * FROM tv QUALIFY row_number() OVER (PARTITION BY product, bar_id ORDER BY (retest_number = 1) DESC, structural DESC, age, width, zone_id) = 1)"
_EVENT = f"{_TOUCHES}, {_ONE}, er AS (SELECT one.zone_id, one.product, one.trade_date, one.direction, one.bar_id, one.close, one.zone_low, one.zone_high, f.run_id, f.research_partition, f.atr20, CASE WHEN one.direction = 'bull' THEN 1 ELSE -1 END AS side, 1.5 * f.atr20 AS risk FROM one JOIN f ON f.product = one.product AND f.bar_id = one.bar_id WHERE f.atr20 IS NOT NULL)"
_LADDER = lambda x, steps: "CASE " + " ".join(f"WHEN {x} <= {s} THEN 'to_{s}'" for s in steps) + f" WHEN {x} IS NOT NULL THEN 'more' ELSE 'none' END"
_Z = lambda n: f"({n} - m_{n}) / nullif(s_{n}, 0)"
_MASKS = {"structural_only": "structural", "first_touch": "retest_number = 1", "young": "age <= 12", "intact": "NOT violated_before", "morning": "minute_of_day < 720", "frozen": "structural AND retest_number = 1 AND NOT violated_before"}
_DAILY = """dp AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS trade_date, last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY ALL)"""
_OPPS = f"""oq AS (SELECT *, lead(open) OVER o AS entry_price, lead(bar_id) OVER o AS entry_bar, lead(trade_date) OVER o AS entry_date, lead(session) OVER o AS es, {_CLIP(*trades.POLICY_STOP)} AS risk_ FROM tl {sql.windows()}),
oc AS (SELECT product, trade_date, run_id, research_partition, bar_id AS decision_bar, entry_bar, entry_price, side, risk_ AS risk, entry_price - side * risk_ AS stop, entry_price + side * 2 * risk_ AS target FROM oq WHERE side <> 0 AND entry_date = trade_date AND es IS NOT NULL AND atr20 IS NOT NULL)"""

ORACLE_SQL: dict[str, str] = {
    "policy_tails": f"{_CAL} SELECT product, bar_id, research_partition, side, side * return_ticks AS gross_ticks FROM av WHERE side <> 0",
    "agg_policy": f"""{_CAL}, cal AS (SELECT DISTINCT research_partition, trade_date FROM av), dd AS (SELECT research_partition, trade_date, count(*) AS n, sum(side * return_ticks - {trades.COST_TICKS}) AS net FROM av WHERE side <> 0 GROUP BY ALL),
d AS (SELECT research_partition, trade_date, coalesce(n, 0) AS n, coalesce(net, 0.0) AS net FROM cal LEFT JOIN dd USING (research_partition, trade_date)),
e AS (SELECT *, sum(net) OVER w AS equity, row_number() OVER (PARTITION BY research_partition ORDER BY net DESC, trade_date) AS place FROM d WINDOW w AS (PARTITION BY research_partition ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY research_partition ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM e)
SELECT research_partition, count(*) AS days, CAST(sum(n) AS BIGINT) AS trades, {r('sum(net)', 4)} AS net_ticks, {r('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0)', 4)} AS sharpe, {r('max(peak - equity)', 4)} AS drawdown, {r('sum(net) FILTER (place <= 10 AND net > 0) / nullif(sum(net) FILTER (net > 0), 0)', 5)} AS top10_share FROM g GROUP BY 1""",
    "signal_candidates": f"""{_F}, q AS (SELECT * FROM f WHERE session IS NOT NULL), dv AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}' for n in BETA)} FROM q WHERE research_partition = 'Development'),
p AS (SELECT q.*, round({' + '.join(f'{b} * {_Z(n)}' for n, b in BETA.items())}, 6) AS prediction FROM q, dv), g AS (SELECT session, quantile_cont(prediction, 0.8) AS gate FROM p WHERE research_partition = 'Development' GROUP BY 1)
SELECT product, bar_id, session, {r('prediction', 5)} AS prediction, {r(_CLIP(*trades.SIGNAL_STOP))} AS stop_distance, {r(f'2 * {_CLIP(*trades.SIGNAL_STOP)}')} AS target_distance FROM p JOIN g USING (session) WHERE prediction >= gate""",
    "tsay_policy": f"{_recursive(_F)}, {_TAIL.format(source='f')}, {_OPPS}, {_exits('oc')}, {_walked('ex', 'product, trade_date')} SELECT decision_bar, side, exit_bar, exit_reason, {r('gross_r')} AS gross_r FROM tr",
    "verification_run": f"{_F}, {_PASSAGE} SELECT 'equal' AS status, count(*) AS n FROM ex HAVING count(*) > 0",
    "resimulate_independent": f"{_F}, {_PASSAGE} SELECT entry_bar, side, exit_bar, exit_reason, {r('gross_r')} AS gross_r FROM ex",
    "time_exit_r": f"""{_F}, {_PASSAGE}, pb AS (SELECT op.product, op.decision_bar, op.side, op.research_partition, op.entry_price, op.risk, bool_or(CASE WHEN op.side = 1 THEN b.low <= op.stop ELSE b.high >= op.stop END) AS stopped, arg_max(b.close, b.bar_id) AS ec FROM op JOIN f b ON b.product = op.product AND b.bar_id BETWEEN op.entry_bar AND op.entry_bar + 7 AND b.trade_date = op.trade_date AND b.run_id = op.run_id GROUP BY ALL)
SELECT research_partition, side, count(*) AS n, count(*) FILTER (CASE WHEN stopped THEN -1.0 ELSE side * (ec - entry_price) / nullif(risk, 0) END = -1) AS stopped, {r('avg(CASE WHEN stopped THEN -1.0 ELSE side * (ec - entry_price) / nullif(risk, 0) END)', 5)} AS mean_r FROM pb GROUP BY ALL""",
    "cross_check_labels": f"{_F}, {_PASSAGE} SELECT count(*) AS rows, count(*) FILTER (NOT coalesce(abs(op.entry_price - n.open) <= 1e-9, false)) AS price_differs, count(*) FILTER (NOT coalesce(abs(op.risk / 1.5 - x.atr20) <= 1e-9, false)) AS atr_differs FROM op JOIN f x ON x.product = op.product AND x.bar_id = op.decision_bar LEFT JOIN f n ON n.product = op.product AND n.bar_id = op.decision_bar + 1 WHERE side = 1",
    "policy_freeze": f"""{_RULE_TRADES}, s AS (SELECT rule AS policy, count(*) FILTER (research_partition = 'Development') AS dev_trades, count(*) FILTER (research_partition = 'Validation') AS val_trades, avg(gross_r) FILTER (research_partition = 'Development') AS dr, avg(gross_r) FILTER (research_partition = 'Validation') AS vr FROM tr GROUP BY 1)
SELECT policy, dev_trades, val_trades, {r('dr + vr', 5)} AS score, CASE WHEN dr > 0 AND vr > 0 THEN 'frozen' WHEN dr > 0 THEN 'watch' ELSE 'rejected' END AS decision FROM s WHERE dev_trades >= 10 AND val_trades >= 10 ORDER BY round(dr + vr, 9) DESC, policy LIMIT 5""",
    "replay": f"{_RULE_TRADES} SELECT tr.entry_bar, b.bar_ts AS entry_ts, side, exit_bar, exit_reason, {r('gross_r')} AS gross_r FROM tr JOIN bars b ON b.product = tr.product AND b.bar_id = tr.entry_bar WHERE rule = 'follow_momentum' AND tr.trade_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'",
    "strategy_run": f"""{_RULE_TRADES}, o AS (SELECT *, coalesce(entry_bar <= lag(exit_bar) OVER (PARTITION BY rule, product, trade_date ORDER BY entry_bar), false) AS overlap FROM tr)
SELECT rule, count(*) AS trades, count(*) FILTER (overlap) AS overlapping, count(*) FILTER (exit_bar < entry_bar) AS backward, count(*) FILTER (exit_bar - entry_bar >= {events.HOLD}) AS too_long, count(*) FILTER (exit_reason = 'stop' AND abs(gross_r + 1) > 1e-9) AS wrong_stop, {r('avg(gross_r)', 5)} AS mean_r FROM o GROUP BY 1""",
    "paired_diff": f"{_RULE_TRADES}, d AS (SELECT trade_date, coalesce(sum(gross_r) FILTER (rule = 'follow_momentum'), 0.0) AS candidate, coalesce(sum(gross_r) FILTER (rule = 'always_long'), 0.0) AS comparator FROM tr WHERE rule IN ('follow_momentum', 'always_long') GROUP BY 1) SELECT trade_date, {r('candidate')} AS candidate, {r('comparator')} AS comparator, {r('candidate - comparator')} AS delta FROM d",
    "break_legs": f"{_B}, {_DETECTED} SELECT zone_id, swing_n, break_mode, leg_start, break_bar FROM dt",
    "poi_tables": f"{_B}, {_DETECTED} SELECT zone_id, direction, count(DISTINCT (break_mode, swing_n)) AS variants, min(swing_n) AS least_swing, max(swing_n) AS most_swing, bool_or(break_mode = 'close') AS by_close, bool_or(break_mode = 'wick') AS by_wick, first(break_mode || '/' || swing_n ORDER BY break_mode, swing_n DESC, break_bar) AS variant, first(break_bar ORDER BY break_mode, swing_n DESC, break_bar) AS break_bar FROM dt GROUP BY zone_id, product, trade_date, direction, middle_bar, zone_low, zone_high",
    "enrich_lineage": f"{_B}, {_TOUCHES} SELECT zone_id, bar_id, structural, age, CAST(dense_rank() OVER (PARTITION BY product, trade_date, direction, CAST(round(zone_low, 0) AS INTEGER), CAST(round(zone_high, 0) AS INTEGER) ORDER BY bar_id) AS INTEGER) AS canonical_number FROM tv",
    "dedup_events": f"{_B}, {_TOUCHES}, {_ONE} SELECT bar_id, zone_id, retest_number, structural, age FROM one",
    "population_variants": f"{_B}, {_TOUCHES}, {_ONE} " + " UNION ALL ".join(f"SELECT direction, count(*) AS n, count(*) FILTER (structural) AS structural, '{n}' AS population FROM {s} GROUP BY direction" for n, s in (("raw", "tv"), ("first", "(SELECT * FROM tv WHERE retest_number = 1)"), ("one_a_bar", "one"))),
    "signal_buckets": f"{_B}, {_TOUCHES} SELECT {_LADDER('age', (4, 12, 24))} AS age_bucket, {_LADDER('retest_number', (1, 2, 4))} AS number_bucket, {_LADDER('minutes_since_previous', (15, 60))} AS since_bucket, CASE WHEN minute_of_day < 720 THEN 'am' ELSE 'pm' END AS clock_bucket, count(*) AS n, count(*) FILTER (violated_before) AS violated FROM tv GROUP BY 1, 2, 3, 4",
    "candidate_policy_mask": f"{_B}, {_TOUCHES} " + " UNION ALL ".join(f"SELECT '{n}' AS policy, count(*) FILTER ({x}) AS rows FROM tv" for n, x in _MASKS.items()),
    "paired_outcomes": f"""{_F}, {_EVENT}, pp AS (SELECT er.zone_id, er.bar_id AS event_bar, er.side, er.close AS entry_price, er.risk, max(b.high) AS top, min(b.low) AS bottom, arg_max(b.close, b.bar_id) AS end_, count(*) AS bars FROM er JOIN bars b ON b.product = er.product AND b.bar_id BETWEEN er.bar_id + 1 AND er.bar_id + {events.HOLD} AND b.trade_date = er.trade_date AND b.run_id = er.run_id GROUP BY ALL),
q AS (SELECT *, CASE WHEN side = 1 THEN top - entry_price ELSE entry_price - bottom END / nullif(risk, 0) AS go, CASE WHEN side = 1 THEN entry_price - bottom ELSE top - entry_price END / nullif(risk, 0) AS back FROM pp)
SELECT zone_id, event_bar, bars, {r('go')} AS continuation_mfe_r, {r('back')} AS continuation_mae_r, {r('side * (end_ - entry_price) / nullif(risk, 0)')} AS continuation_end_r, {r('back')} AS reversal_mfe_r, CASE WHEN go > back THEN 'continuation' WHEN go < back THEN 'reversal' ELSE 'neither' END AS dominant, back < 1.0 AS held FROM q""",
    "poi_sequential": f"""{_recursive(_F)}, {_EVENT}, nf AS (SELECT *, CASE WHEN side = 1 THEN zone_high ELSE zone_low END AS near, abs(zone_high - zone_low) + {10 * TICK} AS rk FROM er),
oz AS (SELECT product, trade_date, run_id, research_partition, bar_id AS decision_bar, bar_id AS entry_bar, near AS entry_price, side, rk AS risk, near - side * rk AS stop, near + side * 2 * rk AS target FROM nf), {_exits('oz')}, {_walked('ex', 'product, trade_date')}
SELECT entry_bar, side, exit_bar, exit_reason, {r('gross_r')} AS gross_r FROM tr""",
    "simulate_positions": f"{_recursive(_F)}, {_PASSAGE}, {_walked('ex', 'side, product, trade_date')} SELECT side, research_partition, exit_reason, count(*) AS n, {r('avg(gross_r)', 5)} AS mean_r FROM tr GROUP BY ALL",
    "nlargest": "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, round(last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) - first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber), 4) + 0.0 AS move FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) (SELECT trade_date, move, 'best' AS \"end\" FROM d ORDER BY move DESC, trade_date LIMIT 10) UNION ALL (SELECT trade_date, move, 'worst' FROM d ORDER BY move, trade_date LIMIT 10)",
    "text_labels": f"{_B} SELECT bar_id, coalesce(session, 'off') || ' ' || lpad(CAST(minute_of_day // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute_of_day % 60 AS VARCHAR), 2, '0') || ' ' || CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END || ' ' || research_partition AS label FROM bars",
    "verif_bars": f"{_B} SELECT bar_ts, open, high, low, close FROM bars",
    "point_lookup": "SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 32",
    "day_read": f"SELECT event_id, ts, {r('value')} AS value FROM events WHERE ts >= TIMESTAMP '{DAY}' AND ts < TIMESTAMP '{DAY}' + INTERVAL 1 DAY AND event_type = 'click'",
    "labels_eval": "SELECT quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels GROUP BY 1",
    "sink_csv": f"WITH {_DAILY} SELECT * FROM dp",
    "sink_json": f"WITH {_DAILY} SELECT * FROM dp",
    "publish_dirs": f"WITH {_DAILY} SELECT l_returnflag, count(*) AS days, CAST(sum(volume) AS BIGINT) AS volume FROM dp GROUP BY 1",
}
