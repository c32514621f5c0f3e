"""Price bars from ticks: bucket aggregation, continuity runs, calendar columns.

Ticks are aggregated with a partial aggregation before one shuffle by (product, bucket). What follows works on bars,
ordered within a product; bar_id and run_id are to be computed once and kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Minimum price step of the derived bars.
TICK = 0.01
#: Entry windows, minutes of day: [start, end). Fixed values.
LONDON, NEW_YORK, FORCED_EXIT = (180, 360), (420, 720), 930
#: Chronological partitions of the event bars: last Development and last Validation day.
DEVELOPMENT_END, VALIDATION_END = "2024-01-18", "2024-01-24"
#: First failing continuity rule of a bar. Fixed values.
REASONS = {1: "start", 2: "time_gap", 3: "product", 4: "contract", 5: "segment", 6: "control"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aggregate_ticks(ticks: DataFrame, minutes: int, product: Column | None = None) -> DataFrame:
    """product, bar_ts, open, high, low, close, volume from ts, value, event_id."""
    first = F.struct("ts", "event_id")
    bucket = F.window("ts", f"{minutes} minutes")["start"].alias("bar_ts")
    return ticks.groupBy((product if product is not None else F.lit("ALL")).alias("product"), bucket).agg(
        F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", first).alias("close"), F.count("*").alias("volume")
    )


def with_calendar(bars: DataFrame) -> DataFrame:
    """bars with trade_date, minute_of_day, segment (calendar week), session and research_partition."""
    bars = bars.withColumns({"trade_date": F.to_date("bar_ts"), "minute_of_day": F.hour("bar_ts") * 60 + F.minute("bar_ts")})
    return bars.withColumns({"segment": F.date_diff(F.col("trade_date"), F.lit("2024-01-01").cast("date")).cast("int") / 7, "session": session_label(F.col("minute_of_day")), "research_partition": partition_label(F.col("trade_date"))}).withColumn(
        "segment", F.floor("segment").cast("int")
    )


def session_label(minute: Column) -> Column:
    return F.when(minute.between(LONDON[0], LONDON[1] - 1), "London").when(minute.between(NEW_YORK[0], NEW_YORK[1] - 1), "New York")


def partition_label(day: Column) -> Column:
    return F.when(day <= DEVELOPMENT_END, "Development").when(day <= VALIDATION_END, "Validation").otherwise("Final")


def with_runs(bars: DataFrame, minutes: int) -> DataFrame:
    """bars with bar_id (0, 1, ... within a product), boundary_reason (0 inside a run), run_no, run_id and run_position.

    A run ends at a gap in time or a new segment; runs are stretches, not groups of equal keys.
    """
    order = Window.partitionBy("product").orderBy("bar_ts")
    gap = F.unix_timestamp(F.col("bar_ts").cast("timestamp")) - F.unix_timestamp(F.lag("bar_ts").over(order).cast("timestamp"))
    bars = bars.withColumns({"bar_id": F.row_number().over(order) - 1, "_gap": gap, "_same": F.col("segment") == F.lag("segment").over(order)})
    reason = F.when(F.col("bar_id") == 0, 1).when(F.col("_gap") != minutes * 60, 2).when(~F.col("_same"), 5).otherwise(0)
    bars = bars.withColumn("boundary_reason", reason)
    bars = bars.withColumn("run_no", F.sum((F.col("boundary_reason") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    bars = bars.withColumn("run_id", F.concat_ws("/", "product", "run_no"))
    return bars.withColumn("run_position", F.row_number().over(Window.partitionBy("run_id").orderBy("bar_id")) - 1).drop("_gap", "_same")


def event_bars(spark: SparkSession, sf_dir: str, minutes: int = 15, by_type: bool = False) -> DataFrame:
    """Bars of the events table with calendar and runs; only the four columns needed reach the scan."""
    ticks = table(spark, sf_dir, "events").select("ts", "event_id", "value", *(["event_type"] if by_type else []))
    return with_runs(with_calendar(aggregate_ticks(ticks, minutes, F.col("event_type") if by_type else None)), minutes)


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_returnflag, trade_date, open, high, low, close, volume of unit prices by ship date."""
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity")
    first = F.struct("l_orderkey", "l_linenumber")
    return rows.groupBy("l_returnflag", F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", first).alias("close"), F.sum("l_quantity").alias("volume")
    )


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, l_orderkey, l_linenumber, research_partition, feature, feature_b, target: many rows a date."""
    rows = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    part = F.when(F.year("l_shipdate") <= 1999, "Development").when(F.year("l_shipdate") == 2000, "Validation").otherwise("Final")
    return rows.select(
        day.alias("trade_date"), "l_orderkey", "l_linenumber", part.alias("research_partition"), F.col("l_quantity").alias("feature"), (F.col("l_tax") + F.col("l_discount")).alias("feature_b"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("target")
    )
