"""Structured Streaming: ticks to bars, sessions, staleness, and a decision log."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

#: State on the executors' disks with a bounded share of memory, instead of all of it on their heaps.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # a lookup before each write
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


def tick_stream(spark: SparkSession, sf_dir: str, files: int | None = 1) -> DataFrame:
    """The events table as a stream of its files, so many at a time; None: all that are there at once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/events.parquet*")


def bar_stream(ticks: DataFrame, minutes: int, late: str = "2 minutes") -> DataFrame:
    """Bars by event_type and bucket; ticks later than the watermark are dropped as stale."""
    first = F.struct("ts", "event_id")
    rows = ticks.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", f"{minutes} minutes"))
    out = rows.agg(F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", first).alias("close"), F.count("*").alias("volume"))
    return out.select("event_type", c("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def user_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str | None = "2 minutes") -> DataFrame:
    """Bursts of one user's events, ended by a gap; ticks later than the watermark are dropped, without one (None) none are."""
    rows = ticks.withColumn("ts", c("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    # Spark also joins sessions that only touch; an event a whole gap after the last one begins another
    rows = rows.groupBy("user_id", F.session_window("ts", f"{gap} -1 microseconds")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return rows.select("user_id", c("session_window.start").alias("started"), (c("session_window.end") + F.expr("INTERVAL '0.000001' SECOND")).alias("ended"), "events", "value")


def stale(ticks: DataFrame, now, seconds: int = 120) -> DataFrame:
    """Rows whose age at `now` (a Column) exceeds the limit."""
    return ticks.withColumn("age_s", F.unix_timestamp(now) - F.unix_timestamp(c("ts").cast("timestamp"))).withColumn("is_stale", c("age_s") > seconds)


def _scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all machines share; local sessions can do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it has to name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tidebars/stream-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    """Best effort: at the end of the driver the session may be gone."""
    try:
        if spark.sparkContext._jsc is None:
            return
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # noqa: BLE001
        return


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result as a table.

    Executors write it to the folder they share, so nothing of it passes through the driver. A complete result takes
    the place of the one before. The state goes when the run ends, the table when the driver ends.
    """
    spark = stream.sparkSession
    path = _scratch(spark)
    atexit.register(_delete, spark, path)
    parts: list[str] = []

    def keep(rows: DataFrame, batch: int) -> None:
        part = f"{path}/rows/{batch}"
        rows.write.mode("overwrite").parquet(part)  # a batch that is run again writes the same
        for old in [p for p in parts if p != part] if mode == "complete" else []:
            parts.remove(old)
            _delete(spark, old)
        if part not in parts:
            parts.append(part)

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:  # the stream has a copy of the settings
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    try:
        query.awaitTermination()
    finally:
        _delete(spark, f"{path}/state")
    return spark.read.schema(stream.schema).parquet(*parts) if parts else spark.createDataFrame([], stream.schema)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished rows to a directory of JSON lines, exactly once."""
    query = stream.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
