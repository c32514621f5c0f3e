"""Governed reads and writes: allowed columns, locked partitions, manifests, reload checks, hash chains."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: Words that a decision-time column's name may not contain. Fixed values.
OUTCOME_TOKENS = ("future", "forward", "label", "target", "outcome", "mfe", "mae", "exit")


class LockedPartition(PermissionError):
    """A read touched a partition that is still locked."""


def partition_filter(stage: str, day: str = "trade_date") -> Column:
    """Rows a stage may read, by date."""
    if stage == "Development":
        return c(day) <= F.lit("2024-01-18").cast("date")
    if stage == "Validation":
        return c(day) <= F.lit("2024-01-24").cast("date")
    raise LockedPartition(stage)


def assert_unlocked(rows: DataFrame, last: str, day: str = "trade_date", label: str | None = None) -> DataFrame:
    """rows, if none is later than `last` or labelled final; stops at the first that is."""
    bad = c(day) > F.lit(last).cast("date")
    if label:
        bad = bad | F.lower(c(label)).contains("final")
    if not rows.where(bad).limit(1).isEmpty():
        raise LockedPartition(f"rows later than {last}")
    return rows


def forbidden_columns(names: list[str]) -> list[str]:
    """Names that carry outcome words, in order."""
    return [n for n in names if any(t in n.lower() for t in OUTCOME_TOKENS)]


def require_columns(rows: DataFrame, wanted: list[str]) -> DataFrame:
    missing = [n for n in wanted if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*wanted)


@dataclass
class GuardedReader:
    """Reads allowed tables with explicit columns, under a stage's date bound, and keeps an audit of what it read."""

    spark: SparkSession
    allowed: frozenset[str]
    last: str
    audit: list[dict] = field(default_factory=list)

    def schema(self, path: str) -> dict[str, str]:
        """Names and types from the footer; no rows are read."""
        self._check(path)
        found = dict(self.spark.read.parquet(path).dtypes)
        self.audit.append({"path": path, "mode": "schema", "columns": sorted(found)})
        return found

    def read(self, path: str, columns: list[str], day: str) -> DataFrame:
        """Columns and dates are pushed to the scan; the bounds found are recorded and checked again."""
        self._check(path)
        if not columns:
            raise ValueError("columns must be named")
        rows = require_columns(self.spark.read.parquet(path), columns).where(c(day) <= F.lit(self.last).cast("date"))
        lo, hi, n = rows.agg(F.min(day), F.max(day), F.count("*")).first()
        self.audit.append({"path": path, "mode": "read", "columns": columns, "from": str(lo), "to": str(hi), "rows": n})
        return assert_unlocked(rows, self.last, day)

    def _check(self, path: str) -> None:
        if path.rstrip("/").rsplit("/", 1)[-1] not in self.allowed:
            raise PermissionError(path)


def stable_sample_hash(rows: DataFrame, key: str, columns: list[str], step: int) -> str:
    """SHA-256 over every step-th row by key, as text in order of the key."""
    own = rows.where(c(key) % step == 0).select(key, F.concat_ws("|", *[F.coalesce(c(n).cast("string"), F.lit("~")) for n in columns]).alias("t"))
    text = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "t"))), lambda x: x["t"]), "\n")).first()[0]
    return hashlib.sha256(text.encode()).hexdigest()


def content_digest(rows: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest of all rows: one aggregate."""
    n, s = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return n, s


def save_table(rows: DataFrame, path: str) -> dict:
    """Write a new Parquet dataset (Spark's committer makes it appear as a whole) and return its manifest entry."""
    rows.write.mode("error").parquet(path)
    n, digest = content_digest(rows.sparkSession.read.parquet(path))
    return {"path": path, "rows": n, "digest": digest, "schema": [[f.name, f.dataType.simpleString()] for f in rows.schema]}


def verify_table(spark: SparkSession, entry: dict) -> list[str]:
    """What differs between a manifest entry and the table it names."""
    rows = spark.read.parquet(entry["path"])
    n, digest = content_digest(rows)
    found = {"rows": n, "digest": digest, "schema": [[f.name, f.dataType.simpleString()] for f in rows.schema]}
    return [k for k, v in found.items() if v != entry[k]]


def canonical(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(payload: dict) -> str:
    """16 hex digits of the canonical JSON's SHA-256."""
    return hashlib.sha256(canonical(payload).encode()).hexdigest()[:16]


def chain(records: list[dict], previous: str = "") -> list[dict]:
    """Records with previous_hash and record_hash, each over the one before."""
    out = []
    for r in records:
        h = hashlib.sha256((previous + canonical(r)).encode()).hexdigest()
        out.append(r | {"previous_hash": previous, "record_hash": h})
        previous = h
    return out


def broken_links(log: DataFrame, order: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """Rows of a decision log (seq, payload, previous_hash, record_hash) whose hash or link doesn't hold.

    The link is looked up by the number before it, an equi-join, so a long log needs no ordered pass. With keys, each
    of their values (none null) has a chain of its own.
    """
    keys = keys or []
    before = log.select(*keys, (c(order) + 1).alias(order), c("record_hash").alias("_before"))
    rows = log.join(before, [*keys, order], "left").withColumn("_own", F.sha2(F.concat("previous_hash", "payload"), 256))
    return rows.where((c("_own") != c("record_hash")) | (c("previous_hash") != F.coalesce("_before", F.lit("")))).drop("_before", "_own")


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq long, payload string, previous_hash string, record_hash string").json(path)


def tick_grid_report(rows: DataFrame, columns: list[str], tick: float, tolerance: float = 1e-8) -> DataFrame:
    """field, worst distance from the price grid in ticks, and how many values are off it."""
    off = lambda n: F.abs(c(n) / tick - F.rint(c(n) / tick))
    wide = rows.agg(*[F.struct(F.max(off(n)).alias("worst"), F.count_if(off(n) > tolerance).alias("off")).alias(n) for n in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c(n)["worst"].alias("worst"), c(n)["off"].alias("off")) for n in columns])).alias("x")).select("x.*")


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Bars that aren't finite, positive and ordered."""
    prices = [c(n) for n in ("open", "high", "low", "close")]
    bad = F.lit(False)
    for p in prices:
        bad = bad | p.isNull() | F.isnan(p) | (p <= 0)
    return bars.where(bad | (c("high") < F.greatest("open", "close")) | (c("low") > F.least("open", "close")))


def _saved(rows: DataFrame, path: str, keys: list[str], kind: str) -> dict:
    """Written in order of its keys (ranges of them, each sorted), so equal tables make equal files; the manifest entry."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = ordered.write.mode("error")
    if kind == "csv":
        writer = writer.option("header", "true").option("nullValue", "\\N").option("emptyValue", '""')
    writer.format(kind).save(path)
    entry = {"path": path, "kind": kind, "columns": [[f.name, f.dataType.simpleString()] for f in rows.schema]}
    n, digest = content_digest(_loaded(rows.sparkSession, entry))
    return entry | {"rows": n, "digest": digest}


def _loaded(spark: SparkSession, entry: dict) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in entry["columns"])
    reader = spark.read.schema(schema)
    return (reader.option("header", "true").option("nullValue", "\\N").option("emptyValue", "") if entry["kind"] == "csv" else reader).format(entry["kind"]).load(entry["path"])


def _verified(spark: SparkSession, entry: dict, kind: str) -> DataFrame:
    if entry["kind"] != kind:
        raise ValueError(f"not a {kind} table")
    rows = _loaded(spark, entry)
    if content_digest(rows) != (entry["rows"], entry["digest"]):
        raise ValueError(f"{entry['path']} is not what its manifest says")
    return rows


def save_csv(rows: DataFrame, path: str, keys: list[str]) -> dict:
    return _saved(rows, path, keys, "csv")


def save_json(rows: DataFrame, path: str, keys: list[str]) -> dict:
    return _saved(rows, path, keys, "json")


def load_csv(spark: SparkSession, entry: dict) -> DataFrame:
    """The table of a manifest entry, held against its count and digest first."""
    return _verified(spark, entry, "csv")


def load_json(spark: SparkSession, entry: dict) -> DataFrame:
    return _verified(spark, entry, "json")


def publish(spark: SparkSession, moves: dict[str, str]) -> None:
    """Staged folders renamed to their places together: what stood there is set aside first and put back if a step fails."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    done: list[tuple] = []
    try:
        for source, target in moves.items():
            a, b, aside = hadoop(source), hadoop(target), hadoop(f"{target}.before")
            fs = b.getFileSystem(conf)
            if not fs.exists(a):
                raise FileNotFoundError(source)
            had = fs.exists(b)
            if had and not fs.rename(b, aside):
                raise OSError(f"could not set {target} aside")
            done.append((fs, a, b, aside, had, False))
            if not fs.rename(a, b):
                raise OSError(f"could not publish {target}")
            done[-1] = (fs, a, b, aside, had, True)
    except Exception:
        for fs, a, b, aside, had, moved in reversed(done):
            if moved:
                fs.rename(b, a)
            if had:
                fs.rename(aside, b)
        raise
    for fs, _, _, aside, had, _ in done:
        if had:
            fs.delete(aside, True)
