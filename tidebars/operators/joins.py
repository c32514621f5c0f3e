"""Time and interval joins, matching, reconciliation, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def asof_next(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], strict: bool = False) -> DataFrame:
    """left with the columns `take` of the first right row at (strictly) later time, by equal keys; NULL if none.

    Both sides go into one stream by key and time, and the next right row is carried back: one shuffle, no range join.
    """
    own = [x for x in left.columns if x not in by]
    # at equal times a right row counts as later than a left row, unless strict
    a = left.select(*by, c(left_on).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(*own).alias("_l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r"))
    b = right.select(*by, c(right_on).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*take).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(b).withColumn("_n", F.first("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    return both.select(*by, *[c(f"_l.{x}").alias(x) for x in own], *[c(f"_n.{x}").alias(x) for x in take])


def asof_prior(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of the last right row at or before its time."""
    own = [x for x in left.columns if x not in by]
    a = left.select(*by, c(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r"))
    b = right.select(*by, c(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*take).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_n", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    return both.select(*by, *[c(f"_l.{x}").alias(x) for x in own], *[c(f"_n.{x}").alias(x) for x in take])


def validated_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """An equi-join that fails at run time if the right side repeats a key; the check rides on the join's own shuffle."""
    n = F.count("*").over(Window.partitionBy(*on))
    checked = right.withColumn("_n", n).withColumn("_ok", F.when(c("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("right side of a many-to-one join repeats a key")).cast("boolean"))).where("_ok").drop("_n", "_ok")
    return left.join(checked, on, how)


def align(left: DataFrame, right: DataFrame, on: str, tick: float) -> DataFrame:
    """Left equi-join of two products' bars on time, with the basis in ticks and whether right's range contains left's close."""
    r = right.select(on, c("close").alias("close_r"), c("high").alias("high_r"), c("low").alias("low_r"))
    out = left.join(r, on, "left")
    return out.withColumns({"basis_ticks": (c("close") - c("close_r")) / tick, "contained": c("close").between(c("low_r"), c("high_r"))})


def in_blocks(rows: DataFrame, first: Column, last: Column, size: int) -> DataFrame:
    """rows once for every block of `size` ids that [first, last] touches: turns a range join into an equi-join."""
    return rows.withColumn("_block", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))


def range_join(left: DataFrame, right: DataFrame, on: list[str], first: str, last: str, at: str, size: int = 16) -> DataFrame:
    """Pairs with equal keys and right's `at` within left's [first, last]."""
    a = in_blocks(left, c(first), c(last), size)
    b = right.withColumn("_block", F.floor(c(at) / size))
    return a.join(b, [*on, "_block"]).where(c(at).between(c(first), c(last))).drop("_block")


def matched_controls(events: DataFrame, controls: DataFrame, keys: list[str], event_order: list[str], control_order: list[str], control_id: str) -> DataFrame:
    """Each event with the k-th control of its bucket, k running round the pool."""
    e = events.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*event_order)))
    pool = controls.select(*keys, c(control_id).alias("control"), F.row_number().over(Window.partitionBy(*keys).orderBy(*control_order)).alias("_n"), F.count("*").over(Window.partitionBy(*keys)).alias("_pool"))
    sizes = controls.groupBy(*keys).agg(F.count("*").alias("_pool"))
    e = e.join(sizes, keys).withColumn("_n", F.pmod(c("_k") - 1, c("_pool")) + 1).drop("_pool")
    return e.join(pool.drop("_pool"), [*keys, "_n"], "left").drop("_k", "_n")


def reconcile(a: DataFrame, b: DataFrame, on: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """Full outer join with a status per key: only_left, only_right, mismatch or equal."""
    x = a.select(*on, *[c(f).alias(f"{f}_a") for f in fields], F.lit(1).alias("_a"))
    y = b.select(*on, *[c(f).alias(f"{f}_b") for f in fields], F.lit(1).alias("_b"))
    both = x.join(y, on, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & (F.coalesce(F.abs(c(f"{f}_a") - c(f"{f}_b")) <= tolerance, F.lit(False)) | (c(f"{f}_a").isNull() & c(f"{f}_b").isNull()))
    status = F.when(c("_b").isNull(), "only_left").when(c("_a").isNull(), "only_right").when(~same, "mismatch").otherwise("equal")
    return both.withColumn("status", status).drop("_a", "_b")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a declared total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """Exactly n rows of each stratum (all, if fewer), by the order of a seeded digest of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), c(key).cast("string")))
    return rows.withColumn("_d", digest).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_d"))).where(c("_n") <= n).drop("_d", "_n")


def variants(rows: DataFrame, params: dict[str, list]) -> DataFrame:
    """rows for every combination of parameter values, as literals exploded in place."""
    for name, values in params.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows
