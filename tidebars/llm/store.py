"""Tables that cut lineage, written to the folder every executor shares; columns that ride along untouched."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of this driver's tables, below the shared one.
_RUN = uuid.uuid4().hex
_PATH = "_tidebars_path"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder in local mode (tests) and an error on a
    cluster, whose machines don't see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it has to name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='tidebars-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    root = f"{shared_dir(spark)}/tidebars/{_RUN}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(_delete, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_roots: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    """Best effort: at the end of the driver the session may be gone."""
    try:
        if spark.sparkContext._jsc is None:
            return
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # noqa: BLE001
        return


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    A lost executor costs at most the stage at hand: what was written stays. Shuffle files of the
    query that wrote it are removed as soon as the write ends, so they don't pile up on local disks. The table that a
    round replaces (instead_of) goes as soon as the new one stands; the others go when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    if instead_of is not None and getattr(instead_of, _PATH, None):
        _delete(spark, getattr(instead_of, _PATH))
    return out


#: Columns of a caller's table that an operator doesn't look at, as one column that can't clash with its own names.
REST = "columns that ride along"


def aside(docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """The own columns of docs (null strings where docs lacks one) and REST, a struct of the others."""
    there = {c.lower(): c for c in docs.columns}
    rest = [c for c in docs.columns if c.lower() not in own]
    packed = F.struct(*[F.col(_quoted(c)) for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(*[F.col(_quoted(there[c])).alias(c) if c in there else F.lit(None).cast("string").alias(c) for c in own], packed.alias(REST))


def restored(rows: DataFrame, docs: DataFrame, own: tuple[str, ...], added: tuple[str, ...] = ()) -> DataFrame:
    """rows of aside(docs, own) with the columns of docs in their order, own ones as rows has them; then the added columns,
    which replace those of docs that have their name."""
    kept = [c for c in docs.columns if c.lower() not in added]
    columns = [F.col(c.lower()).alias(c) if c.lower() in own else F.col(_quoted(REST))[c].alias(c) for c in kept]
    return rows.select(*columns, *[F.col(c) for c in added])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Bytes of an Arrow batch between Spark and Python, so that a few long texts don't make a large one.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Keep Arrow batches to 4 MB or the session's smaller bound, in the JVM's off-heap memory and in Python alike.

    The bound is a setting of the session and stays: plans are run after the operator has returned.
    """
    now = re.sub(r"\D", "", spark.conf.get(BATCH, None) or "")
    if not now or int(now) > most:
        spark.conf.set(BATCH, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
