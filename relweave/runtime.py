"""Session settings, lineage cuts and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that end an Arrow batch. Spark's own limit is 16 times that, and a
#: Python worker holds a batch several times over.
BATCH_BYTES = 4 << 20


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (AQE, UTC, Arrow).

    ``master`` and sizes are left to spark-submit on a cluster.
    """
    builder = (
        SparkSession.builder.appName("relweave")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The same limit for a session made elsewhere; a smaller one of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named in spark.checkpoint.dir.

    A local master without the setting gets a temporary folder; a cluster
    without it is an error, since a machine-local folder would lose data.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        current = tempfile.mkdtemp(prefix="relweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/relweave/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what jobs have written below the shared folder; call it when their results are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/relweave")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark then deletes what a query has shuffled as soon as it ends, not when the driver next collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one. What was shuffled
    for it is deleted, since nothing reads it again."""
    spark = df.sparkSession
    shared_dir(spark)
    was = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, which takes the setting
    finally:
        spark.conf.unset(CLEAN_UP) if was is None else spark.conf.set(CLEAN_UP, was)


def stored(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for rows that may be many: joins with them shuffle both sides.

    Spark takes texts and lists made inside a query for far smaller than they are,
    and a side that it holds for small passes whole through the driver.
    """
    return cut_lineage(df).hint("merge")


def ntz(text: str) -> Column:
    """Zone-less timestamp literal, so that scans get the comparison pushed down."""
    return F.expr(f"timestamp_ntz'{text}'")


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi join in which NULL keys match each other; keys appear once."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    cond = F.lit(True)
    for i, key in enumerate(keys):
        test = left[key].eqNullSafe(renamed[f"__r_{key}"])
        cond = test if i == 0 else cond & test
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
