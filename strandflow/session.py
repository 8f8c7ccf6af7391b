"""Session settings and the one place that decides where checkpoints go."""

from __future__ import annotations

import gc
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "strandflow", **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on.

    The zone is pinned because vertex order may come from timestamps, and AQE
    is on because skewed joins on curve or cell keys are split by it at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Iterations leave checkpoints behind; those no longer referred to are deleted.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; make one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="strandflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed on them."""
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / root.name), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(made)


# Spark deletes the shuffle files of a query at its end where this is set when the query is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's result in the shared folder (survives lost executors).

    Nobody reads what was shuffled for it again: those files go at once, not when the
    driver happens to collect garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


# Rows (images, mostly) that one round of a whole job works on.
ROWS_A_ROUND = 8_192


def in_rounds(table: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], *, rows: int = 0) -> DataFrame:
    """``work`` over all of ``table``, some ``rows`` (``ROWS_A_ROUND``) at a time by a hash of ``key``; the results together.

    For jobs that treat every key by itself and make little of it: what a round shuffled
    and kept is deleted before the next, so that the disk a job needs does not grow with
    the table beyond its results.
    """
    spark = table.sparkSession
    n = -(-table.count() // (rows or ROWS_A_ROUND))
    if n <= 1:
        return work(table)
    done: DataFrame | None = None
    for k in range(n):
        part = cut_lineage(work(table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)))
        done = part if done is None else done.unionByName(part)
        # Checkpoints go once neither side refers to them; the driver has no other reason to look.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return done


def whole(df: DataFrame) -> DataFrame:
    """One side of a join that is merged, never broadcast, however small it looks.

    Sizes are estimated from the files read: a raster or a curve that was made from
    a few numbers of a row weighs as little there as the numbers.
    """
    return df.hint("merge")


# Rows of a known number that one task is handed.
ROWS_A_TASK = 400_000


def spread(df: DataFrame, *cols: str, rows: int = 0, each: int = 0) -> DataFrame:
    """Hash partition into exactly the configured number of shuffle partitions.

    Where the number of ``rows`` is known, into as many more as keep ``each`` (``ROWS_A_TASK``):
    what a task holds then does not grow with the table.

    Adaptive execution merges partitions by bytes; the Python kernels behind
    this exchange cost far more per byte than JVM operators do, so they keep
    the configured parallelism. A following group-by on ``cols`` adds no exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // (each or ROWS_A_TASK))), *cols)
