"""Measurements of newly arriving vertex files, appended to the per-image table.

The batch jobs append to that table run by run; here Structured Streaming picks
up new trace files as they land. A micro-batch holds whole files, so each curve
is complete when it is measured; the checkpoint remembers what has been read, and
a batch repeated after a failure overwrites the rows it had written.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandflow.config import Config
from strandflow.operators.curves import Layout, with_position
from strandflow.plans.jobs import metrics_from_traces
from strandflow.sources.mrc import with_image_id
from strandflow.sources.sinks import put_per_image

TRACE_CSV = T.StructType(
    [
        T.StructField("filament_id", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)


def measure_new_traces(
    spark: SparkSession,
    traces_dir: str,
    images: DataFrame,
    out: str,
    checkpoint: str,
    *,
    patient_id: str | None = None,
    config: Config | None = None,
) -> StreamingQuery:
    """Process all files present now and stop; run again (or on a trigger) for new ones."""
    files = (
        spark.readStream.schema(TRACE_CSV)
        .option("header", True)
        .csv(traces_dir)
        .select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    )

    # A batch that is repeated after a failure replaces what it had written.
    stream = md5(checkpoint.encode()).hexdigest()

    def measure(batch: DataFrame, number: int) -> None:
        rows = with_image_id(batch.filter("filament_id is not null")).withColumn(
            "row", F.monotonically_increasing_id()
        )
        pos = with_position(rows, Layout(order=("row",))).filter("n >= 2")
        curves = pos.select("image_id", "filament_id", F.col("i").alias("seq"), "x", "y", "block")
        put_per_image(metrics_from_traces(images, curves, patient_id=patient_id, config=config), out, f"stream-{stream}-{number}")

    return (
        files.writeStream.foreachBatch(measure)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
