"""Incremental waves through a Structured Streaming file source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.plans.waves import run_stored_wave
from shelfmark.schemas import DECISIONS
from shelfmark.session import materialize
from shelfmark.sources.store import Store

Decide = Callable[[DataFrame, int], DataFrame]


def run_arrivals(
    store: Store,
    source: str,
    schema: T.StructType,
    checkpoint: str,
    aliases: DataFrame,
    at,
    inventory: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    files_per_wave: int | None = 1,
    fmt: str = "parquet",
    **options,
) -> None:
    """Turn what is new in ``source`` into waves of ``store``, ``files_per_wave`` arrived files each (None: all of them, one wave).

    ``inventory`` makes an inventory with ``text`` out of a batch; ``options``
    go to ``run_stored_wave``. Every micro-batch is one wave, named by the
    stream's batch number: after a crash the stream repeats the batch that it
    has not committed, under the same number, and the wave is written anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = materialize(inventory(batch), "arrived")  # read by several steps of the wave
        run_stored_wave(store, arrived, batch_id + 1, aliases, at, **options)

    reader = store.spark.readStream.schema(schema)
    if files_per_wave is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_wave)
    query = (
        reader.format(fmt).load(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    decide: Decide,
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
    glob: str | None = None,
    result: T.StructType = DECISIONS,
) -> DataFrame:
    """Process what is new in ``source`` and return the decisions table.

    Every micro-batch is one wave. The stream's checkpoint remembers the files
    seen, so a rerun handles new files only. Each batch replaces its own
    ``wave=`` folder: a batch repeated after a crash writes the same rows to
    the same place. ``result`` is the schema of the table where nothing has
    arrived yet.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decide(batch, batch_id + 1).write.mode("overwrite").parquet(f"{table}/wave={batch_id + 1}")

    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.format(fmt).load(source)
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], result)
    return spark.read.parquet(table).withColumn("wave", F.col("wave").cast("int"))
