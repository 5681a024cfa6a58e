"""Incremental builds as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tuturan.operators.joins import not_yet_written, text_digest, text_key
from tuturan.operators.ranks import first_per_key
from tuturan.sources.inventory import path_exists


def new_files(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", per_trigger: int | None = None
) -> DataFrame:
    """Stream of the files of a folder that no earlier run has seen."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def resume_build(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Prepare what is new and append it; a stopped run goes on where its checkpoint is."""
    return (
        prepare(stream)
        .writeStream.format(fmt)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def unseen_text(
    stream: DataFrame, text: str = "text", event_time: str | None = None, keep_for: str = "30 days"
) -> DataFrame:
    """Drop texts that an earlier batch had; the state holds 256-bit digests, no texts.

    Without an event time the state grows with the number of distinct texts; with one it is bounded
    by ``keep_for``. ``append_unseen`` needs no state at all.
    """
    keyed = stream.withColumn("text_key", text_digest(F.col(text)))
    if event_time is None:
        return keyed.dropDuplicates(["text_key"]).drop("text_key")
    bounded = keyed.withWatermark(event_time, keep_for)
    return bounded.dropDuplicatesWithinWatermark(["text_key"]).drop("text_key")


def append_unseen(
    stream: DataFrame, output: str, checkpoint: str, order: list[str], text: str = "text"
) -> StreamingQuery:
    """Append the texts that the output does not hold yet; what is written is the only memory.

    Every trigger has a folder of its own, so one that is repeated after a failure replaces itself.
    Of equal texts in a trigger the first by ``order`` stays.
    """

    def save(batch: DataFrame, number: int) -> None:
        fresh = first_per_key(batch, text_key(F.col(text)), order)
        if number:
            written = batch.sparkSession.read.parquet(output).where(F.col("batch") < number)
            fresh = not_yet_written(fresh, written, text)
        fresh.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def append_unseen_for(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    order: list[str],
    event_time: str,
    keep_for: str = "30 days",
    text: str = "text",
) -> StreamingQuery:
    """Append the texts that were not written within the last ``keep_for`` of event time.

    A text is forgotten once the newest row seen is ``keep_for`` younger than it was when written,
    and may then be written again. The memory is one folder of digests for each trigger; those whose
    texts are all forgotten are removed, so what is kept on disk and compared in a trigger is bounded
    by the texts of one such span. A trigger that is repeated after a failure looks only at earlier
    ones and replaces its own folders. Of equal texts in a trigger the first by ``order`` stays; rows
    without an event time are compared and written but never remembered.
    """
    rows, digests, clocks = f"{output}/rows", f"{output}/digests", f"{output}/clock"

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.agg(F.max(event_time).alias("clock"))
        if path_exists(spark, clocks):
            earlier = spark.read.parquet(clocks).where(F.col("batch") < number).select("clock")
            own = own.unionByName(earlier).agg(F.max("clock").alias("clock"))
        numbered = own.withColumn("batch", F.lit(number).cast("bigint"))
        numbered.coalesce(1).write.mode("overwrite").parquet(f"{clocks}/side={number % 2}")
        now = spark.read.parquet(f"{clocks}/side={number % 2}").select("clock")
        horizon = now.select(F.col("clock") - F.expr(f"INTERVAL {keep_for}")).scalar()

        fresh = first_per_key(batch, text_key(F.col(text)), order).withColumn("_key", text_digest(F.col(text)))
        known = path_exists(spark, digests)
        if known:
            held = spark.read.parquet(digests).where(F.col("batch") < number)
            fresh = fresh.join(held.where(F.col("at") > horizon).select("_key"), "_key", "left_anti")
        fresh.drop("_key").write.mode("overwrite").parquet(f"{rows}/batch={number}")
        written = spark.read.parquet(f"{rows}/batch={number}")
        kept = written.select(text_digest(F.col(text)).alias("_key"), F.col(event_time).alias("at"))
        kept.where("at IS NOT NULL").write.mode("overwrite").parquet(f"{digests}/batch={number}")
        if known:
            last = held.groupBy("batch").agg(F.max("at").alias("at")).where(F.col("at") <= horizon)
            for old in last.select("batch").collect():  # the folders of a span, a row each
                _remove(spark, f"{digests}/batch={old['batch']}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def remembered(spark: SparkSession, output: str) -> DataFrame:
    """Digests that ``append_unseen_for`` holds, by trigger."""
    return spark.read.parquet(f"{output}/digests").groupBy("batch").agg(F.count(F.lit(1)).alias("digests"))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running_totals(stream: DataFrame, by: str = "source") -> DataFrame:
    """Samples, seconds and minutes so far."""
    return stream.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("duration").alias("total_duration"),
        (F.sum("duration") / 60.0).alias("minutes"),
    )


def publish_totals(totals: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write the complete totals of every trigger; the last two stay, each in a folder of its own."""

    def save(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("batch", F.lit(number))
        numbered.write.mode("overwrite").parquet(f"{output}/side={number % 2}")

    return (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def latest_totals(spark: SparkSession, output: str) -> DataFrame:
    """The totals of the last finished trigger."""
    everything = spark.read.parquet(output)
    last = everything.agg(F.max("batch")).scalar()
    return everything.where(F.col("batch") == last).drop("batch", "side")
