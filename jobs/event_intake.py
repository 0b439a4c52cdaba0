"""Incremental intake of timed events into checked event and frame tables.

    python -m jobs.event_intake --input EVENTS --output FOLDER [--settings FILE]

EVENTS is a folder of Parquet files, or a pattern that matches files or folders.

Whoever fits models needs events on a shared frame grid, and recordings keep arriving: new files, late events of days that were framed
before, and files that were delivered twice. Each run takes the files that no earlier run took (a file stream with a checkpoint, all that is
available, in batches of files_per_batch files) and writes below the output folder

* events/status=S/day=D/intake=N: all rows of batch N. Status is ok, or the first check that a row fails; failed rows are kept there.
* frames/day=D: event counts of each recording, frame of the day and family, and the sum of values. The days that a batch touches are made anew
  from all their events, so that late events count; of rows that share an event_id one counts, the smallest.
* checkpoint: the stream's.

Rows of a day are spread over splits_per_day tasks in either table. Of the events only the folders of touched days are listed and read.

A run that was broken off is started again with the same arguments: Spark hands the unfinished batch over again with its number, and
its partitions are overwritten. Work grows with the new events and with the days that they touch, not with all that was ever taken in.

Defined cases: null ids, times, kinds or values, unknown kinds and values that are no finite number fail a check; a repeated run, or one
without new files, changes nothing; an empty input gives empty tables; other columns of the input are ignored.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import logger, main
from kymo.functions.scalars import first_failure, is_finite
from kymo.schema import FAMILIES

JOB = "event_intake"
#: What is read of the input, and the tables.
INPUT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
EVENTS = "event_id long, recording_id string, t timestamp_ntz, family string, value double, status string, day date, intake long"
FRAMES = "recording_id string, frame int, events long, " + ", ".join(f"{f} long" for f in FAMILIES) + ", total decimal(28,6), day date"
DAY_SECONDS = 86_400


def checked(rows: DataFrame, families: dict[str, str]) -> DataFrame:
    """Rows as events with the family of their kind, their day, and ok or the first check that they fail as status."""
    family = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(name)) for kind, name in families.items()])
    status = first_failure(
        (F.col("event_id").isNull(), "no_event_id"), (F.col("user_id").isNull(), "no_recording"), (F.col("ts").isNull(), "no_time"), (family.isNull(), "unknown_kind"),
        (~is_finite("value") | (F.abs("value") >= 1e12), "unusable_value"),
    )
    return rows.select("event_id", F.col("user_id").cast("string").alias("recording_id"), F.col("ts").alias("t"), family.alias("family"), "value", status.alias("status"), F.to_date("ts").alias("day"))


def framed(events: DataFrame, frame_seconds: int) -> DataFrame:
    """Events (day, event_id, …) by recording, day and frame of the day; repeated ids count once."""
    once = events.groupBy("day", "event_id").agg(F.min(F.struct("recording_id", "t", "family", "value")).alias("e")).select("day", "e.*")
    second = F.hour("t") * 3600 + F.minute("t") * 60 + F.second("t")
    frame = F.floor(second / F.lit(frame_seconds)).cast("int")
    counts = [F.count_if(F.col("family") == f).alias(f) for f in FAMILIES]
    # sums of decimals do not depend on the order of adding
    return once.groupBy("recording_id", frame.alias("frame"), "day").agg(F.count("*").alias("events"), *counts, F.sum(F.col("value").cast("decimal(18,6)")).alias("total")).select("recording_id", "frame", "events", *FAMILIES, "total", "day")


def run(spark: SparkSession, source: str, output: str, settings: dict[str, Any]) -> DataFrame:
    """Take in what is new under source; returns the frames as they stand."""
    log, families, seconds = logger(JOB), settings["families"], int(settings["frame_seconds"])
    splits = int(settings["splits_per_day"])
    if seconds < 1 or DAY_SECONDS % seconds:
        raise ValueError(f"frame_seconds must divide a day, not {seconds}")
    if unknown := set(families.values()) - set(FAMILIES):
        raise ValueError(f"families are {FAMILIES}, not {sorted(unknown)}")
    output = output.rstrip("/")
    partitioned = lambda df, path, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    dealt = lambda df, key: df.repartition("day", F.pmod(F.xxhash64(key), F.lit(splits)))  # noqa: E731  a day is written by so many tasks, not by all

    def take(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return log.info("batch %d: no rows in the new files of %s", number, source)
        seen = Observation()
        rows = checked(batch, families).withColumn("intake", F.lit(number).cast("long"))
        ok = F.col("status") == "ok"
        rows = rows.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(ok).alias("ok"), F.collect_set(F.when(ok, F.col("day").cast("string"))).alias("days"))  # calendar days
        partitioned(dealt(rows, "event_id"), f"{output}/events", "status", "day", "intake")
        days = sorted(seen.get["days"])
        if days:
            touched = batch.sparkSession.read.schema(EVENTS).option("basePath", f"{output}/events").parquet(*[f"{output}/events/status=ok/day={d}" for d in days])
            partitioned(dealt(framed(touched, seconds), "recording_id"), f"{output}/frames", "day")
        log.info("batch %d: %d rows read from %s, %d of them ok, written to %s/events; %d days of %s/frames made anew", number, seen.get["read"], source, seen.get["ok"], output, len(days), output)

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", int(settings["files_per_batch"])).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return frames(spark, output)


def frames(spark: SparkSession, output: str) -> DataFrame:
    """The frames table of an output folder; empty if no event was taken in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output.rstrip('/')}/frames")
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(FRAMES).parquet(f"{output.rstrip('/')}/frames") if there else spark.createDataFrame([], FRAMES)


if __name__ == "__main__":
    main(JOB, run, __doc__)
