"""The driver's tables in the shape of kymo.schema: users stand for recordings, event types for families, hours for frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames a second, and frames of the 30 days that events span.
RATE, FRAMES = 1 / 3600, 720
#: Family of each event type.
FAMILY = {"click": "acoustic", "view": "prosodic", "purchase": "phonetic", "error": "word", "signup": "onset"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def family(event_type="event_type"):
    out = F.lit(None).cast("string")
    for k, v in FAMILY.items():
        out = F.when(F.col(event_type) == k, v).otherwise(out)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, event_id, event_type, family, value, t): seconds since the first of January 2024."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), "event_id", "event_type", family().alias("family"), "value", t.alias("t"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user over the whole span."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id")).distinct()
    return users.select("recording_id", F.lit(FRAMES * 3600.0).alias("duration_seconds"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INTERVALS: each event until the user's next one; types word and click are tiers of words, the others of phones."""
    from pyspark.sql import Window

    e = events(spark, sf_dir)
    order = Window.partitionBy("recording_id").orderBy("t", "event_id")
    rows = e.select("recording_id", (F.row_number().over(order) - 1).alias("interval_idx"), F.when(F.col("event_id") % 2 == 0, "words").otherwise("phones").alias("tier"), F.col("t").alias("start"), F.lead("t").over(order).alias("end"), F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type")).alias("label"), "value", "event_id")
    return rows.where("end is not null")


#: The same as DuckDB views, to be put before an oracle's query.
EVENTS_SQL = "ev as (select user_id::varchar as recording_id, event_id, event_type, case event_type when 'click' then 'acoustic' when 'view' then 'prosodic' when 'purchase' then 'phonetic' when 'error' then 'word' when 'signup' then 'onset' end as family, value, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6::double as t from events)"
USERS_SQL = "users as (select distinct user_id::varchar as recording_id from events)"
GRID_SQL = f"grid as (select recording_id, f::int as frame, f * 3600e0 as t from users, generate_series(0, {FRAMES - 1}) g(f))"
INTERVALS_SQL = "iv as (select recording_id, interval_idx, tier, start, \"end\", label, value, event_id from (select recording_id, (row_number() over w - 1)::int as interval_idx, case when event_id % 2 = 0 then 'words' else 'phones' end as tier, t as start, lead(t) over w as \"end\", case when event_id % 11 = 0 then ' ' else event_type end as label, value, event_id from ev window w as (partition by recording_id order by t, event_id)) where \"end\" is not null)"
