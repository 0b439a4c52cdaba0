"""The jobs as registered queries: each runs its job twice into one new folder and returns the output read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import event_intake, text_inputs
from jobs.common import settings_of, shared_folder
from kymo.operators.grid import SENTENCE_ENDS
from kymo.schema import FAMILIES


def job1_event_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of all events after two runs of the intake, the second of which finds nothing new."""
    output = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        event_intake.run(spark, f"{sf_dir}/events.parquet*", output, settings_of(event_intake.JOB))
    done = event_intake.frames(spark, output)
    return done.withColumns({"total": F.col("total").cast("double"), "day": F.col("day").cast("string")})


def job2_text_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All model inputs of all documents after two runs."""
    output = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        text_inputs.run(spark, f"{sf_dir}/documents.parquet", output, settings_of(text_inputs.JOB))
    return text_inputs.inputs(spark, output)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_event_intake": job1_event_intake, "job2_text_inputs": job2_text_inputs}

_intake, _cut = settings_of(event_intake.JOB), settings_of(text_inputs.JOB)
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "job1_event_intake": f"""
with named as (
    select event_id, user_id::varchar as recording_id, ts, case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in _intake["families"].items())} end as family, value from events
), good as (
    select * from named where event_id is not null and recording_id is not null and ts is not null and family is not null and isfinite(value) and abs(value) < 1e12
), once as (
    select * from good qualify row_number() over (partition by event_id, ts::date order by recording_id, ts, family, value) = 1
)
select recording_id, ((floor(epoch(ts))::bigint % {event_intake.DAY_SECONDS}) // {_intake["frame_seconds"]})::int as frame, count(*) as events,
    {", ".join(f"count(*) filter (where family = '{f}') as {f}" for f in FAMILIES)}, sum(value::decimal(18,6))::double as total, strftime(ts, '%Y-%m-%d') as day
from once group by all""",
    "job2_text_inputs": f"""
with parts as (
    select doc_id, lang, string_split(regexp_replace(text, '([{SENTENCE_ENDS}])[' || {_BLANK} || ']+', '\\1' || chr(1), 'g'), chr(1)) as s from documents
), cleaned as (
    select doc_id, lang, list_filter(list_transform(s, lambda x: list_filter(regexp_split_to_array(x, '[' || {_BLANK} || ']+'), lambda w: w <> '')), lambda x: len(x) > 0) as s from parts
), sentences as (
    select doc_id, lang, unnest(generate_series(0, len(s) - 1)) as sentence, unnest(s) as words from cleaned
), chunks as (
    select *, len(words) as n, unnest(generate_series(0, (len(words) - 1) // {_cut["core_words"]})) as chunk from sentences
), ranged as (
    select *, chunk * {_cut["core_words"]} as core_start, least(n, (chunk + 1) * {_cut["core_words"]}) as core_end from chunks
), wide as (
    select *, greatest(0, core_start - {_cut["context_words"]}) as context_start, least(n, core_end + {_cut["context_words"]}) as context_end from ranged
)
select doc_id, sentence::int as sentence, chunk::int as chunk, core_start::int as core_start, core_end::int as core_end, context_start::int as context_start, context_end::int as context_end,
    array_to_string(words[context_start + 1:context_end], ' ') as text, case when n > {_cut["core_words"]} then 'WARN' else 'PASS' end as status, lang from wide""",
}
