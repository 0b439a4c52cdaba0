"""The corpus pipeline: quality rules, line dedup, near-copies, mixing and tokens, each over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm import bpe, lines, mixing, nearcopies, rules
from kymo.llm.common import stored, table_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep.

    A null or empty text has no words and goes; repeated rows are judged alike; an empty table gives none; other columns stay.
    """
    learned = rules.learn_from(docs, table_of(spark, sf_dir, "labels"))
    return rules.judged(docs, learned).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later one repeats; n_chars follows, and documents left without a word go.

    A null text counts as an empty one and goes; a null doc_id is no document of its own, see lines; repeated rows of one id are one
    document and lose the same lines; an empty table gives none; other columns stay.
    """
    done = lines.apply(docs, lines.repeated_lines(docs))
    columns = [F.col("kept.text").alias(c) if c == "text" else F.char_length("kept.text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.where(F.btrim("kept.text", F.lit(lines.BLANK)) != "").select(*columns)


#: Ids that rows without one are given while near copies are looked for: above all others, equal for equal texts.
NO_ID_BASE = 2**62


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; of rows that share an id one, the first by the hashes of text and row.

    Rows without an id come after all others and are compared as well; equal texts without id are one document. Texts without
    words are no copies of anything; an empty table gives none; other columns stay.
    """
    text_hash = F.xxhash64("text")
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID_BASE) + F.pmod(text_hash, F.lit(2**61)))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id.alias("near_id"), text_hash.alias("near_hash"))
    kept = nearcopies.near_copies(given.select("near_id", F.col("row.text").alias("text")), "near_id", percent=nearcopies.STANDARD).where("kept").select(F.col("doc_id").alias("near_id")).distinct()
    chosen = given.join(kept, "near_id", "left_semi")
    return chosen.groupBy("near_id").agg(F.min_by("row", F.struct("near_hash", F.xxhash64("row"))).alias("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say.

    A null text has no tokens; repeated rows are drawn alike; without labels every document stays; an empty table gives none; other columns stay.
    """
    return mixing.mixed(docs, table_of(spark, sf_dir, "labels"))


#: Words that the tokens stage remembers: fewer than the operator's own number, since executors hold what the stages before have left.
REMEMBERED = 100_000


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its ids and of what they decode to.

    A null text is an empty one; repeated rows are encoded each; an empty table gives none.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=REMEMBERED)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]

#: The learned rules and the fitted mix are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    done = table_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = stored(stage(spark, done, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, done, sf_dir)
