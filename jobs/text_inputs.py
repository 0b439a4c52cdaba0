"""Texts cut into the inputs of a language model, with context, and a report.

    python -m jobs.text_inputs --input DOCUMENTS --output FOLDER [--settings FILE]

A language model reads a sentence at a time and refuses one that is too long, so transcripts are cut before they are run through it. A
sentence ends at white space after one of . ! ? ; or their wide forms; one of more than core_words words is cut into cores of so many,
each with context_words words of its sentence to both sides. Written below the output folder:

* inputs/lang=L: doc_id, sentence, chunk, the words of core and context as ranges of the sentence, the text, its status: PASS, or WARN for a part of a cut sentence.
* report/: for each language its texts, those without words, sentences, inputs, words, the longest sentence, and the worst status (FAIL: no text has words).

Everything is made row by row before the report's counts, so nothing is shuffled but those, and a source or text that holds most rows is as
good as any other. Both tables are overwritten as a whole, inputs first: a run that was broken off is started again with the same result.

Defined cases: a null or empty text has no sentence and counts as one without words; a null language is its own; repeated rows are cut each;
an empty input gives empty tables; other columns of the input are ignored.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import logger, main
from kymo.operators.transcripts import model_inputs

JOB = "text_inputs"
INPUTS = "doc_id long, sentence int, chunk int, core_start int, core_end int, context_start int, context_end int, text string, status string, lang string"
REPORT = "lang string, texts long, empty_texts long, sentences long, inputs long, words long, longest_sentence int, status string"


def report_of(documents: DataFrame, inputs: DataFrame) -> DataFrame:
    """A row for each language; every count is a partial aggregate before it is shuffled."""
    texts = documents.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("empty_texts"))
    cut = inputs.groupBy("lang").agg(
        F.count_if(F.col("chunk") == 0).alias("sentences"), F.count(F.lit(1)).alias("inputs"), F.sum((F.col("core_end") - F.col("core_start")).cast("long")).alias("words"), F.max("core_end").alias("longest_sentence"), F.max(F.col("status") == "WARN").alias("any_cut")
    )
    both = texts.join(cut.withColumnRenamed("lang", "cut_lang"), F.col("lang").eqNullSafe(F.col("cut_lang")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(F.col("inputs").isNull(), "FAIL").when(F.col("any_cut"), "WARN").otherwise("PASS")
    return both.select("lang", "texts", "empty_texts", count("sentences"), count("inputs"), count("words"), count("longest_sentence"), status.alias("status"))


def run(spark: SparkSession, source: str, output: str, settings: dict[str, Any]) -> DataFrame:
    """Cut all texts of the table at source; returns the report as it was written."""
    log, output = logger(JOB), output.rstrip("/")
    documents = spark.read.parquet(source).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    cut = model_inputs(documents, int(settings["core_words"]), int(settings["context_words"])).select(*[c.split()[0] for c in INPUTS.split(", ")])
    cut.write.mode("overwrite").option("maxRecordsPerFile", int(settings["rows_per_file"])).partitionBy("lang").parquet(f"{output}/inputs")
    report_of(documents, inputs(spark, output)).coalesce(1).write.mode("overwrite").parquet(f"{output}/report")  # a row for each language
    report = spark.read.schema(REPORT).parquet(f"{output}/report")
    total = report.agg(F.sum("texts").alias("texts"), F.sum("inputs").alias("inputs")).first()
    log.info("%d texts read from %s, %d inputs written to %s/inputs", total.texts or 0, source, total.inputs or 0, output)
    for r in report.orderBy("lang").limit(100).collect():
        log.info("%s: %d texts (%d without words), %d sentences of up to %d words, %s", r.lang, r.texts, r.empty_texts, r.sentences, r.longest_sentence, r.status)
    return report


def inputs(spark: SparkSession, output: str) -> DataFrame:
    """The inputs of an output folder."""
    return spark.read.schema(INPUTS).parquet(f"{output.rstrip('/')}/inputs")


if __name__ == "__main__":
    main(JOB, run, __doc__)
