"""Texts as sentences and as inputs of a bounded length, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.operators.grid import SENTENCE_ENDS

#: What separates words.
BLANK = r"[ \t\n\x0B\f\r]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def sentences_of(text: Column) -> Column:
    """The sentences of a text, each an array of words: a word whose last character ends a sentence is a sentence's last.

    The same rule as segment_words() without pauses, in one row and without a window.
    """
    parts = F.split(text, rf"(?<=[{SENTENCE_ENDS}]){BLANK}")
    return F.filter(F.transform(parts, words_of), lambda s: F.size(s) > 0)


def model_inputs(texts: DataFrame, core_words: int, context_words: int, text: str = "text") -> DataFrame:
    """A row for each input of each text: other columns, sentence, chunk, ranges of core and context in words of the sentence, text, status.

    Sentences of more than core_words words are cut: cores tile them, a context reaches context_words words to both sides.
    """
    if core_words < 1 or context_words < 0:
        raise ValueError("core_words must be positive and context_words not negative")
    others = [c for c in texts.columns if c != text]
    rows = texts.select(*others, F.posexplode(sentences_of(F.col(text))).alias("sentence", "_words")).withColumn("_n", F.size("_words"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / core_words).cast("int"))).alias("chunk"))
    start = F.col("chunk") * core_words
    end = F.least(F.col("_n"), start + core_words)
    rows = rows.select("*", start.alias("core_start"), end.alias("core_end"), F.greatest(F.lit(0), start - context_words).alias("context_start"), F.least(F.col("_n"), end + context_words).alias("context_end"))
    whole = F.array_join(F.slice("_words", F.col("context_start") + 1, F.col("context_end") - F.col("context_start")), " ")
    return rows.select(*others, "sentence", "chunk", "core_start", "core_end", "context_start", "context_end", whole.alias(text), F.when(F.col("_n") > core_words, "WARN").otherwise("PASS").alias("status"))
