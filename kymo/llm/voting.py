"""A quality classifier: the nearest labelled documents vote, in a latent semantic space.

A text is a bag of terms: its byte trigrams, hashed into buckets, and bands of measured ratios (symbols, repeated words and lines, letter
cases, lengths; a value between two bands belongs to both in part). How many documents hold each term is counted over the whole corpus
and gives the terms' weights. A bounded sample of labelled documents, weighted so, is decomposed, and its strongest singular directions are the
latent space. Their vectors, labels and the projection, a few megabytes whatever the corpus, are broadcast. Each document of the
corpus is projected and compared with every labelled vector by blocked matrix products, exactly; its nearest ones, ties included, vote with
a power of their cosine as weight.

Two passes over the texts, neither with a shuffle of them. Only the text enters a score.

Defined cases: a null text is an empty one, which has the bands of length zero and is scored; labels without a value or id are left out, of
several labels of one id the poorest counts, of several texts of a labelled id the smallest; a labelled id that has no document is
left out; without any label every score is 0.5, and where no neighbour has a positive cosine it is the labelled share; repeated rows
are scored each; an empty table gives none; columns of the input stay as they are, inside the column row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm import rules
from kymo.llm.common import claim

#: Labelled documents in the space at most, in the order of a hash of their id.
LABELLED_ROWS = 6_000
#: Dimensions of the space; neighbours that vote; power of the cosine that weighs a vote; score from which a document counts as good.
DIMENSIONS, NEIGHBOURS, POWER, GOOD_FROM = 64, 15, 8, 0.3
#: Hash buckets of byte trigrams, as a power of two; weight of the bands' half of a vector against the trigrams' half.
BUCKET_BITS, BAND_WEIGHT = 11, 2.0
#: Where the bands of ratios and of lengths (powers of two) lie.
RATIO_BANDS = np.array([0, 0.004, 0.01, 0.02, 0.035, 0.06, 0.1, 0.18, 0.3, 0.5, 0.75, 1.0])
LENGTH_BANDS = np.arange(0, 24, dtype=np.float64)
#: Rows and bytes of text that are turned into vectors at once.
BLOCK_ROWS, BLOCK_BYTES = 256, 1_000_000

_RATIOS = {name: parts for name, parts in rules.FEATURES.items() if name not in ("word_length", "line_length")}
_LENGTHS = ("n_words", "word_length", "line_length")
N_BUCKETS = 1 << BUCKET_BITS
N_BANDS = len(_RATIOS) * len(RATIO_BANDS) + len(_LENGTHS) * len(LENGTH_BANDS)
TERMS = N_BUCKETS + N_BANDS


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the ids, by checksum of the decimal id, whose labels are not learned from; a null id is not held out."""
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts as bytes, so many rows or bytes at a time (one text at least), nulls as empty."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = int(size[begin - 1]) if begin else 0
        stop = min(begin + BLOCK_ROWS, max(begin + 1, int(np.searchsorted(size, before + BLOCK_BYTES, side="right"))))
        yield texts.slice(begin, stop - begin)
        begin = stop


def _trigrams(texts: pa.Array) -> np.ndarray:
    """Rows of counts of the texts' hashed byte trigrams, A-Z lower-cased."""
    counts = np.zeros((len(texts), N_BUCKETS), dtype=np.float32)
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.as_py().lower(), dtype=np.uint8).astype(np.uint32)
        if len(raw) > 2:
            code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
            counts[k] = np.bincount((code * np.uint32(2_654_435_761)) >> np.uint32(32 - BUCKET_BITS), minlength=N_BUCKETS)
    return counts


def _bands(texts: pa.Array) -> np.ndarray:
    """Rows of memberships in the bands of the texts' measured ratios and lengths."""
    counted = np.array([rules.measure(t.as_py().decode("utf-8", "replace")) for t in texts], dtype=np.float64).reshape(-1, len(rules.COUNTS))
    column = dict(zip(rules.COUNTS, counted.T, strict=True))
    ratio = lambda parts: column[parts[0]] / np.maximum(column[parts[1]], 1)
    measured = [(ratio(parts), RATIO_BANDS) for parts in _RATIOS.values()]
    measured += [(np.log2(1 + x), LENGTH_BANDS) for x in (column["n_words"], *(ratio(rules.FEATURES[name]) for name in _LENGTHS[1:]))]
    out, at, rows = np.zeros((len(texts), N_BANDS), dtype=np.float32), 0, np.arange(len(texts))
    for value, bands in measured:
        place = np.interp(value, bands, np.arange(len(bands)))
        low = np.minimum(place.astype(np.int64), len(bands) - 2)
        out[rows, at + low] = 1 - (place - low)
        out[rows, at + low + 1] = place - low
        at += len(bands)
    return out


def terms_of(texts: pa.Array) -> np.ndarray:
    """Rows of TERMS: damped counts of trigrams, then memberships in bands."""
    return np.concatenate([np.log1p(_trigrams(texts)), _bands(texts)], axis=1)


def weighted(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """terms times their weights; either half of a row, unless empty, gets a length of its own."""
    out = terms * weights
    for half, length in ((out[:, :N_BUCKETS], 1.0), (out[:, N_BUCKETS:], BAND_WEIGHT)):
        half *= length / np.maximum(np.linalg.norm(half, axis=1, keepdims=True), 1e-12)
    return out


@dataclass(frozen=True)
class Space:
    """What is broadcast: terms' weights, the projection, the labelled documents' unit vectors and their labels."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        found = weighted(terms, self.weights) @ self.projection
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The nearest labelled vectors' vote on each row, from 0 to 1."""
        n = len(self.labels)
        if not n:
            return np.full(len(terms), 0.5)
        cosines = self.project(terms) @ self.vectors.T
        k = min(NEIGHBOURS, n)
        nearest = cosines >= np.partition(cosines, n - k, axis=1)[:, n - k, None]
        votes = np.where(nearest, np.maximum(cosines, 0), 0).astype(np.float64) ** POWER
        total = votes.sum(axis=1)
        share = float(self.labels.mean())
        return np.clip(np.where(total > 0, votes @ self.labels / np.where(total > 0, total, 1), share), 0, 1)


def term_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Each term's weight, log((1 + documents) / (1 + documents that hold it)) + 1, counted over all documents.

    A partition sends one row for each term that it holds; as many rows as there are terms reach the driver.
    """

    def run(batches):
        claim("voting")
        held, n = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for block in _blocks(batch.column(0)):
                held += (terms_of(block) > 0).sum(axis=0)
                n += len(block)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(held[there], n))], ["term", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(counted.collect())  # TERMS rows and one
    held = np.array([found.get(t, 0) for t in range(TERMS)], dtype=np.float64)
    return (np.log((1 + found.get(-1, 0)) / (1 + held)) + 1).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED_ROWS) -> DataFrame:
    """label and text of at most so many labelled documents that are not held out, in the order of a hash of their id."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    each = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label).cast("double")).alias("label"))
    chosen = each.orderBy(F.xxhash64("id"), "id").limit(most)  # a bounded top list
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("id", "label", "text")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED_ROWS, dimensions: int = DIMENSIONS) -> Space:
    """The space of a sample of labelled documents, by weights that all documents give."""
    weights = term_weights(docs, text_col)

    def run(batches):
        claim("voting")
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(2)):
                terms = terms_of(block)
                row, term = np.nonzero(terms)
                cuts = np.searchsorted(row, np.arange(len(block) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (term.astype(np.int16), terms[row, term])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), batch.column(1).slice(at, len(block)), *lists], ["id", "label", "term", "value"])
                at += len(block)

    sample = labelled_sample(docs, labels, label, id_col, text_col, most).mapInArrow(run, "id long, label double, term array<short>, value array<float>").toArrow()
    order = np.argsort(sample["id"].to_numpy(), kind="stable")
    rows = np.zeros((len(order), TERMS), dtype=np.float32)
    for k, (term, value) in enumerate(zip(sample["term"], sample["value"], strict=True)):
        rows[k, term.values.to_numpy()] = value.values.to_numpy()
    rows = weighted(rows[order], weights)
    _, directions = np.linalg.eigh((rows.T @ rows).astype(np.float64)) if len(rows) else (None, np.zeros((TERMS, 0)))
    space = Space(weights, np.ascontiguousarray(directions[:, ::-1][:, :dimensions], dtype=np.float32), np.zeros((0, dimensions), dtype=np.float32), np.zeros(0))
    if not len(rows):
        return space
    vectors = rows @ space.projection
    return Space(weights, space.projection, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), sample["label"].to_numpy()[order])


def scored(docs: DataFrame, space: Space, text_col: str = "text") -> DataFrame:
    """Each row, as the struct row, with the score of its text."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(texts: pa.Array) -> pa.Array:
        claim("voting")
        return pa.array(np.concatenate([sent.value.scores(terms_of(block)) for block in _blocks(texts)] or [np.zeros(0)]))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.arrow_udf(run, "double")(F.col(text_col).cast("string")).alias("score"))
