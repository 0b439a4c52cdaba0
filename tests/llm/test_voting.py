import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kymo.llm import queries, rules, voting

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def plain_terms(text):
    """Terms of one text by a dictionary of trigrams and bands looked up one at a time."""
    raw = text.encode().lower()
    bags = Counter(((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2_654_435_761 % 2**32) >> (32 - voting.BUCKET_BITS) for i in range(len(raw) - 2))
    out = np.zeros(voting.TERMS)
    for b, n in bags.items():
        out[b] = math.log1p(n)
    c = dict(zip(rules.COUNTS, rules.measure(text), strict=True))
    values = [(c[a] / max(c[b], 1), voting.RATIO_BANDS) for a, b in voting._RATIOS.values()]
    values += [(math.log2(1 + x), voting.LENGTH_BANDS) for x in (c["n_words"], c["word_chars"] / max(c["n_words"], 1), c["n_words"] / max(c["n_lines"], 1))]
    at = voting.N_BUCKETS
    for v, bands in values:
        for k, b in enumerate(bands):
            near = [abs(b - bands[j]) for j in (k - 1, k + 1) if 0 <= j < len(bands) and (v >= b) == (bands[j] > b)]
            out[at + k] = max(0.0, 1 - abs(v - b) / near[0]) if near else float(v == b)
        at += len(bands)
    return out


def test_terms_equal_a_plain_reading():
    texts = ["", "ab", "The the THE. ### 12", "ü€ 😀 ñandú\n\nline\nline", "x" * 3000, "a b c " * 40]
    got = voting.terms_of(pa.array(texts, pa.binary()))
    assert np.allclose(got, [plain_terms(t) for t in texts], atol=1e-5)
    assert all(len(b) for b in voting._blocks(pa.array([*texts, None]))) and sum(map(len, voting._blocks(pa.array(texts * 100)))) == 600


def test_weights_count_every_document(documents):
    texts = [r.text for r in documents.select("text").collect()]
    held = sum((voting.terms_of(b) > 0).sum(axis=0) for b in voting._blocks(pa.array(texts)))
    assert np.allclose(voting.term_weights(documents), np.log((1 + len(texts)) / (1 + held)) + 1, rtol=1e-6)


def test_votes_equal_one_at_a_time(documents, labels):
    """Each cosine, neighbour and vote computed for itself, ties included."""
    space = voting.learn(documents, labels)
    assert len(space.labels) > 250 and set(space.labels) == {0.0, 1.0}
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    got = {r.row.doc_id: r.score for r in voting.scored(documents, space).collect()}
    assert len(got) == documents.count()
    for i, text in rows:
        terms = plain_terms(text) * space.weights
        for half, size in ((terms[: voting.N_BUCKETS], 1.0), (terms[voting.N_BUCKETS :], voting.BAND_WEIGHT)):
            half *= size / max(np.linalg.norm(half), 1e-12)
        place = terms @ space.projection
        place /= np.linalg.norm(place)
        near = sorted(((float(place @ v), float(y)) for v, y in zip(space.vectors, space.labels, strict=True)), reverse=True)
        votes = [(max(c, 0) ** voting.POWER, y) for c, y in near if c >= near[voting.NEIGHBOURS - 1][0] - 1e-7]
        assert got[i] == pytest.approx(sum(v * y for v, y in votes) / sum(v for v, _ in votes), abs=0.02)


def test_space_is_the_best_of_its_rank(documents, labels):
    """No other projection of as many directions keeps more of the sample (singular values of the weighted terms)."""
    weights = voting.term_weights(documents)
    sample = voting.labelled_sample(documents, labels).orderBy("id").collect()
    rows = voting.weighted(np.concatenate([voting.terms_of(b) for b in voting._blocks(pa.array([r.text for r in sample]))]), weights)
    space = voting.learn(documents, labels, dimensions=16)
    kept = np.linalg.norm(rows @ space.projection) ** 2
    assert kept == pytest.approx((np.linalg.svd(rows, compute_uv=False)[:16] ** 2).sum(), rel=1e-4)


def test_held_out_accuracy(spark):
    big = DATA.replace("0.01", "0.1")
    done = queries.op11_votes(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").select("quality", "predicted", "score").toPandas()
    good, poor = done[done.quality == 1], done[done.quality == 0]
    assert len(poor) > 100
    assert (good.predicted == 1).mean() > 0.995 and (poor.predicted == 0).mean() > 0.95
    assert (good.score.to_numpy()[:, None] > poor.score.to_numpy()[None, :]).mean() > 0.99


def test_held_out_labels_are_not_read(spark, documents, labels):
    mine = zlib.crc32(b"17") % 5 == 0
    assert spark.range(17, 18).select(voting.held_out("id")).first()[0] == mine
    spoilt = labels.withColumn("quality", F.when(voting.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (voting.labelled_sample(documents, x).select("id", "label").orderBy("id").collect() for x in (labels, spoilt))
    assert a == b and not any(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in a)
    assert voting.labelled_sample(documents, labels, most=7).count() == 7


def test_odd_rows(spark, odd_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(3, 0, 1), (3, 1, 0), (5, 1, 0), (7, 0, 0), (8, 1, 0), (None, 1, 1), (9, None, 0), (999, 1, 0), (12, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    space = voting.learn(odd_docs, labels)
    usable = {i: y for i, y in {3: 0, 5: 1, 7: 0, 8: 1, 10: 0, 12: 1}.items() if zlib.crc32(str(i).encode()) % 5}
    assert sorted(space.labels) == sorted(map(float, usable.values()))
    rows = voting.scored(odd_docs, space).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.row.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert voting.scored(no_docs, space).collect() == []
    for docs, given in ((odd_docs, no_labels), (no_docs, labels)):
        assert {r.score for r in voting.scored(odd_docs, voting.learn(docs, given)).collect()} == {0.5}
