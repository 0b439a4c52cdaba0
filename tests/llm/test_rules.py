import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.llm import rules as R


def brute_counts(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blank:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if x.strip(blank)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, t in enumerate(three) if three.count(t) > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b ", "é\n", "# ", "x y z ", "\t", "<", "b a ", " "]) for _ in range(rng.randrange(60)))
        assert R.measure(t)[:5] == brute_counts(t)
    assert R.measure(None)[:5] == (0, 0, 0, 0, 0)


def sample(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    c = np.zeros((n, len(R.COUNTS)), dtype=np.int64)
    at = {k: i for i, k in enumerate(R.COUNTS)}
    c[:, at["n_words"]] = rng.integers(50, 900, n)
    c[:, at["word_chars"]] = c[:, at["n_words"]] * 5
    c[:, at["n_lines"]] = rng.integers(1, 30, n)
    c[:, at["n_upper"]] = c[:, at["n_words"]] // 10
    kind = rng.integers(0, 10, n)
    symbols, upper = kind == 0, kind == 1
    c[symbols, at["n_symbols"]] = c[symbols, at["n_words"]] * 2
    c[upper, at["n_upper"]] = c[upper, at["word_chars"]] // 2
    return c, symbols | upper


def test_learns_and_generalises():
    found = R.learn(*sample())
    assert 1 <= len(found) <= 4
    c, poor = sample(seed=1)
    hit = np.zeros(len(poor), bool)
    for r in found:
        hit |= R._covers(r.conditions, R.ratios(c), len(poor))
    assert (hit == poor).mean() > 0.99


def test_no_rule_without_both_labels():
    c, _ = sample(50)
    assert R.learn(c, np.zeros(50, bool)) == [] and R.learn(c, np.ones(50, bool)) == []


def test_expression_is_the_list(spark):
    found = R.learn(*sample())
    c, _ = sample(200, seed=2)
    df = spark.createDataFrame([(list(map(int, r)),) for r in c], "a array<long>")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(F.struct(*[F.get("a", F.lit(i)).alias(k) for i, k in enumerate(R.COUNTS)]).alias("counts")).select(R.as_column(found)).collect()]
    want = []
    for row in c:
        x = R.ratios(row[None])
        want.append(next((n for n, r in enumerate(found, 1) if R._covers(r.conditions, x, 1)[0]), 0))
    assert got == want and len(set(want)) > 1


def test_odd_rows(spark, odd_docs, no_docs, no_labels):
    assert R.learn_from(odd_docs, no_labels) == []
    rows = R.judged(odd_docs, []).collect()
    assert sorted((r.counts[:5] for r in rows), key=str) == sorted((brute_counts(r.text) if len(r.text or "") < 1000 else tuple(R.measure(r.text)[:5]) for r in odd_docs.collect()), key=str)
    assert all(r.kept == (not r.base_failed) and r.base_failed == (r.counts.n_words < 50 or 100 * r.counts.n_repeat_words > 50 * r.counts.n_words) for r in rows)
    assert R.judged(no_docs, []).collect() == []
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert R.learn_from(odd_docs, labels) == []


def test_what_the_base_rules_reject_teaches_nothing(spark):
    """Repeated words mark half of the poor documents, which fall to the base rules; only the symbols of the others are learned."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 120))]
        if i % 6 == 0:
            words = ["same", "three", "words"] * 30
        if i % 6 == 1:
            words = [w + "$" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 > 1)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = R.learn_from(docs, labels)
    assert [[c.feature for c in r.conditions] for r in found] == [["symbols"]]
    rows = R.judged(docs, found).select("row.doc_id", "base_failed", "kept").collect()
    assert all((r.base_failed, r.kept) == (r.doc_id % 6 == 0, r.doc_id % 6 > 1) for r in rows)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the tables")
def test_held_out_labels_of_the_table(spark):
    """Rules learned on half of the labels judge the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = R.learn_from(docs, labels.where("doc_id % 2 = 0"))
    rows = R.judged(docs.join(labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id"), found).where("not base_failed").select("row.quality", "kept").collect()
    assert len(rows) > 1000 and np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.99
