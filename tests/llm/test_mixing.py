import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.llm import mixing as M


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        kind = i % 10
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        if kind == 0:
            words[:: max(1, len(words) // 6)] = ["nasty", "awful", "vile"][i // 10 % 3 :][:1] * len(words[:: max(1, len(words) // 6)])
        if kind == 1:
            words = [w + "$$$" for w in words]
        docs.append((i, " ".join(words), kind))
        if i % 2 == i // 10 % 2:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, rate int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_targets_are_met_and_held_out_documents_are_told_apart(corpus):
    rows = M.rated(*corpus).collect()
    p, n, rate = (np.array(x) for x in ([[r[f"p_{d}"] for d in M.DOMAINS] for r in rows], [r.n_tokens for r in rows], [r.rate for r in rows]))
    have, now = n @ p, (n * rate) @ p
    aim = np.array([M.TARGETS[d] for d in M.DOMAINS]) * have[0]
    # the optimum of the constrained least squares: no gradient where the rate is positive, none downhill where it is zero
    slope = p @ ((now - aim) / have)
    assert np.abs(slope[rate > 1e-9]).max() < 1e-4 and slope[rate <= 1e-9].min(initial=0.0) > -1e-4
    assert now == pytest.approx(aim, rel=1e-3)  # the pull to 1 takes a little
    drawn = (n * np.array([r.copies for r in rows])) @ p
    assert drawn[0] == pytest.approx(aim[0], rel=0.01) and drawn[1:] == pytest.approx(aim[1:], abs=int(n.max()))  # a document at most
    known = {r.doc_id for r in corpus[1].collect()}
    right = [max(M.DOMAINS, key=lambda d: r[f"p_{d}"]) == {0: "toxic", 1: "poor"}.get(r.row.rate, "clean") for r in rows if r.row.doc_id not in known]
    assert np.mean(right) > 0.98
    clean = [r for r in rows if r.row.rate > 1]
    assert np.mean([r.copies >= 1 for r in clean]) > 0.98 and all(r.rate >= 0 for r in rows)


def test_steps_end_where_a_plain_projected_gradient_does(spark):
    rng = np.random.default_rng(0)
    q = rng.integers(0, 120, size=(40, 2))
    q = np.column_stack([256 - q.sum(axis=1), q])
    n = rng.integers(10, 900, 40)
    cells = spark.createDataFrame([(int(a), int(b), int(c), int(t)) for (a, b, c), t in zip(q, n)], "q_clean int, q_poor int, q_toxic int, tokens long")
    targets = {"clean": 1.0, "poor": 0.2, "toxic": 0.1}
    p, r = q / 256, np.ones(40)
    have = (n[:, None] * p).sum(axis=0)
    aim = np.array([targets[d] for d in M.DOMAINS]) * have[0]
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (((n * r) @ p - aim) / have))
    steps = M.fitted_steps(cells, targets)
    got = np.array([x.r for x in cells.select(M.rate_after(steps).alias("r"), "tokens").collect()])
    assert (got >= 0).all() and (got == 0).any()
    loss = lambda r: ((((n * r) @ p - aim) ** 2) / have).sum()
    assert loss(got) <= loss(r) + 1e-6 * have.sum()
    assert ((n * (got - 1) ** 2).sum()) <= (n * (r - 1) ** 2).sum() * (1 + 1e-6) or loss(got) < loss(r)


def test_short_domains_are_repeated_and_unreachable_targets_are_told(corpus, spark):
    docs, labels = corpus
    rows = M.rated(docs, labels, targets={"clean": 1.0, "poor": 0.5, "toxic": 0.3}).collect()
    p, n = np.array([[r[f"p_{d}"] for d in M.DOMAINS] for r in rows]), np.array([r.n_tokens for r in rows])
    drawn = (n * np.array([r.copies for r in rows])) @ p
    assert max(r.copies for r in rows) >= 3
    assert drawn / drawn[0] == pytest.approx([1.0, 0.5, 0.3], rel=0.01)
    # every document leaks into the last domain, so that no rates give that domain nothing and the first all its tokens
    cells = spark.createDataFrame([(200, 0, 56, 1000), (180, 0, 76, 500)], "q_clean int, q_poor int, q_toxic int, tokens long")
    with pytest.warns(UserWarning, match="reach|ends after"):
        steps = M.fitted_steps(cells, {"clean": 1.0, "poor": 0.0, "toxic": 0.001})
    r = np.array([x.r for x in cells.select(M.rate_after(steps).alias("r"), "tokens").collect()])
    p, n = np.array([[200, 0, 56], [180, 0, 76]]) / 256, np.array([1000, 500])
    have = n @ p
    aim = np.array([1.0, 0.0, 0.001]) * have[0]
    loss = lambda r: (((n * r) @ p - aim)[[0, 2]] ** 2 / have[[0, 2]]).sum()
    grid = np.linspace(0, 1.5, 301)
    assert loss(r) <= min(loss(np.array([a, b])) for a in grid for b in grid) * 1.001 and len(steps) < M.MOST_STEPS


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the tables")
def test_targets_are_met_by_whole_copies(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = M.rated(docs, labels, keep=["doc_id"])
    share = lambda x: [F.sum(F.col(x) * F.col("n_tokens") * F.col(f"p_{d}")) if x else F.sum(F.col("n_tokens") * F.col(f"p_{d}")) for d in M.DOMAINS]
    have, drawn = (np.array(rows.agg(*share(x)).first()) for x in ("", "copies"))
    assert drawn == pytest.approx(np.array([M.TARGETS[d] for d in M.DOMAINS]) * have[0], rel=0.01)


def test_copies_of_rows(corpus):
    docs, labels = corpus
    want = sum(r.copies for r in M.rated(docs, labels).collect())
    done = M.mixed(docs, labels)
    assert done.columns == docs.columns and done.count() == want


def test_odd_rows(spark, odd_docs, no_docs, no_labels):
    rows = M.rated(odd_docs, no_labels).collect()
    assert len(rows) == odd_docs.count() and all(r.rate == 1.0 and r.copies == 1 and r.p_clean == 1.0 for r in rows)
    labels = spark.createDataFrame([(3, None, None), (None, 1, 0), (5, 1, 0), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(M.rated(odd_docs, labels).collect()) == len(rows)
    assert M.rated(no_docs, labels).collect() == [] and M.mixed(no_docs, no_labels).collect() == []


def test_small_rates_are_drawn(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) + ("$$$" if i % 5 < 3 else "") for _ in range(60))) for i in range(5000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 >= 3), 0) for i in range(0, 5000, 3)], "doc_id long, quality int, toxic int")
    rows = M.rated(docs, labels).collect()
    poor = [r for r in rows if r.p_poor > 0.9]
    want = sum(r.rate for r in poor)
    assert len(poor) == 3000 and max(r.rate for r in poor) < 0.05 and want > 20
    assert abs(sum(r.copies for r in poor) - want) < 4 * want**0.5
    assert sum(r.copies for r in rows) == pytest.approx(sum(r.rate for r in rows), rel=0.03)
