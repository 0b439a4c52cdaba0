import random
import zlib

import numpy as np
import pytest

from kymo.llm import shards


def brute_capacity(sizes, k):
    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= k

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


def test_smallest_capacity():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))]
        k = rng.randrange(1, 8)
        assert shards.smallest_capacity(np.array(sizes), k) == brute_capacity(sizes, k)


def test_cuts_stay_within_the_capacity():
    rng = random.Random(4)
    for _ in range(60):
        sizes = np.array([rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))])
        k = rng.randrange(1, 9)
        cuts = [0, *shards.even_cuts(sizes, k), len(sizes)]
        assert len(cuts) == k + 1 and cuts == sorted(cuts)
        assert max(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:])) <= shards.smallest_capacity(sizes, k)


def check(rows, texts, k):
    assert all(r.size == len((texts[i] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[i] or "").encode()) for i, r in rows)
    by_shard, by_text = {}, {}
    for i, r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < k
        by_shard.setdefault(r.shard, []).append(r)
        by_text.setdefault(texts[i] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    return {s: sum(r.size for r in rs) for s, rs in by_shard.items()}


@pytest.mark.parametrize("exact", [400_000, 3])
def test_balanced_and_whole(spark, monkeypatch, exact):
    monkeypatch.setattr(shards, "EXACT_GROUPS", exact)  # 3: refined down to single groups
    monkeypatch.setattr(shards, "FIRST_BITS", 6 if exact == 3 else 14)
    rng = random.Random(9)
    texts = {i: "x" * rng.randrange(5, 200) + str(i % 300) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes = check([(r.doc_id, r) for r in shards.shard_by_bytes(df, 12).collect()], texts, 12)
    assert len(sizes) == 12 and max(sizes.values()) < 1.2 * min(sizes.values())


def test_a_text_with_a_third_of_all_rows(spark):
    texts = {i: "hot text" * 20 if i % 3 == 0 else f"text {i} " * 20 for i in range(900)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes = check([(r.doc_id, r) for r in shards.shard_by_bytes(df, 24).collect()], texts, 24)
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 24 and max(rest) < 1.15 * min(rest)


def test_odd_rows(odd_docs, no_docs, spark):
    rows = shards.shard_by_bytes(odd_docs, 24).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.size for r in rows) == sorted(len((r.text or "").encode()) + 8 for r in odd_docs.collect())
    assert len({r.shard for r in rows if r.text_crc32 == 0}) == 1  # null and empty
    assert shards.shard_by_bytes(no_docs, 24).collect() == []
