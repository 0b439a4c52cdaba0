import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kymo.llm import periodic, queries


def brute(words):
    """(start, length, period) of every maximal run of two smallest periods or more."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - begin >= q:
                found.setdefault((begin, i + q - begin), q)
            i += 1
    return sorted((s, m, q) for (s, m), q in found.items())


def long_runs(words):
    return sorted((r for r in brute(words) if r[1] >= max(6, 4 * r[2])), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in gone]


def tree_runs(docs):
    starts = np.cumsum([0, *map(len, docs)])
    begin, end, period = periodic.SuffixTree(np.array(sum(docs, []), dtype=np.int64), starts).runs()
    return sorted(zip(begin.tolist(), (end - begin).tolist(), period.tolist(), strict=True)), starts.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=24), min_size=1, max_size=4))
def test_runs_equal_all_periods(docs):
    got, starts = tree_runs(docs)
    assert got == sorted((s + at, m, q) for d, at in zip(docs, starts, strict=False) for s, m, q in brute(d))


def test_hard_words():
    a, b = [0], [1]
    for _ in range(14):
        a, b = a + b, a
    fibonacci = a[:400]
    for words in (fibonacci, [0] * 301, [0, 1] * 150 + [0, 0, 1] * 60, [*range(50)] * 7 + [3], [0] * 9 + [1] + [0] * 9 + [1] + [0] * 9):
        assert tree_runs([words])[0] == brute(words)
    assert tree_runs([[7] * 50_000])[0] == [(0, 50_000, 1)]


def test_blocks_do_not_matter(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + ["x y " * 90, "", None, " \t\x0b ", "no\x1cspace é 😀 " * 5]
    want = []
    for t in texts:
        words = (t or "").encode().split()
        runs = long_runs(words)
        want.append({"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": b" ".join(collapse(words, runs)).decode()})
    for size, visits in ((1_000_000, 1_000_000), (40, 7)):
        monkeypatch.setattr(periodic, "BLOCK_BYTES", size)
        monkeypatch.setattr(periodic, "VISITS", visits)
        array, begin, got = pa.array(["skipped", *texts]).slice(1), 0, []
        step = len(texts) if size > 1000 else 3
        while begin < len(texts):
            got += periodic._searched(array.slice(begin, step), 6, 4).to_pylist()
            begin += step
        assert got == want


def test_odd_rows(odd_docs, no_docs):
    done = periodic.with_runs(odd_docs)
    assert done.columns == ["row", "found"] and done.select("row.*").columns == odd_docs.columns
    for r in done.collect():
        words = (r.row.text or "").encode().split()
        runs = long_runs(words) if len(words) < 1000 else []
        assert [tuple(x) for x in r.found.runs] == runs and r.found.n_words == len(words)
        assert r.found.collapsed == b" ".join(collapse(words, runs)).decode()
    assert periodic.with_runs(no_docs).collect() == []


def test_least_words_and_periods(spark):
    docs = spark.createDataFrame([("a b a b a",), ("a b c a b c",)], "text string")
    found = periodic.with_runs(docs, least_words=2, least_periods=2).collect()
    assert [[tuple(x) for x in r.found.runs] for r in found] == [[(0, 5, 2)], [(0, 6, 3)]]
    assert [r.found.collapsed for r in found] == ["a b", "a b c"]
    with pytest.raises(ValueError):
        periodic.periodic("text", least_periods=1)


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k if k < a else a + (k - a) % p] for k in range(n)]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("a", "b", "cé")) for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [(None, "a a a a a a a"), (401, None), (402, "b b b b b b, b b b b b b"), (403, "a b a b a b a b x c c c c c c c c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = planted(i, [w.decode() for w in (t or "").encode().split()])
        runs = long_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(collapse(words, runs)))
        want.append((i, len(runs), *most, *(hashlib.sha256(x.encode()).hexdigest() for x in digests)))
    got = [tuple(r) for r in queries.op12_periodic(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20
