import random

import numpy as np
import pytest

from kymo.llm import nearcopies as N
from kymo.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = (t or "").translate(LOW).encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) or docs[i][0] is not None and docs[i][0] == docs[j][0]:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for n, (i, _) in enumerate(docs):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, len(s), least.get(root(n)) if s else i) for n, ((i, _), s) in enumerate(zip(docs, sets))), key=str)


def run(df):
    rows = N.near_copies(df).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("block", [1024, 5])
def test_equals_brute_force(spark, prose, monkeypatch, block):
    monkeypatch.setattr(N, "KEY_BLOCK", block)
    monkeypatch.setattr(N, "FAMILY_BLOCK", block)
    docs = [(i * 37 % 1009, t) for i, t in enumerate(prose)]
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_odd_rows(odd_docs, no_docs):
    assert run(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert run(no_docs) == []


def test_close_signatures_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, N.PLACES, dtype=np.uint16)
    for _ in range(300):
        b = a.copy()
        at = rng.permutation(N.PLACES)[: N.MOST_ERRORS]
        b[at] ^= np.uint16(1)
        keys = N.signature_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]
    assert N.overlaps(sets[:4], sets[4:]).tolist() == want


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "t").collect()))
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert len(got) == len(near)
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def components_at(docs, percent):
    sets, near = [shingles(t) for _, t in docs], {}
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                near.setdefault(i, set()).add(j)
                near.setdefault(j, set()).add(i)
    out = {}
    for start in range(len(docs)):
        seen, todo = {start}, [start]
        while todo:
            for x in near.get(todo.pop(), set()) - seen:
                seen.add(x)
                todo.append(x)
        out[docs[start][0]] = min(docs[x][0] for x in seen)
    return out


def test_other_similarities_equal_brute_force(spark, prose):
    docs = [(i * 37 % 1009, t) for i, t in enumerate(prose)]
    df, found = spark.createDataFrame(docs, "doc_id long, text string"), []
    for percent in (N.STANDARD, N.PERCENT):
        got = {r.doc_id: r.component_id for r in N.near_copies(df, percent=percent).collect()}
        assert got == components_at(docs, percent)
        found.append(len(set(got.values())))
    assert found[0] < found[1]


def test_close_signatures_share_a_key_at_every_similarity():
    rng = np.random.default_rng(1)
    assert N.distance_of(N.PERCENT) == (N.CHUNKS, N.MOST_ERRORS)
    for percent in (50, 65, 80, 90, 99):
        chunks, most = N.distance_of(percent)
        a = rng.integers(0, 2**16, N.PLACES, dtype=np.uint16)
        for _ in range(100):
            b = a.copy()
            b[rng.permutation(N.PLACES)[:most]] ^= np.uint16(1)
            keys = N.signature_keys(np.stack([a, b]), chunks, most)
            assert (keys[0] == keys[1]).any()
