import numpy as np
import pytest

from kymo.llm import vectors as V


def brute(rows, cosine=0.95):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    near = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and unit[i] @ unit[j] >= cosine} for i in ok}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for x in near.get(todo.pop(), set()) - seen:
                seen.add(x)
                todo.append(x)
        out[i] = (len(near.get(i, ())), min(seen) if i is not None else None)
    return out


def clustered(n=700, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 10, dim))
    rows = [base[i % 5 if i < n // 3 else i % len(base)] + rng.normal(size=dim) * 0.12 for i in range(n)]
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(n), rows)]


@pytest.mark.parametrize(("shard", "block"), [(1_000, 1_024), (120, 64)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(V, "SHARD", shard)
    monkeypatch.setattr(V, "BLOCK", block)
    rows = clustered()
    result, audit = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in result.collect()}
    want = brute(rows)
    found, true = audit.groupBy().sum("found", "true").first()
    assert true > 0 and found == true
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0]), (10, [1.0, 2.0, 0.0]), (11, [-1.0, -2.0]), (12, [1e-200, 2e-200])]
    df = spark.createDataFrame([(i, v, 0, 0, "u") for i, v in rows], "vec_id long, embedding array<double>, id int, dim int, unit string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(df)[0].collect()), key=str)
    want = brute([(i, v) for i, v in dict((i, v) for i, v in rows if i is not None).items()])
    assert got == sorted([(i, n, c, i == c) for i, (n, c) in want.items()] + [(None, 0, None, True)], key=str)
    assert want[7] == (3, 7)
    assert V.near_vectors(spark.createDataFrame([], df.schema))[0].collect() == []


def test_search_finds_what_is_in_range():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16)).repeat(10, axis=0) + rng.normal(size=(600, 16)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, v = V.in_range(x, V.pruned_graph(x), np.arange(600), 0.95)
    true = (x @ x.T >= 0.95).sum()
    assert len(set(zip(q.tolist(), v.tolist()))) == len(q)
    assert (np.einsum("ij,ij->i", x[q], x[v]) >= 0.95 - 1e-12).all() and len(q) >= 0.95 * true


def planted(n=20_000, dim=64, seed=1):
    """Random vectors, every second one a neighbour of the one before."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[1::2] = x[::2] + rng.normal(size=(n // 2, dim)) * 0.29
    return x


def test_pairs_that_share_no_shard(spark):
    x = planted()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((unit[s : s + 1000] @ unit.T >= 0.95).sum()) for s in range(0, len(x), 1000)) - len(x)
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": [list(map(float, v)) for v in x]}))
    result, audit = V.near_vectors(table)
    got = result.groupBy().sum("n_links").first()[0]
    found, true = audit.first()
    assert 10_000 < want and 0.995 * want <= got <= want
    assert true > 50 and found >= 0.995 * true


def test_large_shards_are_dealt_again(spark, monkeypatch):
    for name, value in (("MOST_CENTRES", 3), ("SHARD", 100), ("SPLIT", 200), ("BLOCK", 128)):
        monkeypatch.setattr(V, name, value)
    rows = clustered(1_500)
    result, audit = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in result.collect()} == brute(rows)
    found, true = audit.first()
    assert found == true > 0


def test_many_lengths(spark):
    """Vectors of three hundred lengths: no centres, and no driver job for each."""
    rng = np.random.default_rng(5)
    rows = []
    for d in range(2, 302):
        v = rng.normal(size=d)
        rows += [(len(rows), v.tolist()), (len(rows) + 1, (v * 1.5 + 1e-3).tolist())]
    result, _ = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in result.collect()} == brute(rows)
