import random

import pyarrow as pa
import pytest

from kymo.llm import lines

UP = str.maketrans(lines.UPPER, lines.LOWER)


def brute(docs, min_chars=20, min_docs=3):
    """(n_lines, n_dropped, kept) of each (doc_id, text)."""
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders.setdefault(x.strip(" \t\n\x0b\x0c\r").translate(UP), set()).add(i)
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = []
        for x in parts:
            k = x.strip(" \t\n\x0b\x0c\r").translate(UP)
            if not (len(k) >= min_chars and len(holders[k]) >= min_docs and max(holders[k], key=lambda v: -(2**63) if v is None else v) != i):
                kept.append(x)
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def run(df):
    done = lines.apply(df, lines.repeated_lines(df)).select("row.doc_id", "kept.n_lines", "kept.n_dropped", "kept.text")
    return sorted(map(tuple, done.collect()), key=str)


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_equals_brute_force(spark, parts):
    rng = random.Random(int(parts))
    pool = [f"A common line of words number {i}" for i in range(8)]
    docs = []
    for i in range(300):
        rows = [rng.choice(pool) if rng.random() < 0.4 else "  the Hottest line of them all \t" if rng.random() < 0.5 else f"lone line number {i} {rng.random()}" for _ in range(rng.randrange(1, 9))]
        docs.append((i * 7 % 301, "\n".join(rows)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = run(spark.createDataFrame(docs, "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute(docs), key=str)


def test_odd_rows(odd_docs, no_docs):
    assert run(odd_docs) == sorted(brute([(r.doc_id, r.text) for r in odd_docs.collect()]), key=str)
    assert run(no_docs) == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_marks_do_not_depend_on_batches(size):
    rng = random.Random(1)
    rows = sorted(((rng.randrange(6), 0, -rng.randrange(9), p) for p in range(200)), key=lambda r: (r[0], r[2], r[3]))
    table = pa.table({"doc": [-r[2] for r in rows], "content": [0] * len(rows), "pos": pa.array([r[3] for r in rows], pa.int32()), "h1": [r[0] for r in rows], "h2": [0] * len(rows)})
    out = pa.Table.from_batches(list(lines._mark(3)(iter(table.to_batches(max_chunksize=size))))).to_pylist()
    summaries = {r["h1"]: r for r in out if r["docs"] is not None}
    marked = {(r["doc"], r["pos"]) for r in out if r["docs"] is None and (not r["open"] or r["h1"] in summaries and len(summaries[r["h1"]]["docs"]) >= 3 and r["doc"] != max(summaries[r["h1"]]["docs"]))}
    docs_of = {h: {-r[2] for r in rows if r[0] == h} for h in range(6)}
    assert marked == {(-r[2], r[3]) for r in rows if len(docs_of[r[0]]) >= 3 and -r[2] != max(docs_of[r[0]])}


def test_bitmap_padding_keeps():
    batch = pa.record_batch({"doc": pa.array([1]), "content": pa.array([1]), "dropped": pa.array([[0, 2]], pa.list_(pa.int32()))})
    keep = next(lines._bitmaps([batch])).column("keep")[0].as_py()
    assert lines.kept_lines(list("abcdefghijkl"), keep) == list("bdefghijkl")
