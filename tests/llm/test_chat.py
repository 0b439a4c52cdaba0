import os
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.llm import chat as C


def test_markers():
    for line, role, rest in (("User: hi", "user", "hi"), ("**Assistant:** ok", "assistant", "ok"), ("### Human", "user", ""), ("<|im_start|>system", "system", ""), ("<|user|>text", "user", "text"), ("[AI 2]: yes", "assistant", "yes"), ("Q: why?", "user", "why?")):
        k, n = C.marker_of(line)
        assert C.ROLES[k] == role and line[n:] == rest, line
    for line in ("The user: none of it", "assistants gather", "", "note: user"):
        assert C.marker_of(line)[0] == -1


def model():
    return C.Model([(c, t, r, x) for c in range(20) for t, (r, x) in enumerate([("system", "be brief"), ("user", "what is it?"), ("assistant", "a long answer " * 30), ("user", "and why?"), ("assistant", "because " * 40)])])


def score_of(m, lines, states):
    s = m.start[states[0]] + lines[0].emission(m)[states[0]]
    for a, b, x in zip(states, states[1:], lines[1:]):
        s += m.transition(x.first, x.marker)[a, b] + x.emission(m)[b]
    return s


def test_viterbi_is_the_best_path_also_in_parts():
    rng, m = random.Random(1), model()
    for _ in range(20):
        texts = [rng.choice(["why?", "User: x", "answer " * 50, "two\nlines", "be good"]) for _ in range(6)]
        lines = C.lines_of(texts)
        whole = C.viterbi(m, lines)
        if len(lines) <= 8:
            # by enumeration; of equally good paths any
            assert score_of(m, lines, whole) == pytest.approx(max(score_of(m, lines, x) for x in product(range(3), repeat=len(lines))), abs=1e-9)
        k = rng.randrange(1, len(lines))
        edges = [{"conv": 1, "part": n, "matrix": C.summary(m, p).ravel(), "opening": ((m.start + p[0].emission(m))[:, None] + C.summary(m, p[1:])).max(axis=0)} for n, p in enumerate((lines[:k], lines[k:]))]
        borders = C._borders(edges)
        assert C.viterbi(m, lines[:k], *borders[0, 1]) + C.viterbi(m, lines[k:], *borders[1, 1]) == whole


@pytest.mark.parametrize("parts", ["1", "9"])
def test_rows_do_not_depend_on_partitions(spark, parts):
    rows = [(c, t, ("user", "assistant")[t % 2], ("ask?" if t % 2 == 0 else "a long reply " * 20) + f" {t}") for c, n in ((1, 4), (2, 400), (3, 6)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = C.turns_of(df).orderBy("conv_id", "turn").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == [(c, t, r, x) for c, t, r, x in rows]
    assert got[0].rendered == "<|user|>\nask? 0\n<|end|>"


def test_a_transcript_in_one_row(spark):
    df = spark.createDataFrame([(1, 0, "System: be kind\nUser: hello\nthere\nAssistant: hi", 5)], "conv_id long, turn long, text string, piece int")
    got = C.turns_of(df, role_col=None).orderBy("piece").collect()
    assert [(r.piece, r.role, r.text) for r in got] == [(0, "system", "be kind"), (1, "user", "hello\nthere"), (2, "assistant", "hi")]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, None, "strange", ""), (1, 1, "user", "same"), (1, 1, "user", "same"), (2, 0, None, "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.turns_of(df).collect()
    assert len(got) == len(rows) and {r.role for r in got} <= set(C.ROLES)
    assert sorted(r.text for r in got) == sorted(t or "" for *_, t in rows)
    assert C.turns_of(spark.createDataFrame([], df.schema)).collect() == []


def test_model_is_normalised():
    m = model()
    for x in (m.start, m.across, m.within, m.length, m.question, m.row):
        assert np.allclose(np.exp(x).sum(axis=-1), 1)


def test_named_roles_stay_and_text_is_left_as_it_is(spark):
    texts = ["Context: the reader should know", "Q: why?", "  spaced \n", "me: too", "User: quoted"]
    rows = [(7, t, ("assistant", "user")[t % 2], x) for t, x in enumerate(texts)] + [(8, t, "system", x) for t, x in enumerate(texts)]
    got = C.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got) == sorted(rows)


def test_names_that_ordinary_lines_begin_with(spark):
    rows = [(1, 0, "Context: the reader should know"), (2, 0, "Q: why?\nA: because\nof that"), (3, 0, "A: one\nB: two")]
    got = C.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, text string"), role_col=None).collect()
    assert sorted((r.conv_id, r.piece, r.text) for r in got) == [(1, 0, "Context: the reader should know"), (2, 0, "why?"), (2, 1, "because\nof that"), (3, 0, "A: one\nB: two")]
    assert [r.role for r in sorted(got, key=lambda r: (r.conv_id, r.piece)) if r.conv_id == 2] == ["user", "assistant"]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the tables")
def test_held_out_roles_of_the_table(spark):
    """Every fifth conversation's roles, and every fifth row's of the others, are hidden from model and decoder."""
    given = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    whole = F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0
    hidden = given.withColumn("role", F.when(~whole & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) != 0), F.col("role")))
    got = C.turns_of(hidden).where("piece = 0").select("conv_id", "turn", F.col("role").alias("found"))
    rows = given.join(got, ["conv_id", "turn"]).join(hidden.where("role is null").select("conv_id", "turn"), ["conv_id", "turn"]).select((F.col("role") == F.col("found")).cast("int").alias("ok"), whole.alias("whole")).groupBy("whole").agg(F.avg("ok").alias("share"), F.count("*").alias("n")).collect()
    share = {r.whole: r.share for r in rows}
    print(rows)
    assert share[False] >= 0.98 and share[True] >= 0.9
    named = given.join(C.turns_of(given).select("conv_id", "turn", "piece", F.col("role").alias("found"), F.col("text").alias("body")), ["conv_id", "turn"])
    assert named.count() == given.count() == named.where("piece = 0 and role = found and text = body").count()
