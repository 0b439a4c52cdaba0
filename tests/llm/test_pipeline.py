import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kymo.llm import bpe, rules
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_nearcopies import brute as brute_copies


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "nt", "rs", "st")]
    docs = []
    for i in range(240):
        t = [rng.choice(words) for _ in range(rng.randrange(40, 140))]
        lines = [" ".join(t[k : k + 12]) for k in range(0, len(t), 12)]
        if i % 5 == 0:
            lines.insert(1, "a line that very many documents share, word for word")
        if i % 12 == 1:
            lines = [x.replace(" ", "$$$ ") for x in lines]
        if i % 6 == 2 and i > 6:
            lines = docs[i - 6][1].split("\n")[:-1] + ["tail"] if i % 12 == 2 else docs[i - 6][1].split("\n")
        docs.append((i, "\n".join(lines), "en", "s", None))
    docs += [(900, None, None, None, None), (901, "", None, None, None), (None, docs[3][1], None, None, None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 12 != 1), 0) for i in range(0, 240) if i % 3 != 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_against_brute_force(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_copies", "mix", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows, out = now.collect(), stage(spark, now, sf_dir)
        assert out.columns == docs.columns
        got = out.collect()
        if name == "quality":
            found = rules.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            counts = np.array([rules.measure(r.text) for r in rows])
            bad = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            for r in found:
                bad |= rules._covers(r.conditions, rules.ratios(counts), len(rows))
            assert found and key(got) == key(r for r, b in zip(rows, bad) if not b)
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in rows])
            assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted((i, t) for i, _, _, t in want if t.strip() and i is not None)
            assert all(r.n_chars == len(r.text) for r in got)
        if name == "near_copies":
            least = {c for _, _, c in brute_copies([(r.doc_id, r.text) for r in rows])}
            assert {r.doc_id for r in got if r.doc_id is not None} == least - {None} and len(got) < len(rows)
        if name == "mix":
            assert {tuple(r) for r in got} <= {tuple(r) for r in rows} and got
        now = spark.createDataFrame(got, docs.schema)
    codec = bpe.Codec(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)
    want = [(r.doc_id, hashlib.sha256(codec.encode([r.text])[0]).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in now.collect()]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert key((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == key(want)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_stage_takes_four_fifths(spark):
    """Of two texts with a similarity of 0.818 one stays, of two with 0.786 both."""
    words = [f"w{i}" for i in range(104)]
    alike = [" ".join(words), " ".join([*words[:-10], *(f"x{i}" for i in range(10))])]  # 90 common shingles of 110: 0.818
    apart = [" ".join(f"a{i}" for i in range(104)), " ".join([*(f"a{i}" for i in range(92)), *(f"y{i}" for i in range(12))])]  # 88 of 112: 0.786
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(alike + apart)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2, 3]


def test_near_copies_without_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(4, text), (None, text + " end"), (None, other), (None, other), (None, None), (None, None), (6, None), (4, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(4, text), (None, other), (None, None), (6, None)], key=str)


def test_clashing_columns_and_long_texts(spark, odd_docs, tmp_path):
    """Every stage on nulls in every column, empty and very long texts, ties, repeated rows and columns that operators use themselves."""
    extra = [F.lit(1).alias(c) for c in ("near_id", "near_hash", "copies", "rate", "words", "bins", "counts.x", "domain", "n_tokens", "lang", "source", "n_chars")]
    docs = odd_docs.select("*", *extra)
    spark.createDataFrame([(5, 1, 0), (None, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == docs.count()
