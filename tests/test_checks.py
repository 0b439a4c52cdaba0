import pytest
from pyspark.sql import functions as F

from kymo.functions import canonical
from kymo.functions.scalars import guarded_ratio, percent_encoded, stripped
from kymo.operators import checks, relate, summary
from kymo.schema import INTERVALS
from kymo.sources.textgrid import parse_intervals

TEXT = """File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = {xmax}
tiers? <exists>
size = 3
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        xmin = 0
        xmax = {xmax}
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 1
            text = "你""好"
        intervals [2]:
            xmin = 1
            xmax = {xmax}
            text = ""
    item [2]:
        class = "TextTier"
        name = "points"
        points: size = 1
        points [1]:
            number = 0.5
            mark = "x"
    item [3]:
        class = "IntervalTier"
        name = "phones"
        intervals: size = 1
        intervals [1]:
            xmin = 0.25
            xmax = 1e0
            text = "ma1"
"""


def spans(spark, rows):
    return spark.createDataFrame([("r", i, t, float(s), float(e), x) for i, (t, s, e, x) in enumerate(rows)], INTERVALS)


def length(spark, d):
    return spark.createDataFrame([("r", float(d))], "recording_id string, duration_seconds double")


def test_textgrid(spark):
    rows = parse_intervals(spark.createDataFrame([("r", "﻿" + TEXT.format(xmax=2))], "recording_id string, text string")).orderBy("interval_idx").collect()
    assert [(r.tier, r.start, r.end, r.label) for r in rows] == [("words", 0, 1, '你"好'), ("words", 1, 2, ""), ("phones", 0.25, 1, "ma1")]
    with pytest.raises(Exception, match="no intervals"):
        parse_intervals(spark.createDataFrame([("r", "nothing")], "recording_id string, text string")).collect()


@pytest.mark.parametrize(
    ("row", "duration", "tolerance", "found"),
    [
        (("w", 0, 2, "a"), 2.0, 0.0, []), (("w", 0, 2, "a"), 1.5, 0.0, [("outside_audio_duration", "error")]), (("w", 9, 10.026, ""), 10, 0.03, [("empty_trailing_interval_overhang", "warning")]),
        (("w", 9, 10.026, "spoken"), 10, 0.03, [("outside_audio_duration", "error")]), (("w", 9, 10.031, " "), 10, 0.03, [("outside_audio_duration", "error")]), (("w", 2, 1, "a"), 10, 0, [("invalid_interval", "error")]),
    ],
)
def test_interval_findings(spark, row, duration, tolerance, found):
    assert [(r.code, r.severity) for r in checks.validate_intervals(spans(spark, [row]), length(spark, duration), tolerance).collect()] == found


def test_order_is_the_files(spark):
    rows = checks.validate_intervals(spans(spark, [("a", 0, 1, "x"), ("b", 5, 6, "x"), ("a", 2, 3, "x"), ("a", 1, 2, "x")]), length(spark, 9)).collect()
    assert [(r.interval_idx, r.code) for r in rows] == [(3, "non_monotonic")]


@pytest.mark.parametrize(("xmax", "status", "out", "fatal"), [(1.0, "PASS", 0, 0), (1.0000005, "WARN", 2, 0), (1.000002, "FAIL", 2, 2)])
def test_annotation_quality(spark, xmax, status, out, fatal):
    iv = spans(spark, [("phones", 0, 0.5, "ma1"), ("phones", 0.5, xmax, "ma2"), ("words", 0, xmax, "妈妈")])
    r = checks.annotation_qc(iv, length(spark, 1.0)).first()
    assert (r.status, r.out_of_bounds_count, r.fatal_out_of_bounds_count, r.word_count, r.phone_count) == (status, out, fatal, 1, 2)
    t = checks.annotation_totals(checks.annotation_qc(iv, length(spark, 1.0)), iv).first()
    assert (t.status, t.phone_categories, t.words) == (status, 2, 1)


def test_manifest(spark):
    files = lambda *n: spark.createDataFrame([(s, f"/d/{s}.{k}", f"{s}.{k}") for k, s in enumerate(n)], "stem string, path string, filename string")
    m = relate.matched_files(files("a", "b", "b"), files("a", "c"))
    got = {r.recording_id: (r.audio_path, r.audio_matches, r.alignment_matches) for r in m.collect()}
    assert got == {"a": ("/d/a.0", 1, 1), "b": (None, 2, 0), "c": (None, 0, 1)}
    audio = spark.createDataFrame([("a",)], "recording_id string")
    none = spark.createDataFrame([], "recording_id string, code string, severity string")
    codes = sorted((r.recording_id, r.code) for r in checks.validate_manifest(m, audio, none).collect())
    assert codes == [("b", "alignment_match_count"), ("b", "audio_match_count"), ("c", "audio_match_count")]
    assert checks.manifest_report(none).first().valid
    ids = spark.createDataFrame([("a",), ("z",)], "recording_id string")
    assert {r.recording_id: r.audio_matches for r in relate.matched_files(files("a"), files("a"), ids).collect()} == {"a": 1, "z": 0}


def test_archives(spark):
    nan = float("nan")
    rows = [("good", 0, 0.0, [1.0]), ("good", 1, 0.1, [1.0]), ("back", 0, 0.0, [1.0]), ("back", 1, 0.0, [1.0]), ("nan", 0, 0.0, [nan]), ("wide", 0, 0.0, [1.0, 2.0]), ("late", 0, 0.5, [1.0])]
    f = spark.createDataFrame(rows, "recording_id string, frame int, t double, x array<double>")
    expected = spark.createDataFrame([(r,) for r in ("good", "back", "nan", "wide", "late", "gone")], "recording_id string")
    got = {r.recording_id: r.reason for r in checks.archive_audit(f, 1, expected).collect()}
    assert got == {"good": "ok", "back": "times_not_increasing", "nan": "nonfinite_values", "wide": "schema_width_mismatch", "late": "grid_does_not_start_at_zero", "gone": "missing_archive"}


def test_median_step_of_short_recordings(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 1.0), ("b", 3.0)], "recording_id string, t double")
    assert {r.recording_id: (r.step, r.duration_seconds) for r in checks.median_step(df).collect()} == {"a": (0.0, 0.0), "b": (1.5, 4.5)}


def test_regression_and_nan(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, 1.0), (2, nan), (3, None), (4, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.00005), (2, nan), (3, None), (5, 1.0)], "k int, v double")
    got = {r.k: (r.side, r.close) for r in relate.regression(a, b, ["k"], ["v"]).collect()}
    assert got == {1: ("both", True), 2: ("both", True), 3: ("both", True), 4: ("reference", False), 5: ("candidate", False)}


def test_one_to_one_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, a int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, b int")
    assert relate.one_to_one(a, b.limit(1), ["k"]).count() == 1
    with pytest.raises(Exception, match="repeated key"):
        relate.one_to_one(a, b, ["k"]).collect()


def test_scalars(spark):
    df = spark.createDataFrame([(0.15, 0.4, "　 a b\t\x1c", "a b/ü~*")], "d double, f double, s string, p string")
    r = df.select(guarded_ratio(F.col("d"), F.col("f")).alias("a"), guarded_ratio(F.col("d"), F.lit(0.0)).alias("b"), stripped("s").alias("s"), percent_encoded("p").alias("p")).first()
    assert r.a == pytest.approx(0.375) and r.b != r.b and r.s == "a b" and r.p == "a%20b%2F%C3%BC~%2A"


def test_json_walks(spark):
    doc = {"a": {"status": "WARN", "k": [1, {"k": 2}]}, "k": 1}
    assert canonical.saved_values(doc, "absent", "k") == [1, [1, {"k": 2}], 2]
    assert dict(canonical.flattened({"a": {"b": [1, 2], "c": None}, "d": "x"})) == {"a.b": "[1,2]", "a.c": "null", "d": "x"}
    df = spark.createDataFrame([("x", canonical.canonical_json(doc)), ("y", "not json"), ("z", None)], "id string, j string")
    found = canonical.json_entries(df, "id", "j")
    assert sorted(r.path for r in found.collect()) == ["a", "a.k", "a.k[1].k", "a.status", "k"]
    assert [(r.path, r.status) for r in canonical.status_findings(found).collect()] == [("a.status", "WARN")]


def test_depth_layers_and_summary(spark):
    rows = [("m", f"layer_{i:02d}" if i else "layer_00_input", i) for i in range(13)] + [("n", x, i) for i, x in enumerate(("input", "encoder_1", "encoder_2", "encoder_3"))]
    got = {r.model: (r.input, r.middle, r.final) for r in summary.depth_layers(spark.createDataFrame(rows, "model string, layer string, layer_idx int")).collect()}
    assert got == {"m": ("layer_00_input", "layer_06", "layer_12"), "n": ("input", "encoder_1", "encoder_3")}
    assert summary.storage_bytes(length(spark, 10), 50, 3, 4, 2).first().bytes == 12_000


def test_ranks_by_ranges(spark, monkeypatch):
    import random

    from kymo.operators import relate

    rng = random.Random(1)
    rows = [(f"g{rng.randrange(3)}" if rng.random() < 0.95 else None, i) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, v long")
    for sample, cuts in ((4_096, 64), (10, 3), (1, 1)):
        monkeypatch.setattr(relate, "CUT_SAMPLE", sample)
        monkeypatch.setattr(relate, "CUTS", cuts)
        order = sorted(v for _, v in rows)
        assert {r.v: r["rank"] for r in relate.ranked(df, "v").collect()} == {v: n for n, v in enumerate(order)}
        got = {(r.g, r.v): r["rank"] for r in relate.ranked(df, "v", ("g",), descending=True).collect()}
        assert got == {(g, v): sum(h == g and w > v for h, w in rows) for g, v in rows}
    assert relate.ranked(df.limit(0), "v").collect() == []


def test_manifest_digest_is_that_of_its_text(spark):
    import hashlib

    from kymo.operators import summary

    rows = [(i, None if i % 7 == 0 else f"ü{i}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "i int, s string").repartition(5)
    want = hashlib.sha256("\n".join(sorted((f"{i},{s or ''}" for i, s in rows), key=str.encode)).encode()).hexdigest()
    assert summary.manifest_sha256(df, ["i", "s"]).first().sha256 == want
    assert summary.manifest_sha256(df.limit(0), ["i"]).first().sha256 == hashlib.sha256(b"").hexdigest()


def test_large_manifest_is_sorted_in_ranges(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(summary, "ROWS_A_PACKAGE", 100)
    df = spark.range(2_500).selectExpr("id * 7919 % 2500 as i", "'a\\nb' as s")
    done = summary.manifest_sha256(df, ["i", "s"])
    assert done.first().sha256 == hashlib.sha256("\n".join(sorted(f"{i},a\nb" for i in range(2_500))).encode()).hexdigest()
    assert "rangepartitioning(row" in done._jdf.queryExecution().toString()
