import datetime as dt
import json
import logging
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

from jobs import event_intake, queries, text_inputs
from jobs.common import settings_of
from kymo.operators.transcripts import model_inputs
from kymo.schema import FAMILIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, extra string"
START = dt.datetime(2024, 1, 1)
KINDS = settings_of("event_intake")["families"]


def made(n, seed, first_id=0, days=3):
    rng = random.Random(seed)
    return [(first_id + i, START + dt.timedelta(seconds=rng.randrange(days * 86_400)), rng.randrange(5), rng.choice([*KINDS]), rng.randrange(10_000) / 100, "x") for i in range(n)]


def plain_frames(rows):
    """Frames of all rows at once, by dictionaries."""
    once = {}
    for i, ts, user, kind, value, _ in rows:
        if None in (i, ts, user, value) or kind not in KINDS or not math.isfinite(value):
            continue
        key, e = (ts.date(), i), (str(user), ts, KINDS[kind], value)
        once[key] = min(once.get(key, e), e)
    out = {}
    for (day, _), (user, ts, family, value) in once.items():
        cell = out.setdefault((user, (ts.hour * 3600 + ts.minute * 60 + ts.second) // 3600, day), [Counter(), Decimal(0)])
        cell[0][family] += 1
        cell[1] += Decimal(str(value))
    return sorted((u, f, sum(c.values()), *(c[x] for x in FAMILIES), t, d) for (u, f, d), (c, t) in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_intake_of_growing_input(spark, tmp_path, caplog):
    source, output, settings = f"{tmp_path}/in", f"{tmp_path}/out", settings_of("event_intake")
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    intakes = lambda: {(r.status, r.intake): r.n for r in spark.read.parquet(f"{output}/events").groupBy("status", "intake").agg({"*": "count"}).toDF("status", "intake", "n").collect()}
    old = made(300, 1)
    odd = [(None, START, 1, "click", 1.0, ""), (900, None, 1, "click", 1.0, ""), (901, START, None, "click", 1.0, ""), (902, START, 1, "swim", 1.0, ""), (903, START, 1, None, 1.0, ""), (904, START, 1, "view", None, ""), (905, START, 1, "view", float("nan"), ""), (906, START, 1, "view", math.inf, "")]
    add(old + odd)
    with caplog.at_level(logging.INFO, "jobs.event_intake"):
        assert rows_of(event_intake.run(spark, source, output, settings)) == plain_frames(old + odd)
    assert "308 rows read" in caplog.text and "300 of them ok" in caplog.text
    before = intakes()
    assert before == {("ok", 0): 300, ("no_event_id", 0): 1, ("no_time", 0): 1, ("no_recording", 0): 1, ("unknown_kind", 0): 2, ("unusable_value", 0): 3}

    # late events of the same days, rows that come again, one of them with another value, and a day of their own
    new = [*made(100, 2, 300), *old[:40], (*old[50][:4], old[50][4] + 1, "x"), (*old[51][:4], old[51][4] - 1, "x"), (999, START + dt.timedelta(days=9), 1, "click", 0.1, "x")]
    add(new)
    kept = {f.name: f.stat().st_mtime_ns for f in Path(f"{output}/frames").rglob("*.parquet")}
    assert rows_of(event_intake.run(spark, source, output, settings)) == plain_frames(old + odd + new)
    after = intakes()
    assert {k: n for k, n in after.items() if k[1] == 0} == before and after["ok", 1] == len(new)

    # a day that nothing new touches stays as it was written
    add([(1_000, START + dt.timedelta(days=9, hours=1), 1, "click", 0.2, "x")])
    kept = {str(f): f.stat().st_mtime_ns for f in Path(f"{output}/frames").rglob("*.parquet") if "2024-01-10" not in str(f)}
    frames = rows_of(event_intake.run(spark, source, output, settings))
    assert kept == {str(f): f.stat().st_mtime_ns for f in Path(f"{output}/frames").rglob("*.parquet") if "2024-01-10" not in str(f)}

    # nothing new; then a batch that was written but not recorded as done
    files = sorted(map(str, Path(output).rglob("*.parquet")))
    assert rows_of(event_intake.run(spark, source, output, settings)) == frames and sorted(map(str, Path(output).rglob("*.parquet"))) == files
    for name in ("2", ".2.crc"):
        os.remove(f"{output}/checkpoint/commits/{name}")
    assert rows_of(event_intake.run(spark, source, output, settings)) == frames and intakes()["ok", 2] == 1
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_intake_in_small_batches_is_the_same(spark, tmp_path):
    rows = made(400, 5)
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/in")
    done = event_intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", settings_of("event_intake") | {"files_per_batch": 2, "splits_per_day": 3})
    assert rows_of(done) == plain_frames(rows) and len(list(Path(f"{tmp_path}/out/checkpoint/commits").glob("[0-9]*"))) == 4


def test_intake_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert event_intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", settings_of("event_intake")).collect() == []
    with pytest.raises(ValueError):
        event_intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", settings_of("event_intake") | {"frame_seconds": 7})
    with pytest.raises(ValueError):
        event_intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", settings_of("event_intake") | {"families": {"click": "smell"}})


def plain_inputs(text, core, context):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
    sentences, current = [], []
    for w in words:
        current.append(w)
        if w[-1] in ".!?。！？；;":
            sentences.append(current)
            current = []
    sentences += [current] * bool(current)
    out = []
    for words in sentences:
        for chunk, s in enumerate(range(0, len(words), core)):
            e = min(len(words), s + core)
            a, b = max(0, s - context), min(len(words), e + context)
            out.append((chunk, s, e, a, b, " ".join(words[a:b]), "WARN" if len(words) > core else "PASS"))
    return out


TEXTS = ["One two. Three!  four\tfive?\nsix", "a" * 5, None, "", " \n\t ", "w " * 130, "。 ！ x", "Ends; here;\x0bNo\x0cEnd", "é ü. ñ", "." * 4, " lead. trail. ", "x.y z.\n\n\n! ?"]


def test_inputs_equal_a_plain_reading(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(("a", "b.", "c", "dd!", "e")) + rng.choice(("", "", "\n")) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for core, context in ((4, 2), (1, 0), (48, 12)):
        got = {}
        for r in model_inputs(df, core, context).orderBy("id", "sentence", "chunk").collect():
            got.setdefault(r.id, []).append((r.chunk, r.core_start, r.core_end, r.context_start, r.context_end, r.text, r.status))
        assert got == {i: plain_inputs(t, core, context) for i, t in enumerate(texts) if plain_inputs(t, core, context)}
    with pytest.raises(ValueError):
        model_inputs(df, 0, 1)


def test_text_inputs_rerun_and_report(spark, tmp_path):
    rows = [(i, t, ("de", "en", None)[i % 3], "clash") for i, t in enumerate(TEXTS)] + [(3, "x. y", "fr", ""), (3, "x. y", "fr", ""), (None, " ", "it", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, chunk string").write.parquet(f"{tmp_path}/docs")
    settings = settings_of("text_inputs") | {"core_words": 5}
    reports = [sorted(map(tuple, text_inputs.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", settings).collect()), key=str) for _ in range(2)]
    assert reports[0] == reports[1]
    want = {}
    for i, t, lang, _ in rows:
        r = want.setdefault(lang, [0, 0, 0, 0, 0, 0, "FAIL"])
        cut = plain_inputs(t, 5, settings["context_words"])
        r[0] += 1
        r[1] += not cut
        r[2] += sum(c[0] == 0 for c in cut)
        r[3] += len(cut)
        r[4] += sum(c[2] - c[1] for c in cut)
        r[5] = max([r[5], *(c[2] for c in cut)])
        if cut and r[6] != "WARN":
            r[6] = "WARN" if any(c[6] == "WARN" for c in cut) else "PASS" if r[6] == "FAIL" else r[6]
    assert reports[0] == sorted(((k, *v) for k, v in want.items()), key=str)
    assert text_inputs.inputs(spark, f"{tmp_path}/out").count() == sum(v[3] for v in want.values())
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none")
    assert text_inputs.run(spark, f"{tmp_path}/none", f"{tmp_path}/out", settings).collect() == []


def test_queries_leave_their_files(spark):
    for name, query in queries.QUERIES.items():
        a, b = query(spark, DATA), query(spark, DATA)
        assert a.count() == b.count() > 0 and set(a.inputFiles()).isdisjoint(b.inputFiles()), name


def test_command_line(tmp_path):
    with open(f"{tmp_path}/settings.json", "w") as f:
        json.dump({"core_words": 3}, f)
    done = subprocess.run([sys.executable, "-m", "jobs.text_inputs", "--input", f"{DATA}/documents.parquet", "--output", f"{tmp_path}/out", "--settings", f"{tmp_path}/settings.json"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "texts read from" in done.stderr and list(Path(f"{tmp_path}/out/report").glob("*.parquet"))
