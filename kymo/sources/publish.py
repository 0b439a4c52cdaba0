"""Publishing: staged writes with hashed manifests, resumable units, delivery checks.

A result becomes visible by one rename of a folder that has been written, hashed and checked. On
object stores, whose rename is not atomic, the manifest that is written last plays that part: readers take
a unit only if its manifest is there and its hashes hold.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.functions.canonical import canonical_json, json_sha256

SCHEMA_VERSION = 1
STATUS, MANIFEST = "status.json", "SHA256SUMS"


def write_json(path: str, value: Any) -> None:
    """Atomic: a temporary file beside it, flushed, then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(canonical_json(value)), indent=2, sort_keys=True, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, for formats without nesting."""
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes])


#: Columns by which published tables are sorted, as far as a table has them.
ORDER = ("task_id", "table", "component", "variant", "model", "layer_idx", "layer", "depth", "split_kind", "outer_fold", "null_index", "recording_id", "family", "feature_family", "feature_idx", "frame", "path", "line", "field", "name")


def write_table(df: DataFrame, path: str, form: str = "csv", sep: str = ",") -> None:
    """A published table as a folder of CSV (or TSV) or Parquet files in the order of its key columns, staged and renamed; an existing one is refused."""
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    if keys := [c for c in ORDER if c in df.columns]:
        df = df.orderBy(*keys)
    if form == "csv":
        flat_cells(df).write.csv(staged, header=True, sep=sep)
    else:
        df.write.parquet(staged)
    if os.path.exists(path):
        shutil.rmtree(staged)
        raise FileExistsError(path)
    os.rename(staged, path)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of every file under root, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    return files.select(relative.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def write_sums(spark: SparkSession, root: str) -> None:
    rows = tree_hashes(spark, root).where(~F.col("path").isin(MANIFEST)).orderBy("path").collect()  # as many rows as files
    with open(os.path.join(root, MANIFEST), "w", encoding="utf-8") as f:
        f.writelines(f"{r.sha256}  {r.path}\n" for r in rows)


def verify_delivery(spark: SparkSession, root: str, denied: tuple[str, ...] = ()) -> DataFrame:
    """(path, problem): files missing, unlisted, altered or of a denied kind; empty if all is well."""
    listed = spark.read.text(os.path.join(root, MANIFEST)).select(F.substring("value", 1, 64).alias("listed"), F.expr("substring(value, 67)").alias("path"))
    found = tree_hashes(spark, root).where(F.col("path") != MANIFEST)
    both = listed.join(found, "path", "full_outer")
    kinds = F.lit(False)
    for end in denied:
        kinds = kinds | F.col("path").endswith(end)
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("sha256") != F.col("listed"), "altered").when(kinds, "denied")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def smallest_archive(files: DataFrame) -> DataFrame:
    """The smallest valid file of (path, length, valid), the first by path on ties."""
    return files.where("valid").agg(F.min_by("path", F.struct("length", "path")).alias("path"), F.min("length").alias("length"))


def unit_path(root: str, **identity: Any) -> str:
    """A unit's folder: variant=…/model=…/layer=…, names percent-encoded."""
    from urllib.parse import quote

    return os.path.join(root, *[f"{k}={quote(str(v), safe='')}" for k, v in identity.items() if v is not None])


def publish_unit(destination: str, tables: dict[str, DataFrame], identity: dict, sources: dict[str, str], config: Any, reports: dict[str, Any] | None = None) -> str:
    """Writes a unit's tables, reports and status in a staging folder, checks it, and renames it to its place."""
    staged = f"{destination}.staging-{uuid.uuid4().hex}"
    os.makedirs(staged)
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    for name, value in (reports or {}).items():
        write_json(f"{staged}/{name}.json", value)
    seal_unit(staged, identity, sources, config)
    os.rename(staged, destination)
    return destination


def publish_units(root: str, identity: dict, unit: list[str], units: list[tuple], tables: dict[str, DataFrame], sources: dict[str, str], config: Any) -> None:
    """Publishes many units of one computation: its tables are written once, dealt by unit, and each unit's folders then become a unit."""
    staged = os.path.join(root, f".staging-{uuid.uuid4().hex}")
    try:
        for name, df in tables.items():
            df.write.partitionBy(*unit).parquet(f"{staged}/{name}")
        dealt = {name: _dealt_folders(os.path.join(staged, name), len(unit)) for name in tables}
        for u in units:
            own = dict(zip(unit, u, strict=True))
            destination, aside = unit_path(root, **identity, **own), os.path.join(staged, f"unit-{uuid.uuid4().hex}")
            os.makedirs(aside)
            for name in tables:
                if tuple(u) not in dealt[name]:
                    raise RuntimeError(f"the unit {own} has no {name}")
                os.rename(dealt[name][tuple(u)], os.path.join(aside, name))
            seal_unit(aside, {**identity, **own}, sources, config)
            os.makedirs(os.path.dirname(destination), exist_ok=True)
            os.rename(aside, destination)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def _dealt_folders(folder: str, depth: int) -> dict[tuple, str]:
    """Values -> folder of a table dealt by so many columns, as the writer escapes them."""
    from urllib.parse import unquote

    found = {(): folder}
    for _ in range(depth):
        found = {(*k, unquote(d.partition("=")[2])): os.path.join(at, d) for k, at in found.items() for d in os.listdir(at) if "=" in d}
    return found


def seal_unit(folder: str, identity: dict, sources: dict[str, str], config: Any) -> None:
    """Writes the status with the digests of everything in a unit's folder, and checks it."""
    hashes = {os.path.relpath(p, folder): file_sha256(p) for d, _, names in os.walk(folder) for n in names if not n.startswith(".") for p in [os.path.join(d, n)]}
    write_json(f"{folder}/{STATUS}", {"schema_version": SCHEMA_VERSION, "state": "complete", "identity": identity, "config_sha256": json_sha256(config), "source_sha256": sources, "artifact_sha256": hashes, "provenance": provenance()})
    reason = unit_problem(folder, identity, sources, config)
    if reason != "ok":
        raise RuntimeError(f"the staged unit is not valid: {reason}")


def unit_problem(path: str, identity: dict, sources: dict[str, str], config: Any) -> str:
    """The first thing that is wrong with a unit, 'ok' if nothing, 'missing' if it isn't there."""
    if not os.path.isdir(path):
        return "missing"
    try:
        with open(os.path.join(path, STATUS), encoding="utf-8") as f:
            status = json.load(f)
    except (OSError, ValueError):
        return "unreadable_status"
    for key, want, code in (("schema_version", SCHEMA_VERSION, "schema_version_mismatch"), ("state", "complete", "incomplete"), ("identity", json.loads(canonical_json(identity)), "identity_mismatch"), ("config_sha256", json_sha256(config), "config_hash_mismatch"), ("source_sha256", sources, "source_hash_mismatch")):
        if status.get(key) != want:
            return code
    for name, digest in status.get("artifact_sha256", {}).items():
        at = os.path.join(path, name)
        if not os.path.isfile(at):
            return "missing_artifact"
        if file_sha256(at) != digest:
            return "artifact_hash_mismatch"
    return "ok"


def preserve(path: str, reason: str) -> str:
    """Sets a bad unit aside, with its diagnosis, instead of overwriting it."""
    aside = f"{path}.corrupt-{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')}"
    os.rename(path, aside)
    write_json(os.path.join(aside, "diagnosis.json"), {"reason": reason})
    return aside


def run_unit(destination: str, identity: dict, sources: dict[str, str], config: Any, make: Callable[[], tuple[dict[str, DataFrame], dict[str, Any]]]) -> str:
    """'resumed' if a valid unit is there, else makes and publishes it; an invalid one is preserved first."""
    reason = unit_problem(destination, identity, sources, config)
    if reason == "ok":
        return "resumed"
    if reason != "missing":
        preserve(destination, reason)
    tables, reports = make()
    publish_unit(destination, tables, identity, sources, config, reports)
    return "computed" if reason == "missing" else "repaired"


def save_activations(rows: DataFrame, root: str, signature: str, overwrite: bool = False) -> str:
    """Activations of one extraction, staged and renamed: skipped if the same signature is complete, refused if another is."""
    status = os.path.join(root, STATUS)
    if os.path.exists(status):
        with open(status, encoding="utf-8") as f:
            if json.load(f).get("signature") == signature:
                return "skipped"
        if not overwrite:
            raise ValueError(f"{root} holds another extraction")
    staged = f"{root}.incomplete-{uuid.uuid4().hex}"
    rows.write.partitionBy("model", "layer", "grid").parquet(staged)
    write_json(os.path.join(staged, STATUS), {"signature": signature, "state": "complete"})
    if os.path.exists(root):
        os.rename(root, f"{root}.replaced-{uuid.uuid4().hex}")
    os.rename(staged, root)
    return "written"


def provenance(inputs: dict[str, str] | None = None, seed: int | None = None) -> dict[str, Any]:
    """When, by which code and with which packages something was made."""
    from importlib.metadata import PackageNotFoundError, version

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    packages = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            packages[name] = version(name)
        except PackageNotFoundError:
            packages[name] = None
    return {"created_utc": datetime.now(UTC).isoformat(), "git_commit": git("rev-parse", "HEAD"), "git_dirty": bool(git("status", "--porcelain")), "python": sys.version.split()[0], "packages": packages, "input_sha256": inputs or {}, "seed": seed}
