"""Canonical JSON, hashes and nested walks, for small driver-side documents and as row generators for tables of JSON text."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, no escapes beyond need."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=_plain)


def _plain(value: Any) -> Any:
    if hasattr(value, "item"):
        return value.item()
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, (set, frozenset, tuple)):
        return sorted(value) if isinstance(value, (set, frozenset)) else list(value)
    return str(value)


def json_sha256(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def schema_sha256(names: list[str], families: list[str]) -> str:
    """Identity of an ordered feature schema."""
    return json_sha256({"families": list(families), "names": list(names)})


def walked(value: Any, path: str = "") -> Iterator[tuple[str, str, Any]]:
    """(path, key, value) of every mapping entry anywhere inside value, outer ones first."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield f"{path}.{k}" if path else str(k), str(k), v
        for k, v in value.items():
            yield from walked(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for n, v in enumerate(value):
            yield from walked(v, f"{path}[{n}]")


def saved_values(value: Any, *keys: str) -> list[Any]:
    """Distinct values of the first of keys that occurs anywhere; conflicting ones are all kept."""
    for key in keys:
        found = [v for _, k, v in walked(value) if k == key]
        if found:
            return [json.loads(x) for x in dict.fromkeys(canonical_json(v) for v in found)]
    return []


def flattened(config: Any, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, text) of a configuration's leaves; lists stay whole as JSON."""
    if isinstance(config, dict):
        for k, v in config.items():
            yield from flattened(v, f"{path}.{k}" if path else str(k))
    elif isinstance(config, (list, tuple)):
        yield path, canonical_json(list(config))
    else:
        yield path, canonical_json(config) if config is None or isinstance(config, (bool, float)) and (isinstance(config, bool) or math.isfinite(config)) else str(config)


def json_entries(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Every mapping entry of every row's JSON text: (id, path, key, value_json); unreadable text gives none."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"id": [], "path": [], "key": [], "value_json": []}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    continue
                for path, key, v in walked(value):
                    for c, x in zip(out, (i, path, key, canonical_json(v)), strict=True):
                        out[c].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.string()) for c in out]))

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).cast("string").alias("json")).mapInArrow(run, "id string, path string, key string, value_json string")


def status_findings(entries: DataFrame, statuses: tuple[str, ...] = ("WARN", "FAIL")) -> DataFrame:
    """Entries of json_entries() that hold a status worth reporting, wherever they stand."""
    return entries.where(F.col("key").isin("status", "severity")).withColumn("status", F.btrim("value_json", F.lit('"'))).where(F.col("status").isin(*statuses)).select("id", "path", "status")
