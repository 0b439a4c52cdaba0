"""What a revision's settings must say exactly, as a table of rules, and what of given settings breaks them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from kymo.operators.lags import DRY_NULLS, PRODUCTION_NULLS
from kymo.plans.scope import ALL
from kymo.schema import FAMILIES

# For each variant its features, lags, capacity control, grouped folds and output folder.
LONG = [-0.2, -0.1, 0.0, 0.1, 0.2]
VARIANTS = {
    "original": {"feature_set": "original", "lags_seconds": LONG, "capacity_mode": False, "sensitivity_folds": 5, "output_subdir": "fits_original_recording_level"},
    "rich": {"feature_set": "rich", "lags_seconds": LONG, "capacity_mode": False, "sensitivity_folds": None, "output_subdir": "fits_rich_acoustic"},
    "capacity": {"feature_set": "original", "lags_seconds": LONG, "capacity_mode": True, "sensitivity_folds": None, "output_subdir": "fits_capacity_matched"},
    "zero_lag": {"feature_set": "original", "lags_seconds": [0.0], "capacity_mode": False, "sensitivity_folds": None, "output_subdir": "zero_lag"},
}
#: Fewest recordings, and the documents that have to be named.
LEAST_RECORDINGS, GOVERNANCE = 3, frozenset({"revision_roadmap", "claim_surface_manifest"})
_ABSENT = {"capacity_mode": False, "sensitivity_folds": None, "lags_seconds": []}


def _whole(value: Any) -> float:
    return value if isinstance(value, int) and not isinstance(value, bool) else math.nan


def settings_problems(settings: Any, models: tuple[str, ...] = ALL, identities: dict[str, str] | None = None) -> Iterator[tuple[str, Any, Any]]:
    """(where, wanted, found) of every rule that the settings break; none if they are the pinned ones.

    models: the directories in their order; identities: what each model has to be, if that is pinned as well.
    """
    if not isinstance(settings, dict):
        yield "", "a mapping", type(settings).__name__
        return
    entries = settings.get("models") or []
    exact = {
        "models": (list(models), [m.get("directory") for m in entries]),
        "variants": (list(VARIANTS), list(settings.get("variants") or {})),
        "families": (list(FAMILIES), list(settings.get("families") or [])),
        "governance_inputs": (sorted(GOVERNANCE), sorted(settings.get("governance_inputs") or {})),
        "nulls.production_count": (PRODUCTION_NULLS, (settings.get("nulls") or {}).get("production_count")),
    }
    if identities is not None:
        exact |= {f"models.{m}.identity": (i, next((e.get("identity") for e in entries if e.get("directory") == m), None)) for m, i in identities.items()}
    for name, wanted in VARIANTS.items():
        given = (settings.get("variants") or {}).get(name) or {}
        exact |= {f"variants.{name}.{k}": (v, given.get(k, _ABSENT.get(k))) for k, v in wanted.items()}
    least = {"expected_recording_count": (LEAST_RECORDINGS, settings.get("expected_recording_count")), "nulls.dry_run_count": (DRY_NULLS, (settings.get("nulls") or {}).get("dry_run_count"))}
    for where, (wanted, found) in exact.items():
        if wanted != found or isinstance(wanted, bool) != isinstance(found, bool):
            yield where, wanted, found
    for where, (wanted, found) in least.items():
        if not _whole(found) >= wanted:
            yield where, f"at least {wanted}", found
