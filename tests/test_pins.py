import copy
import json

import pytest

from kymo.plans import cli, pins
from kymo.plans.scope import ALL
from kymo.schema import FAMILIES

GOOD = {
    "models": [{"directory": m, "identity": f"id/{m}"} for m in ALL],
    "variants": copy.deepcopy(pins.VARIANTS),
    "families": list(FAMILIES),
    "expected_recording_count": 12,
    "governance_inputs": {"revision_roadmap": "a", "claim_surface_manifest": "b"},
    "nulls": {"production_count": 100, "dry_run_count": 20},
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    *way, last = path
    for k in way:
        at = at[k]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return out


def test_pinned_settings_have_no_problem():
    assert list(pins.settings_problems(GOOD)) == [] and list(pins.settings_problems(GOOD, identities={m: f"id/{m}" for m in ALL})) == []
    assert list(pins.settings_problems(changed(("variants", "rich", "sensitivity_folds"), KeyError))) == []  # absent is none


@pytest.mark.parametrize(("path", "value", "where"), [
    (("models",), [{"directory": m} for m in ALL[:-1]], "models"),
    (("models",), [{"directory": m} for m in reversed(ALL)], "models"),
    (("models",), [{"directory": m} for m in (*ALL, "bert_base")], "models"),
    (("families",), list(FAMILIES[:-1]), "families"),
    (("variants", "original", "lags_seconds"), [0.0], "variants.original.lags_seconds"),
    (("variants", "original", "sensitivity_folds"), KeyError, "variants.original.sensitivity_folds"),
    (("variants", "rich", "feature_set"), "original", "variants.rich.feature_set"),
    (("variants", "capacity", "capacity_mode"), 1, "variants.capacity.capacity_mode"),
    (("variants", "zero_lag", "output_subdir"), "elsewhere", "variants.zero_lag.output_subdir"),
    (("expected_recording_count",), 2, "expected_recording_count"),
    (("expected_recording_count",), KeyError, "expected_recording_count"),
    (("governance_inputs", "revision_roadmap"), KeyError, "governance_inputs"),
    (("nulls", "production_count"), 99, "nulls.production_count"),
    (("nulls", "production_count"), 100.5, "nulls.production_count"),
    (("nulls", "dry_run_count"), 19, "nulls.dry_run_count"),
    (("nulls", "dry_run_count"), True, "nulls.dry_run_count"),
])
def test_each_departure_is_told(path, value, where):
    assert [p[0] for p in pins.settings_problems(changed(path, value))] == [where]


def test_missing_parts_and_identities(tmp_path, capsys):
    assert [p[0] for p in pins.settings_problems([1])] == [""]
    assert {p[0] for p in pins.settings_problems({})} >= {"models", "variants", "families", "nulls.production_count", "expected_recording_count"}
    order = dict(reversed(GOOD["variants"].items()))
    assert [p[0] for p in pins.settings_problems(GOOD | {"variants": order})] == ["variants"]
    assert [p[:2] for p in pins.settings_problems(GOOD, identities={ALL[0]: "other"})] == [(f"models.{ALL[0]}.identity", "other")]
    for name, settings, code in (("good", GOOD, 0), ("bad", changed(("nulls", "production_count"), 1), 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps(settings))
        assert cli.main(["check-settings", "--settings", str(tmp_path / f"{name}.json")]) == code
    assert "nulls.production_count" in capsys.readouterr().out
