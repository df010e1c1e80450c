import json
import random

import pytest

from cleanloom.plans import history, lookup
from cleanloom.sources import recipe_log

SCHEMA = "dataset_id string, position bigint, event string, ops string"


def replay(events):
    """Plain twin: a recipe and a stack of at most eight earlier recipes."""
    recipe, stack = [], []
    for position, event in events:
        if event == "undo":
            recipe = stack.pop() if stack else recipe
        else:
            stack = (stack + [recipe])[-history.UNDO_LEVELS:]
            recipe = recipe + [position] if event == "apply" else []
    return recipe


def run(spark, log):
    rows = [(d, p, e, json.dumps([{"type": "trim", "column": f"c{p}"}]) if e == "apply" else None) for d, p, e in log]
    random.Random(1).shuffle(rows)
    out = history.effective_recipe(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("dataset_id", "position", "step").collect()
    assert all(json.loads(r.op)["column"] == f"c{r.position}" for r in out)
    got = {}
    for r in out:
        got.setdefault(r.dataset_id, []).append(r.position)
    return got


@pytest.mark.parametrize("fan", [256, 4])
def test_random_histories(spark, monkeypatch, fan):
    monkeypatch.setattr(history, "FAN", fan)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0 if fan == 4 else 1000)
    rng = random.Random(fan)
    log, want = [], {}
    for name, size in {"hot": 150, "a": 40, "b": 1, "c": 25}.items():
        events = [(p, rng.choices(["apply", "undo", "reset"], [11, 8, 1])[0]) for p in sorted(rng.sample(range(300), size))]
        log += [(name, p, e) for p, e in events]
        if replay(events):
            want[name] = replay(events)
    assert run(spark, log) == want


@pytest.mark.parametrize("events,left", [
    (["apply", "apply", "undo"], [0]),
    (["apply", "reset", "undo"], [0]),
    (["undo", "apply"], [1]),
    (["apply"] * 11 + ["undo"] * 10, [0, 1, 2]),
    (["apply", "apply", "reset", "apply"], [3]),
])
def test_known_histories(spark, events, left):
    assert run(spark, [("d", i, e) for i, e in enumerate(events)]) == {"d": left}


def test_log_keeps_only_the_newest_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    recipe_log.save_recipe(spark, path, "d", 1, [{"type": "trim"}, {"type": "drop_duplicates"}])
    recipe_log.save_recipe(spark, path, "d", 2, [{"type": "drop_nulls", "column": "a"}])
    recipe_log.save_recipe(spark, path, "e", 1, [{"type": "trim"}])
    assert recipe_log.load_recipe(spark, path, "d") == [{"type": "drop_nulls", "column": "a"}]
    newest = recipe_log.latest(spark.read.parquet(path)).collect()
    assert sorted((r.dataset_id, r.version) for r in newest) == [("d", 2), ("e", 1)]
