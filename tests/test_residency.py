import json

import pytest

from corvane.plans.residency import ModelBudget, StageLog, counted


def test_budget():
    budget = ModelBudget(100, margin=10)
    for name, size, priority in (("a", 40, 1), ("b", 40, 0), ("c", 50, 0), ("big", 95, 0)):
        budget.register(name, lambda name=name: f"model {name}", size, priority)
    assert budget.prepare("a") == "model a" and budget.prepare("b") == "model b" and budget.used() == 80
    assert budget.prepare("c") == "model c" and budget.loaded() == ["a", "c"]  # b has the lowest priority
    budget.prepare("b", then=("c",))
    assert budget.loaded() == ["c", "b"]  # a goes, though its priority is higher: c is needed next
    budget.finish("b", then=("b",))
    assert "b" in budget.loaded()
    budget.finish("b")
    assert "b" in budget.loaded()  # nothing comes after
    budget.finish("b", then=("c",))
    assert budget.loaded() == ["c"]
    with pytest.raises(MemoryError):
        budget.prepare("big")
    budget.unload_all()
    budget.unload_all()
    assert budget.used() == 0
    with pytest.raises(KeyError):
        budget.prepare("none")


def test_log(spark):
    lines = []
    with StageLog(lines.append).stage("count") as told:
        df, seen = counted(spark.range(7), "n")
        df.collect()
        told["rows"] = seen.get["rows"]
    assert json.loads(lines[0])["rows"] == 7
