"""Model results by content: equal texts meet the model once, over rows and runs."""

import pytest
from pyspark.sql import functions as F

from corvane.operators.store import Store
from corvane.plans import ingest, reindex, results
from corvane.plans.components import Profile

NOW = "2024-06-01 00:00:00"


class Asked:
    """Writes down every text that it gets."""

    def __init__(self, config):
        self.config = config

    def __call__(self, texts, *more):
        with open(self.config["path"], "a") as out:
            out.writelines(f"{t.split(chr(10))[-1]}\n" for t in texts)
        if self.config["role"] == "refiner":
            if any("refuse" in t for t in texts):
                raise RuntimeError("no answer")
            return [f"Intención: ask\nTérminos: one\nResumen: {t.split(chr(10))[-1]}" for t in texts]
        return [[float(len(t)), 1.0] for t in texts]


@pytest.fixture
def asked(tmp_path):
    path = f"{__name__}.Asked"
    profile = Profile("own", classifier=None, refiner=path, embedder=path, dimension=2, options={r: {"role": r, "path": str(tmp_path / r)} for r in ("refiner", "embedder")})
    return profile, lambda role: (tmp_path / role).read_text().split("\n")[:-1] if (tmp_path / role).exists() else []


def rows(spark, texts, first=0):
    return spark.createDataFrame([(f"m{k + first}", "c", "user", t, "text") for k, t in enumerate(texts)], "id string, conversation_id string, author_role string, content string, content_type string").withColumn("timestamp", F.lit(NOW).cast("timestamp"))


def test_distinct_texts_meet_the_model_once_ever(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(results, "MANY_ROWS", 5)  # the frequent text's result is broadcast
    profile, calls = asked
    store = Store(spark, f"file://{tmp_path}/s", 4)
    texts = [f"text number {k % 6}" for k in range(40)] + ["the same"] * 20
    ingest.ingest(store, rows(spark, texts), profile, NOW)
    assert sorted(calls("refiner")) == sorted({f"text number {k}" for k in range(6)} | {"the same"})
    assert len(calls("embedder")) == 7
    found = {r["id"]: r for r in store.read("messages").join(store.read("vectors"), F.col("id") == F.col("entity_id")).collect()}
    assert len(found) == 60
    for k, t in enumerate(texts):
        r = found[f"m{k}"]
        assert r["refined_content"] == f"Intención: ask | Términos: one | Resumen: {t}" and r["vector"][0] > r["vector"][1] > 0
    ingest.ingest(store, rows(spark, ["the same", "new", "text number 3"], 100), profile, NOW)
    assert calls("refiner")[7:] == ["new"] and len(calls("embedder")) == 8
    reindex.reindex_all(store, profile, NOW, force=True)
    reindex.refine_pending(store, profile, NOW, force=True)
    reindex.rebuild(store, profile, NOW, resume=False, segments=False)
    assert len(calls("refiner")) == 8


def test_failed_calls_are_not_kept(spark, tmp_path, asked):
    profile, calls = asked
    store = Store(spark, f"file://{tmp_path}/s", 4)
    ingest.ingest(store, rows(spark, ["refuse this", "take this", "refuse this"]), profile, NOW)
    assert store.read("messages").filter("refined_content = 'refuse this'").count() == 2
    before = len(calls("refiner"))
    report = reindex.reindex_all(store, profile, NOW)
    assert (report["processed"], report["errors"]) == (0, 2) and len(calls("refiner")) == before + 1


def test_another_model_or_configuration_has_results_of_its_own():
    one = Profile(refiner="a.b", options={"refiner": {"heat": 1, "memory_mb": 5}})
    names = {results.model_name(p, "refiner") for p in (one, Profile(refiner="a.b", options={"refiner": {"heat": 2}}), Profile(refiner="a.c"), Profile(refiner="a.b", options={"refiner": {"heat": 1, "memory_mb": 9}}))}
    assert len(names) == 3
    assert results.is_kept(one, "refiner") and not results.is_kept(one, "embedder") and not results.is_kept(Profile(), "refiner")
