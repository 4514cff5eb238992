"""Import, ingest, search and the incremental runs, end to end on small archives."""

import json
import zipfile

import pytest

from corvane.api import Conversations
from corvane.cli import interactive
from corvane.operators.fulltext import QuerySyntaxError
from corvane.plans import reindex
from corvane.plans import components
from corvane.plans.components import PROFILES, Profile, load_profile, save_profile
from corvane.sources import archive
from corvane.streaming.files import ingest_new

NOW = "2024-06-01 00:00:00"


def node(key, text, role="user", time=1700000000.5, **more):
    message = {"id": key, "author": {"role": role}, "content": {"content_type": "text", "parts": [text]}, "create_time": time} | more
    return {"message": message, "parent": None}


def conversation(name, nodes):
    return {"conversation_id": name, "title": "A title", "create_time": 1700000000.0, "mapping": nodes}


@pytest.fixture
def folder(tmp_path):
    exported = [
        conversation("c1", {
            "z": node("m1", "Can you explain python decorators and python generators?"),
            "a": node("m2", "Decorators wrap functions; generators yield values lazily.", "Assistant", 1700000001.0, metadata={"attachments": [{"id": "file-1"}]}),
            "b": {"message": None, "parent": "a"},
            "c": node("m3", "hidden", metadata={"is_visually_hidden_from_conversation": True}),
            "d": node("m4", "  "),
            "e": node("m5", "x" * 4001, "developer", 0),
        }),
        conversation("c2", {"n": node("m6", "Thanks"), "o": node("m7", "Bread baking needs flour, water, salt and time in the oven.", time=1700000009.0)}),
    ]
    path = tmp_path / "in"
    path.mkdir()
    with zipfile.ZipFile(path / "export.zip", "w") as z:
        z.writestr("conversations.json", json.dumps(exported))
        z.writestr("user.json", "{}")
        z.writestr("files/file-1.png", b"")
    return path


@pytest.fixture
def talks(spark, folder, tmp_path):
    made = Conversations(spark, f"file://{tmp_path}/store", "lite")
    made.import_archive(f"file://{folder}/export.zip", NOW)
    return made


def test_archive(spark, folder):
    raw = archive.conversations(spark, f"file://{folder}/export.zip")
    rows = {r["id"]: r for r in archive.messages(raw, NOW).collect()}
    assert list(rows) and set(rows) == {"m1", "m2", "m5", "m6", "m7"}
    assert rows["m1"]["timestamp"].isoformat().startswith("2023-11-14T22:13:20.5")
    assert rows["m2"]["author_role"] == "assistant" and rows["m5"]["author_role"] == "system"
    assert rows["m2"]["attachments"][0]["local_path"] == "files/file-1.png" and rows["m2"]["attachments"][0]["filename"] == "file_file-1"
    assert str(rows["m5"]["timestamp"]) == NOW
    assert [r["place"] for r in archive.messages(raw, NOW).filter("conversation_id = 'c1'").orderBy("place").collect()] == [0, 1, 5]
    probe = archive.metadata(raw).first()
    assert (probe["format"], probe["total_conversations"], probe["user_info"]) == ("chatgpt", 2, "{}")
    assert archive.detect(spark, f"file://{folder}/export.zip").first()["confidence"] == 1.0


def test_elements(monkeypatch):
    import io

    monkeypatch.setattr(archive, "READ_CHARS", 3)
    told = [{"a": "x" * 50, "b": [1, {"c": "]},"}]}, {}, {"d": 'é"' + chr(10)}]
    assert [json.loads(e) for e in archive._elements(io.StringIO(" \n" + json.dumps(told, indent=1)))] == told
    assert list(archive._elements(io.StringIO("[]"))) == []
    for text in ("", "{}", "[{", '[{"a": 1}', "[{} x]"):
        with pytest.raises(ValueError):
            list(archive._elements(io.StringIO(text)))


def test_bad_archives(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        archive.check(spark, f"file://{tmp_path}/none.zip")
    (tmp_path / "text.zip").write_text("no archive")
    with pytest.raises(ValueError, match="not a ZIP"):
        archive.check(spark, f"file://{tmp_path}/text.zip")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("x", "")
    with pytest.raises(ValueError, match="no conversations.json"):
        archive.check(spark, f"file://{tmp_path}/empty.zip")


def test_ingest_and_search(talks):
    told = talks.get_statistics()
    assert told["total_messages"] == 5 and told["total_conversations"] == 2
    assert {r["intent"]: r["count"] for r in told["by_intent"].collect()}["question_explicit"] == 1
    top = talks.search("bread oven flour", 2).collect()
    assert top[0]["id"] == "m7" and [r["rank"] for r in top] == [1, 2]
    assert talks.search('"python generators"', mode="text").first()["id"] == "m1"
    assert talks.search("flour NOT bread", mode="text").count() == 0
    talks.rebuild_index()
    assert talks.search('"python generators"', mode="text").first()["id"] == "m1"
    assert [round(r["score"], 3) for r in talks.search("generators", mode="text").orderBy("rank").collect()] == [0.5, 0.333]
    with pytest.raises(QuerySyntaxError):
        talks.search("c++ ?", mode="text").count()
    with pytest.raises(ValueError, match="unknown mode"):
        talks.search("x", mode="hybrid")
    assert talks.get_message_by_id("m6")["intent"] == "social" and talks.get_message_by_id("none") is None
    assert [r["id"] for r in talks.get_conversation_messages("c2").collect()] == ["m6", "m7"]
    assert talks.store.read("message_chunks").count() == 2
    assert talks.store.read("source_files").first()["total_messages"] == 5
    assert talks.save_messages_batch(talks.store.read("messages").limit(1)).count() == 1 and talks.get_statistics()["total_messages"] == 5


def test_incremental_runs(talks):
    store, profile = talks.store, talks.profile
    assert reindex.segment_pending(store, 0.05) == 5
    assert reindex.segment_pending(store, 0.05) == 0
    rows = {r["id"]: r for r in store.read("messages").collect()}
    assert rows["m1"]["segment_id"] == "c1_seg1" and rows["m1"]["segment_sequence"] == 1 and rows["m1"]["segment_topic"]
    assert reindex.revectorize_outdated(store, profile, NOW) == 0
    assert reindex.revectorize_outdated(store, profile, NOW, force=True) == 5
    first = reindex.reindex_all(store, profile, NOW)
    assert (first["processed"], first["errors"], first["reindexed"], first["pending"]) == (5, 0, 5, 0)
    assert reindex.reindex_all(store, profile, NOW)["processed"] == 0
    row = talks.get_message_by_id("m7")
    assert row["intent"] == "Bread baking needs" and "Intención" not in row["refined_content"] and row["topics"]
    assert store.read("message_content").filter("message_id = 'm7' and refined_content like 'Intención: %'").count() == 1
    assert reindex.refine_pending(store, profile, NOW)["messages"] == 0
    assert reindex.rebuild(store, profile, NOW)["classified"] == 5
    assert reindex.rebuild(store, profile, NOW, vectors_only=True, resume=True)["vectors"] == 0
    n = reindex.revectorize_dimension(store, profile, NOW)
    assert n["messages"] == 0


def test_stream(spark, folder, tmp_path):
    talks = Conversations(spark, f"file://{tmp_path}/streamed", "express")
    args = (talks.store, f"file://{folder}", f"file://{tmp_path}/checkpoint", talks.profile, NOW)
    assert ingest_new(*args) == 1
    (folder / "copy.zip").write_bytes((folder / "export.zip").read_bytes())
    assert ingest_new(*args) == 0
    assert talks.get_statistics()["total_messages"] == 5


def test_interactive(talks, capsys):
    interactive(talks, ["/help", "/limit 99", "/mode text", "decorators", "/stats", "/exit", "never"])
    out = capsys.readouterr().out
    assert "/limit" in out and "decorators" in out.lower() and "total_messages" in out


class Counting:
    """A refiner, an embedder and a classifier that write a line for every text that they get."""

    def __init__(self, config):
        self.config = config

    def __call__(self, texts, *more):
        with open(self.config["log"], "a") as log:
            log.writelines(f"{len(t)}\n" for t in texts)
        if self.config["role"] == "refiner":
            if any("Thanks" in t for t in texts):
                raise RuntimeError("no answer")
            return ["Intención: ask\nTérminos: one (first), two\nTiene_Pregunta: SI\nResumen: short" for _ in texts]
        if self.config["role"] == "classifier":
            return [(["requesting an action or task", "casual conversation"], [0.75, 0.25]) for _ in texts]
        return [[3.0, 4.0, 0.0] for _ in texts]


@pytest.fixture
def counting(tmp_path):
    path = f"{__name__}.Counting"
    roles = ("refiner", "embedder", "classifier")
    options = {r: {"role": r, "log": str(tmp_path / r), "memory_mb": 10} for r in roles}
    return Profile("own", classifier=path, refiner=path, embedder=path, dimension=3, options=options), lambda role: (tmp_path / role).read_text().split() if (tmp_path / role).exists() else []


def test_models_of_a_profile(spark, folder, tmp_path, counting):
    """Refiner and embedder are called once a text, and a second run has nothing to do."""
    profile, calls = counting
    made = Conversations(spark, f"file://{tmp_path}/own", profile)
    told = made.import_archive(f"file://{folder}/export.zip", NOW)
    assert told["processed"] == 5 and len(calls("classifier")) == 5 and len(calls("embedder")) == 2  # four refined texts are the same
    assert len(calls("refiner")) >= 5  # a call that fails is made again, one text at a time
    rows = {r["id"]: r for r in made.store.read("messages").collect()}
    assert rows["m7"]["intent"] == "command" and rows["m7"]["is_command"] and rows["m7"]["refined_content"].startswith("Intención: ask")
    assert rows["m6"]["refined_content"] == "Thanks"
    vectors = made.store.read("vectors").collect()
    assert {tuple(round(x, 3) for x in v["vector"]) for v in vectors} == {(0.6, 0.8, 0.0)} and vectors[0]["vector_dim"] == 3
    assert made.search("anything", 3).count() == 3
    again = made.import_archive(f"file://{folder}/export.zip", NOW)
    assert again["processed"] == 0 and len(calls("classifier")) == 5
    (tmp_path / "refiner").unlink()
    first = reindex.reindex_all(made.store, profile, NOW, force=True)
    assert (first["processed"], first["errors"], first["pending"]) == (4, 1, 1)
    row = made.get_message_by_id("m7")
    assert (row["intent"], row["topics"], row["is_question"], row["is_command"], row["refined_content"]) == ("ask", ["one (first)", "two"], True, False, "ask one  first two short")
    (tmp_path / "refiner").unlink()
    assert reindex.reindex_all(made.store, profile, NOW)["errors"] == 1 and len(calls("refiner")) == 1  # only the one that failed is asked again


def test_resume_after(spark, folder, tmp_path):
    made = Conversations(spark, f"file://{tmp_path}/resumed", "express")
    made.import_archive(f"file://{folder}/export.zip", NOW)
    first = reindex.reindex_all(made.store, made.profile, NOW, limit=2)
    assert (first["processed"], first["last_processed_id"], first["pending"]) == (2, "m2", 3)
    assert first["eta_seconds"] > 0
    second = reindex.reindex_all(made.store, made.profile, NOW, force=True, after="m2", limit=2)
    assert second["last_processed_id"] == "m6"
    assert reindex.reindex_all(made.store, made.profile, NOW)["pending"] == 0


def test_migrate(talks):
    store = talks.store
    for name in ("message_content", "message_chunks"):
        store.write(name, store.read(name).limit(0))
    found = {r["item"]: r["n"] for r in reindex.migrate(store, NOW).collect()}
    assert found["message_content"] == 5 and found["message_chunks"] == 2 and found["orphaned_vectors"] == 0
    before = store.version("message_content")
    reindex.migrate(store, NOW)
    assert store.version("message_content") == before  # nothing was missing


def test_only_touched_buckets_are_written(spark, tmp_path):
    from corvane.operators.store import Store

    store = Store(spark, f"file://{tmp_path}/buckets", 64)
    store.initialize()
    store.write("message_content", spark.range(500).selectExpr("cast(id as string) AS message_id", "'a' AS full_content"))
    before = store.state("message_content").folders
    one = spark.createDataFrame([("7", "old"), ("7", "b")], "message_id string, full_content string").coalesce(1)
    store.upsert("message_content", one)
    after = store.state("message_content").folders
    assert sum(before[b] != after[b] for b in before) == 1
    rows = store.read("message_content").collect()
    assert len(rows) == 500 and {r["message_id"] for r in rows if r["full_content"] == "b"} == {"7"}  # the last of repeated ids
    store.update("message_content", spark.createDataFrame([("8", "c"), ("none", "d")], "message_id string, full_content string"), ["full_content"])
    assert store.read("message_content").filter("full_content = 'c'").count() == 1 and store.read("message_content").count() == 500
    store.update("message_content", spark.createDataFrame([("9", "e")], "message_id string, full_content string"), ["full_content"])
    assert len(store._versions("message_content")) == 2


def test_components(tmp_path):
    with pytest.raises(ImportError):
        components.find("no.such.Thing")
    with pytest.raises(ImportError):
        components.loader(Profile(embedder="no.such.Thing"), "embedder")
    made = components.model("collections.Counter", {"a": 1})
    assert components.model("collections.Counter", {"a": 1}) is made and components.model("collections.Counter", {"a": 2}) is not made
    assert components.held_models() == ["collections.Counter"] * 2
    components.drop_models()
    assert components.held_models() == []
    assert components.make(lambda b: b, {"a": 1, "b": 2}) == 2 and components.make(lambda config: config, {"a": 1}) == {"a": 1} and components.make(lambda **more: more, {"a": 1}) == {"a": 1}
    save_profile(PROFILES["lite"], str(tmp_path / "p.yaml"))
    assert load_profile(str(tmp_path / "p.yaml")).classifier == "rules"
    (tmp_path / "q.yaml").write_text("profile: express\nembedder: all-MiniLM-L6\ndimension: null\nrefiner:\nbatch: 4\n")
    own = load_profile(str(tmp_path / "q.yaml"))
    assert own.width == 384 and own.version == "all-MiniLM-L6_dim384" and own.options == {"batch": 4}
    with pytest.raises(FileNotFoundError):
        load_profile(str(tmp_path / "none.yaml"))


def test_model_files():
    from corvane.functions.refine import model_info, quantisation

    assert [quantisation(f) for f in ("m-Q5-K-M.gguf", "m-q80.gguf", "m.q4_0.gguf", "m.gguf")] == ["q5_k_m", "q8_0", "q4_0", "q4_k_m"]
    assert model_info("/models/m-Q8_0.gguf") == {"model": "m-Q8_0.gguf", "quantisation": "q8_0", "memory_mb": 3500, "loaded": False}
