"""Archives: plain JSON, folders and globs, corrupt and odd files, sizes beyond memory, imports of them."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.api import Conversations
from corvane.operators.store import Store
from corvane.plans.components import PROFILES
from corvane.sources import archive, stores
from corvane.streaming.files import ingest_new, problems

NOW = "2024-06-01 00:00:00"


def talk(k, text="words enough for one message"):
    return {"conversation_id": f"c{k}", "title": "T", "create_time": 1.7e9 + k, "mapping": {"n": {"parent": None, "message": {"id": f"m{k}", "author": {"role": "user"}, "content": {"content_type": "text", "parts": [f"{text} {k}"]}, "create_time": 1.7e9}}}}


def packed(path, talks, method=zipfile.ZIP_DEFLATED, **members):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("conversations.json", json.dumps(talks))
        for name, text in members.items():
            z.writestr(name.replace("_json", ".json"), text)
    return path


def damaged(path, at=0.5):
    raw = bytearray(path.read_bytes())
    place = int(len(raw) * at)
    raw[place] ^= 0xFF
    path.write_bytes(bytes(raw))


def found(spark, path):
    rows = archive.conversations(spark, str(path) if not isinstance(path, list) else path).collect()
    return sum(r["conversation"] is not None for r in rows), sorted(r["problem"] for r in rows if r["problem"])


def test_plain_json_files_folders_and_globs(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([talk(1), talk(2)]))
    (tmp_path / "big.json").write_text("﻿" + json.dumps([talk(k, "x" * 300) for k in range(2000)], indent=1), "utf-8")
    packed(tmp_path / "a.zip", [talk(5)], user_json='{"id": "u"}')
    assert found(spark, tmp_path / "good.json") == (2, [])
    assert found(spark, tmp_path / "big.json") == (2000, [])
    assert found(spark, tmp_path) == (2003, [])
    assert found(spark, f"{tmp_path}/*.json") == (2002, [])
    assert found(spark, [f"{tmp_path}/a.zip", f"file://{tmp_path}/good.json"]) == (3, [])
    assert {r["user_info"] for r in archive.conversations(spark, f"{tmp_path}/a.zip").collect()} == {'{"id": "u"}'}
    assert archive.messages(archive.conversations(spark, str(tmp_path / "good.json")), NOW).count() == 2


def test_a_wrong_file_gives_its_problem_and_no_conversation(spark, tmp_path):
    talks = [talk(k, f"text {k * 7919}") for k in range(3000)]
    damaged(packed(tmp_path / "crc.zip", talks, zipfile.ZIP_STORED), 0.9)
    damaged(packed(tmp_path / "deflate.zip", talks))
    (tmp_path / "cut.json").write_text(json.dumps(talks)[:-200])
    (tmp_path / "deep.json").write_text("[" + '{"a":' * 200_000 + "1" + "}" * 200_000 + "]")
    (tmp_path / "numbers.json").write_text("[1, 2]")
    (tmp_path / "object.json").write_text("{}")
    (tmp_path / "bytes.json").write_bytes(b'[{"a": "\xff"}]')
    (tmp_path / "text.zip").write_text("no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("x.json", "[]")
    raw = bytearray(packed(tmp_path / "locked.zip", [talk(1)]).read_bytes())
    raw[6] |= 1  # the flag of encrypted members, here and in the directory
    raw[raw.rindex(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(bytes(raw))
    packed(tmp_path / "good.zip", [talk(1)])
    rows = archive.conversations(spark, str(tmp_path)).collect()
    wrong = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in rows if r["problem"]}
    assert set(wrong) == {p.name for p in tmp_path.iterdir()} - {"good.zip"}
    assert len(rows) == len(wrong) + 1
    assert "nested" in wrong["deep.json"] and "no conversations.json" in wrong["other.zip"] and "encrypted" in wrong["locked.zip"]


def test_detect_reads_directories_only(spark, tmp_path):
    damaged(packed(tmp_path / "a.zip", [talk(k) for k in range(500)], zipfile.ZIP_STORED))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["confidence"]) for r in archive.detect(spark, str(tmp_path)).collect()}
    assert got == {"a.zip": ("chatgpt", 1.0), "b.json": ("chatgpt", 0.5), "c.json": (None, 0.0)}


class Counting(io.RawIOBase):
    """A file that counts what is read of it."""

    def __init__(self, raw):
        self.raw, self.bytes, self.most = io.BytesIO(raw), 0, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, *at):
        return self.raw.seek(*at)

    def tell(self):
        return self.raw.tell()

    def readinto(self, b):
        n = self.raw.readinto(b)
        self.bytes, self.most = self.bytes + n, max(self.most, n)
        return n


def test_directory_costs_no_more_for_large_archives(tmp_path):
    path = packed(tmp_path / "a.zip", [talk(k, "y" * 2000) for k in range(2000)], zipfile.ZIP_STORED)
    file = Counting(path.read_bytes())
    [batch] = archive.read_directory(lambda: file, "a.zip", 1)
    assert batch.to_pylist()[0]["packed"]
    assert file.bytes < 200_000 < path.stat().st_size


def test_archive_beyond_two_gigabytes_in_bounded_memory(spark, tmp_path):
    """A sparse member of 2.1 GB stands before the conversations; Spark's binaryFile would refuse the file."""
    import resource

    path = tmp_path / "large.zip"
    body = json.dumps([talk(1), talk(2)]).encode()
    info = zipfile.ZipInfo("video.bin")
    with open(path, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(info, "w", force_zip64=True) as member:
            block = bytes(1 << 24)
            for _ in range(132):
                member.write(block)
        z.writestr("conversations.json", body)
    assert path.stat().st_size > 2**31
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = [r for b in archive.read_conversations(lambda: stores.open_file(str(path)), str(path), 1) for r in b.to_pylist()]
    assert len(rows) == 2 and rows[0]["members"] == ["video.bin", "conversations.json"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
    path.unlink()


def test_import_takes_all_files_or_none(spark, tmp_path):
    (tmp_path / "in").mkdir()
    packed(tmp_path / "in" / "a.zip", [talk(1)])
    (tmp_path / "in" / "b.json").write_text(json.dumps([talk(2), talk(3)]))
    talks = Conversations(spark, f"file://{tmp_path}/store", "express")
    assert talks.import_archive(str(tmp_path / "in"), NOW)["processed"] == 3
    assert talks.import_archive(str(tmp_path / "in"), NOW)["processed"] == 0
    damaged(packed(tmp_path / "in" / "c.zip", [talk(k) for k in range(9, 3000)], zipfile.ZIP_STORED))
    with pytest.raises(ValueError, match="c.zip"):
        talks.import_archive(str(tmp_path / "in"), NOW)
    assert talks.get_statistics()["total_messages"] == 3


def test_stream_leaves_wrong_files_out_until_they_are_mended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bad = packed(tmp_path / "in" / "bad.zip", [talk(k) for k in range(3000)], zipfile.ZIP_STORED)
    good_bytes = bad.read_bytes()
    damaged(bad, 0.7)
    packed(tmp_path / "in" / "a.zip", [talk(5000)])
    (tmp_path / "in" / "b.json").write_text(json.dumps([talk(5001)]))
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: ingest_new(store, str(tmp_path / "in"), str(tmp_path / "seen"), PROFILES["express"], NOW)
    assert run() == 2
    assert store.read("messages").count() == 2 and store.read("source_files").count() == 2
    assert [r["path"].rsplit("/", 1)[1] for r in problems(store).collect()] == ["bad.zip"]
    assert run() == 0
    bad.write_bytes(good_bytes)
    assert run() == 1
    assert store.read("messages").count() == 3002
    assert run() == 0


def test_stores_that_arrow_does_not_open_go_through_spark(spark, tmp_path):
    packed(tmp_path / "a.zip", [talk(1)])
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./in", f"file://{tmp_path}")
    rows = archive.conversations(spark, "viewfs://t/in/a.zip").select("path", F.col("conversation").isNotNull().alias("c")).collect()
    assert [(r["path"], r["c"]) for r in rows] == [("viewfs://t/in/a.zip", True)]
