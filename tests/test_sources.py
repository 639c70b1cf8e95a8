import gzip
import json

import pytest

from corpusmill.sources import release, scans


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "other": 1}\n\n{"text": "y"}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"text": "z"}\n')
    got = sorted((r["text"], r["row_no"]) for r in scans.jsonl(spark, str(tmp_path), ["text"]).collect())
    assert got == [("x", 1), ("y", 3), ("z", 1)]
    for i, bad in enumerate(('{"text": true}', '{"txt": "x"}', "[]", "7", '{"text": ')):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "c.jsonl").write_text('{"text": "ok"}\n\n' + bad + "\n")
        with pytest.raises(scans.SourceError, match="line 3"):
            scans.jsonl(spark, str(tmp_path / f"bad{i}"), ["text"])
    (tmp_path / "arr").mkdir()
    (tmp_path / "arr" / "d.json").write_text(json.dumps([{"text": "p"}, {"text": "q"}]))
    assert sorted((r["row_no"], r["text"]) for r in scans.json_array(spark, str(tmp_path / "arr"), ["text"]).collect()) == [(1, "p"), (2, "q")]


def test_text_and_chat_scans(spark, tmp_path):
    (tmp_path / "t/north/deep").mkdir(parents=True)
    (tmp_path / "t/north/one.txt").write_text("hello")
    (tmp_path / "t/north/deep/two.txt").write_text("again\n")
    (tmp_path / "t/north/empty.txt").write_text(" \n")
    assert sorted(r["doc_id"] for r in scans.text_documents(spark, str(tmp_path / "t")).collect()) == ["north/deep/two.txt", "north/one.txt"]
    (tmp_path / "c").mkdir()
    line = {"schema_version": 1, "messages": [{"role": "user", "content": "a"}]}
    (tmp_path / "c/c.jsonl").write_text(json.dumps(line) + "\n")
    assert scans.conversations(spark, str(tmp_path / "c")).first()["messages"][0]["content"] == "a"
    (tmp_path / "c/c.jsonl").write_text(json.dumps(line | {"more": 1}) + "\n")
    with pytest.raises(scans.SourceError):
        scans.conversations(spark, str(tmp_path / "c"))


def test_release(spark, tmp_path):
    rows = [("base", "train", 1, '{"text":"a"}', "n1", False), ("base", "train", 2, '{"text":"a"}', "n2", True), ("chat", "test", 3, "{}", "n3", False)]
    df = spark.createDataFrame(rows, "stage string, partition string, position long, payload string, node string, duplicate boolean")
    path = str(tmp_path / "r")
    manifest = release.publish(df, path, 42)
    assert manifest["files"]["base/train"][1] == 1 and manifest["files"]["base/test"] == [[], 0]
    assert release.verify(spark, path) == manifest
    assert [r[0] for r in release.partition(spark, path, "chat", "test").collect()] == ["{}"]
    with pytest.raises(Exception, match="(?i)exist"):
        release.publish(df, path, 42)
    part = next((tmp_path / "r/data/stage=base/partition=train").glob("part-*.txt"))
    part.write_text("changed\n")
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own checksum would notice first
    with pytest.raises(ValueError, match="changed"):
        release.verify(spark, path)
