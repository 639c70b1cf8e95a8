"""From scans to a verified release, and what refuses to be one."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill.operators import build
from corpusmill.operators.contracts import ContractError, Limits
from corpusmill.sources import release


def source(**changes):
    return build.Source(**{"id": "books", "files": ("*.jsonl",), "format": "jsonl", "mapping": {"kind": "text", "column": "text"}, "language": "en", "permitted_use": "any", "repo": "books", **changes})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "books").mkdir()
    lines = [{"text": "A  wide day"}, {"text": "Ａ wide day", "extra": 1}, {"text": " "}, *({"text": f"Book line {i}", "family": f"f{i // 4}"} for i in range(60))]
    (tmp_path / "books/a.jsonl").write_text("".join(json.dumps({"family": "x", **x}) + "\n" for x in lines))
    (tmp_path / "talks").mkdir()
    rows = [{"ask": f"Question {i}?", "extra": "Some context" if i % 2 else "", "answer": "Book line 7" if i == 0 else f"Answer {i}"} for i in range(40)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "talks/t.parquet")
    (tmp_path / "chats").mkdir()
    (tmp_path / "chats/c.json").write_text(json.dumps([{"turns": [{"from": "human", "value": f"Hi {i}"}, {"from": "gpt", "value": f"Hello {i}"}]} for i in range(3)]))
    return str(tmp_path)


TALKS = {"id": "talks", "repo": "talks", "files": ("t.parquet",), "format": "parquet", "mapping": {"kind": "instruction", "prompt_column": "ask", "response_column": "answer", "input_column": "extra", "system": "Be brief."}}
CHATS = {"id": "chats", "repo": "chats", "files": ("*.json",), "format": "json", "mapping": {"kind": "messages", "column": "turns", "role_field": "from", "content_field": "value", "user_role": "human", "assistant_role": "gpt"}}


def test_release_of_three_sources(spark, folder, tmp_path):
    recipe = build.Recipe("out", (source(group_column="family"), source(**TALKS), source(**CHATS, partition="test")), 7, (0.5, 0.25, 0.25))
    manifest = build.build(spark, folder, recipe, str(tmp_path / "releases"))
    path = str(tmp_path / "releases/out")
    assert release.verify(spark, path) == manifest
    assert (manifest["records_seen"], manifest["blank_records"], manifest["duplicates_removed"], manifest["retained"]) == (106, 1, 1, 104)
    assert manifest["lock"]["sources"][0]["files"] == ["a.jsonl"]
    rows = {r["node"]: r for r in spark.read.parquet(f"{path}/membership").collect()}
    assert rows["books/a.jsonl#row-2"]["duplicate_of"] == "books/a.jsonl#row-1" and rows["books/a.jsonl#row-2"]["output_row"] is None
    assert rows["books/a.jsonl#row-11"]["partition"] == rows["talks/t.parquet#row-1"]["partition"]  # the answer is a line of a book
    assert rows["books/a.jsonl#row-11"]["connected_group"] == rows["books/a.jsonl#row-9"]["connected_group"]  # its family
    assert all(rows[f"chats/c.json#row-{i}"]["partition"] == "test" for i in (1, 2, 3))
    for stage in release.STAGES:
        for part in release.PARTITIONS:
            kept = sorted((r for r in rows.values() if (r["stage"], r["partition"]) == (stage, part) and r["output_row"]), key=lambda r: r["position"])
            assert [r["output_row"] for r in kept] == list(range(1, len(kept) + 1)) and len(kept) == manifest["files"][f"{stage}/{part}"][1]
    texts = [json.loads(r[0]) for p in release.PARTITIONS for r in release.partition(spark, path, "base", p).collect()]
    assert {"text": "A  wide day"} in texts and len(texts) == 61
    talk = next(json.loads(r[0]) for p in release.PARTITIONS for r in release.partition(spark, path, "chat", p).collect() if "Question 1?" in r[0])
    assert [m["content"] for m in talk["messages"]] == ["Be brief.", "Question 1?\n\nSome context", "Answer 1"]


def test_conflicts_and_limits(spark, folder, tmp_path):
    two = (source(partition="train"), source(**TALKS, partition="test"))
    with pytest.raises(ContractError, match="conflict"):
        build.build(spark, folder, build.Recipe("a", two), str(tmp_path))
    with pytest.raises(ContractError, match="is empty"):
        build.build(spark, folder, build.Recipe("b", (source(group="one"),)), str(tmp_path))
    for limits in (Limits(max_records=5), Limits(max_record_bytes=20), Limits(max_normalized_bytes=100), Limits(max_file_bytes=10), Limits(max_files=1)):
        sources = (source(), source(**CHATS)) if limits.max_files == 1 else (source(),)
        with pytest.raises(ContractError, match="exceed|max_"):
            build.build(spark, folder, build.Recipe("c", sources, limits=limits), str(tmp_path))
    with pytest.raises(ValueError, match="complete"):
        release.verify(spark, str(tmp_path / "b"))


def test_recipes():
    text = 'output = "o"\nseed = 3\n[split]\ntrain = 0.8\nvalidation = 0.1\ntest = 0.1\n[[sources]]\nid = "a"\nfiles = ["*.jsonl"]\nformat = "jsonl"\nlanguage = "en"\npermitted_use = "any"\nmapping = {kind = "text", column = "text"}\n'
    recipe = build.Recipe.read(text)
    assert recipe.seed == 3 and recipe.ratios == (0.8, 0.1, 0.1) and recipe.sources[0].mapping["column"] == "text"
    for old, new in (('"o"', '"o/p"'), ("0.8", "0.9"), ("seed = 3", "seed = -1"), ("seed = 3", "seeds = 3"), ('id = "a"', 'id = "a b"'), ('"*.jsonl"', '"../*"'), ('"jsonl"\nl', '"csv"\nl'), ('language = "en"', 'language = " "'), ('column = "text"', 'column = ""'), ('column = "text"', 'colum = "text"'), ('kind = "text"', 'kind = "none"'), ('language = "en"', 'language = "en"\ngroup = "x"\ngroup_column = "y"'), ("[split]", "[limits]\nmax_files = 0\n[split]")):
        with pytest.raises(ValueError):
            build.Recipe.read(text.replace(old, new))
    with pytest.raises(build.RecipeError, match="differ"):
        build.Recipe("o", (source(), source(id="BOOKS")))
    with pytest.raises(build.RecipeError, match="differ"):
        source(**{**CHATS, "mapping": {**CHATS["mapping"], "user_role": "gpt"}})
