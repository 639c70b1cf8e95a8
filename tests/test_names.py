import pytest
from pyspark.sql import functions as F

from corpusmill.functions import names, strict_json


def test_relative_paths():
    for good in ("a", "a/b.c", "nul-like/x", "a b/ü"):
        assert names.safe_relative(good) == good
    for bad in ("", "/a", "a/", "a//b", "..", "a/./b", "a\\b", "c:x", "a*", "nul", "Com1.txt/x", "a.", "a ", "a\tb", "a\x85"):
        with pytest.raises(ValueError, match="unsafe"):
            names.safe_relative(bad)


def test_globs_stay_in_their_folder():
    paths = ["a.jsonl", "d/a.jsonl", "d/e/b.jsonl", "d/x[1].txt", "d/c1.txt", "d/c2.txt"]
    for glob, want in (("*.jsonl", paths[:1]), ("**/*.jsonl", paths[:3]), ("d/*", paths[1:2] + ["d/c1.txt", "d/c2.txt", "d/x[1].txt"]), ("d/c[!2].txt", ["d/c1.txt"]), ("d/{a.jsonl,c?.txt}", ["d/a.jsonl", "d/c1.txt", "d/c2.txt"]), ("d/**", sorted(paths[1:]))):
        assert names.matching(paths, [glob]) == want, glob
    assert names.matching(paths, ["*.jsonl", "a*"]) == ["a.jsonl"]
    for bad in ("/a", "../a", "a//b", "a\\b", "", "nothing*"):
        with pytest.raises(ValueError, match="glob|no file"):
            names.matching(paths, [bad])


def test_small_formats():
    assert names.folder_weight("a=b=3") == ("a=b", 3)
    assert [names.split_policy(x) for x in ("none", "count:5", "ratio:0.25")] == [("none", None), ("count", 5), ("ratio", 0.25)]
    assert all(names.split_policy_text(*names.split_policy(x)) == x for x in ("none", "count:5", "ratio:0.25"))
    assert names.next_number(["Run-009", "run-x", "other-50", "run-3"], "run") == 10 and names.next_number([], "run") == 1
    for f, bad in ((names.folder_weight, "a"), (names.folder_weight, "a=0"), (names.folder_weight, "=1"), (names.split_policy, "count:x"), (names.split_policy, "half"), (names.run_name, "a b"), (names.run_name, "")):
        with pytest.raises(ValueError):
            f(bad)


def test_numbers_in_columns(spark):
    rows = ["Run-007", "run-", "run-1x", "xrun-2", "run-18446744073709551615", "RUN-0000000000000000000000000000012", "run-0"]
    df = spark.createDataFrame([(x,) for x in rows], "name string")
    assert [None if r[0] is None else int(r[0]) for r in df.select(names.run_number(F.col("name"), "run")).collect()] == [7, None, None, None, 2**64 - 1, 12, 0]
    with pytest.raises(Exception, match="over 64 bits"):
        spark.createDataFrame([("run-18446744073709551616",)], "name string").select(names.run_number(F.col("name"), "run")).collect()
    ids = ["a/b.jsonl/@record-12", "b.jsonl/@record-012", "b.txt/@record-1", "b.jsonl/@record-0", "b.jsonl/@record-3"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ids], "id string").select(names.record_number(F.col("id"))).collect()] == [12, None, None, None, 3]
    paths = spark.createDataFrame([(x,) for x in ("a.b", "a/c", "a/b", "a")], "p string").orderBy(names.path_key(F.col("p")))
    assert [r[0] for r in paths.collect()] == ["a", "a/b", "a/c", "a.b"]


def test_selections(tmp_path):
    for f in ("x/1.txt", "x/y/2.txt", "z/3.txt", "z/4.md"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("t")
    rel = [p.removeprefix(str(tmp_path) + "/") for p in names.selected_files(str(tmp_path), ["x", "x/y", "z"])]
    assert rel == ["x/1.txt", "x/y/2.txt", "z/3.txt"]
    (tmp_path / "z/link.txt").symlink_to(tmp_path / "x/1.txt")
    for bad in (["z"], ["../x"], ["none"]):
        with pytest.raises(ValueError):
            names.selected_files(str(tmp_path), bad)
    assert names.resolved_format([None]) == "text" and names.resolved_format([None], "jsonl") == "jsonl"
    assert names.resolved_format([("chat", "train")], training=True) == "chat" and names.resolved_format([("base", "test")]) == "jsonl"
    for args in (([("base", "train"), None],), ([("base", "train"), ("chat", "train")],), ([("base", "train")], "chat")):
        with pytest.raises(ValueError):
            names.resolved_format(*args)
    for more in ({"training": True}, {"split": "count:3"}):
        with pytest.raises(ValueError):
            names.resolved_format([("base", "test")], **more)


def test_strict_json(spark):
    assert strict_json.identity('{"b": [1, 2], "a": {"y": 1, "x": 2}}') == strict_json.identity('{"a":{"x":2,"y":1},"b":[1,2]}') != strict_json.identity('{"a":{"x":2,"y":1},"b":[2,1]}')
    assert strict_json.sorted_counts({"b": 1, "a": 2}) == '{"a":2,"b":1}'
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ("[NaN]",), ("{",), (None,)], "t string")
    assert [r[0] is None for r in df.select(strict_json.problem(F.col("t"))).collect()] == [True, False, False, False, False]
    row = spark.range(1).select(strict_json.counts_column(F.array(F.lit("b"), F.lit("a")), F.array(F.lit(1), F.lit(2))).alias("m")).first()
    assert list(row["m"].items()) == [("a", 2), ("b", 1)]
