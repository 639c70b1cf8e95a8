"""Tokenizers, contracts, caches, models and journals."""

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpusmill.operators import cache, contracts, metrics, model, sequences, tokens
from corpusmill.sources import journals, scans

TEXTS = ["the cat sat on the mat", "the hat of the cat is flat", "that is that, isn't it?", "Ünïcode ßtraße 中文 🙂\n\n two", "", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def slow_merges(counts, n):
    words, out = {tuple(w): c for w, c in counts.items()}, []
    while len(out) < n:
        pairs = {}
        for w, c in words.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        new = {}
        for w, c in words.items():
            k, joined = 0, []
            while k < len(w):
                whole = w[k : k + 2] == best
                joined.append("".join(best) if whole else w[k])
                k += 2 if whole else 1
            new[tuple(joined)] = new.get(tuple(joined), 0) + c
        words = new
    return out


def test_merges_equal_recounting():
    counts = {"hug": 10, "pug": 5, "pun": 12, "bun": 4, "hugs": 5, "aaaa": 3, "aaa": 2, "abab": 4}
    assert tokens.learned_merges(counts, 30) == slow_merges(counts, 30)
    assert len(tokens.learned_merges(counts, 30, least=9)) < len(tokens.learned_merges(counts, 30))


def test_pairs_of_bytes(spark, docs):
    want = Counter()
    for t in TEXTS:
        for piece in regex.findall(tokens.PIECE, t or ""):
            b = piece.encode()
            want.update(zip(b, b[1:], strict=False))
    assert {(r["first"], r["second"]): r["n"] for r in tokens.pair_counts(docs).collect()} == want


def test_training_and_round_trip(spark, docs):
    t = tokens.train(docs, 290)
    assert t == tokens.train(docs.repartition(3), 290) and contracts.vocabulary(tokens.vocabulary(spark, t)) == 290
    out = tokens.decoded(tokens.encoded(docs, t), t).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [x or "" for x in TEXTS]
    assert sum(len(r["tokens"]) for r in out) < sum(len((x or "").encode()) for x in TEXTS)
    assert contracts.vocabulary(tokens.vocabulary(spark, tokens.train(docs, 256))) == 256
    assert contracts.vocabulary(tokens.vocabulary(spark, tokens.train(docs, 400, least=100))) == 256
    for bad in ({"vocabulary": 255}, {"vocabulary": 300, "least": 0}, {"vocabulary": 258, "controls": tokens.CONTROLS}):
        with pytest.raises(ValueError):
            tokens.train(docs, **bad)
    with pytest.raises(ValueError, match="no text"):
        tokens.train(docs.where("doc_id > 3"), 300)
    rows = tokens.coverage(spark.createDataFrame([([1, 0, 0],), ([],)], "tokens array<int>"), 0).collect()
    assert [(r["token_count"], r["unknown_count"], r["unknown_rate"]) for r in rows] == [(3, 2, 2 / 3), (0, 0, None)]


def test_chat_on_the_wire(spark, docs):
    t = tokens.train(docs, 280, controls=tokens.CONTROLS)
    system, user, assistant, end = tokens.control_ids(t)
    assert [system, user, assistant, end] == [276, 277, 278, 279]
    text = "say <|v1_user|> aloud"
    rows = [([("system", "be"), ("user", text), ("assistant", "no"), ("user", ""), ("assistant", "")],)]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>")
    r = tokens.wire(df, t).first()
    assert len(r["mask"]) == len(r["ids"]) - 1 and r["ids"].count(end) == 5 and r["ids"].count(user) == 2
    no = tokens.loaded(t).encode("no", add_special_tokens=False).ids
    assert [i for i, m in zip(r["ids"][1:], r["mask"], strict=True) if m] == [*no, end, end]
    ask = spark.createDataFrame([([("user", "x")],)], df.schema)
    assert tokens.wire(ask, t, prompt=True).first()["ids"][-1] == assistant
    for bad, prompt in ((ask, False), (df, True)):
        with pytest.raises(Exception, match="out of order"):
            tokens.wire(bad, t, prompt=prompt).collect()
    plain = json.loads(t)
    plain["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="plain special"):
        tokens.control_ids(json.dumps(plain))


def test_contracts(spark):
    ok = spark.createDataFrame([(0, [1, 2, 3], [True, False]), (1, [4, 5], [True])], "example_index long, ids array<int>, mask array<boolean>")
    assert contracts.examples(ok, 6, 2).count() == 2
    for bad, match in (((2, [1], []), "length"), ((2, [1, 9], [True]), "vocabulary"), ((2, [1, 2], [True, True]), "mask length"), ((2, [1, 2], [False]), "no target"), ((2, [1, 2], None), "have a mask"), ((2, [1, 2, 3, 4], [True] * 3), "length")):
        with pytest.raises(contracts.ContractError, match=match):
            contracts.examples(ok.union(spark.createDataFrame([bad], ok.schema)), 6, 2)
    with pytest.raises(contracts.ContractError, match="two tokens.*first .5"):
        contracts.documents(spark.createDataFrame([(4, [1, 2]), (5, [1])], "doc_id long, tokens array<int>"), 9)
    batch = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [1, 2, 3, 4])], "batch_id long, draw_pos long, ids array<int>")
    assert contracts.batches(batch, 2, 6, 9, 8, 0).count() == 2
    for args in ((1, 6, 9, 8, 0), (2, 5, 9, 8, 0), (2, 6, 9, 8, 9), (2, 6, 4, 8, 0), (2, 6, 9, 2, 0)):
        with pytest.raises(contracts.ContractError):
            contracts.batches(batch, *args)
    with pytest.raises(contracts.ContractError, match="dense"):
        contracts.vocabulary(spark.createDataFrame([("a", 0), ("b", 2)], "token string, id int"))
    with pytest.raises(contracts.ContractError, match="finite"):
        contracts.finite(spark.createDataFrame([(1, float("inf"))], "i long, x double"), ["x"], "i")


def test_cache(spark, tmp_path):
    rows = [(i, f"text {i}", "train" if i % 3 else "validation", list(range(i, i + 2 + i % 5))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, partition string, tokens array<int>")
    path = str(tmp_path / "c")
    manifest = cache.write(df, path, {"context": 3})
    assert cache.verify(spark, path, df, {"context": 3}) == manifest and manifest["documents"] == 12
    fingerprint = df.where("doc_id = 3").select(cache.fingerprint(F.col("tokens"))).first()[0]
    assert fingerprint == hashlib.sha256(np.arange(3, 8, dtype="<u4").tobytes()).hexdigest()
    want = sequences.numbered_examples(df.where("partition = 'train'").select("doc_id", "tokens"), 3).orderBy("example_index").collect()
    got = cache.examples(spark, path, "train", 3, 4).orderBy("example_index").collect()
    assert [r["ids"] for r in got] == [r["ids"] for r in want[4:]]
    assert [cache.example(spark, path, "train", 3, i) for i in (0, 5, len(want) - 1)] == [want[i]["ids"] for i in (0, 5, -1)]
    with pytest.raises(IndexError):
        cache.example(spark, path, "train", 3, len(want))
    for other, options, match in ((df.withColumn("text", F.when(F.col("doc_id") == 7, "x").otherwise(F.col("text"))), {"context": 3}, "stale.* 7"), (df.where("doc_id < 11"), {"context": 3}, "stale.* 11"), (df, {"context": 4}, "written with")):
        with pytest.raises(ValueError, match=match):
            cache.verify(spark, path, other, options)
    assert cache.receipt(df, {"a": 1}) == cache.receipt(df.repartition(5), {"a": 1}) != cache.receipt(df.limit(3), {"a": 1})


def test_model(spark):
    c = model.Config(11, 8, 12, 3, 2, 20)
    m = model.Model.fresh(c, 1)
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 11, (3, 6))
    full = m.forward(ids)
    changed = ids.copy()
    changed[:, 4:] = (changed[:, 4:] + 1) % 11
    assert np.allclose(full[:, :4], m.forward(changed)[:, :4]) and not np.allclose(full[:, 4], m.forward(changed)[:, 4])  # the future isn't seen
    valid = np.array([[True] * 6, [True] * 4 + [False] * 2, [True] + [False] * 5])
    masked = m.forward(ids, valid)
    assert np.allclose(masked[1, :4], m.forward(ids[1:2, :4])[0]) and (masked[1, 4:] == 0).all()
    for bad in (np.zeros((1, 9), int), np.array([[11]]), np.zeros((0, 3), int)):
        with pytest.raises(ValueError):
            m.forward(bad)
    with pytest.raises(ValueError, match="prefix"):
        m.forward(ids[:1], np.array([[True, False, True, True, True, True]]))
    rows = [(i, rng.integers(0, 11, rng.integers(2, 9)).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "example_index long, ids array<int>")
    losses = []
    for _, x in rows:
        logits = m.forward(np.array([x[:-1]]))[0]
        losses += [math.log(np.exp(row).sum()) - row[t] for row, t in zip(logits, x[1:], strict=True)]
    got = model.evaluate(df, m, batch=7).first()
    assert got["targets"] == len(losses) and got["mean_loss"] == pytest.approx(np.mean(losses)) and got["perplexity"] == pytest.approx(math.exp(np.mean(losses)))
    one = spark.createDataFrame([(rows[0][1], [True] + [False] * (len(rows[0][1]) - 2))], "ids array<int>, mask array<boolean>")
    assert model.evaluate(one, m).first()["mean_loss"] == pytest.approx(losses[0])
    out = model.generate(m, [3, 4], 6)
    assert out[:3] == [3, 4, int(m.forward(np.array([[3, 4]]))[0, -1].argmax())] and len(out) == 8
    assert model.generate(m, [3, 4], 6, out[2]) == out[:3]
    assert model.generate(m, [1], 5, seed=9, top_k=4, top_p=0.9) == model.generate(m, [1], 5, seed=9, top_k=4, top_p=0.9)
    with pytest.raises(ValueError, match="context"):
        model.generate(m, [1], 8)
    logits = rng.normal(size=9).round(1)
    row = spark.createDataFrame([(logits.tolist(),)], "v array<double>").select(metrics.nucleus(F.col("v"), 5, 0.8).alias("n")).first()["n"]
    assert [(r["id"], pytest.approx(r["p"])) for r in row] == model.shares(logits, top_k=5, top_p=0.8)
    assert model.drawn([(4, 0.5), (2, 0.5), (7, 0.0)], 1.0) == 2 and model.drawn([(4, 0.5), (2, 0.5)], 0.5) == 2


def test_journals(spark, tmp_path):
    j = journals.Journal(str(tmp_path / "m.jsonl"))
    j.add("update", epoch=0, completed_updates=1, pre_update_loss=2.5)
    j.add("validation", mean_cross_entropy=1.5, perplexity=4.5)
    for bad in ({"event": "update", "pre_update_loss": float("nan")}, {"event": "party"}):
        with pytest.raises(ValueError):
            j.add(**bad)
    j.close()
    with open(tmp_path / "m.jsonl", "a") as f:
        f.write('broken\n{"event": "upd')
    got = journals.events(spark, str(tmp_path / "m.jsonl")).orderBy("at").collect()
    assert [(r["event"], r["pre_update_loss"], r["perplexity"]) for r in got] == [("update", 2.5, None), ("validation", None, 4.5)]
    with pytest.raises(FileExistsError):
        journals.Journal(str(tmp_path / "m.jsonl"))


def test_checkpoints_and_scores(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()
    first = journals.save_checkpoint(str(runs), "Run", {"step": 1})
    second = journals.save_checkpoint(str(runs), "run", {"step": 2})
    (runs / "RUN-0007").mkdir()
    assert [first.name, second.name, journals.save_checkpoint(str(runs), "run", {}).name] == ["run-1", "run-2", "run-8"]
    (runs / "run-8/manifest.json").write_text("{}  ")
    found = journals.checkpoints(spark, str(runs), "run")
    assert {(int(r["number"]), r["status"]) for r in found.collect()} == {(1, "complete"), (2, "complete"), (7, "incomplete"), (8, "invalid")}
    assert metrics.latest_checkpoint(found).first()["problem"] == "invalid"
    assert metrics.latest_checkpoint(found.where("number < 8")).first()["name"] == "run-2"
    score = {"prompt_id": "p", "checkpoint": "run-2", "criterion": "c", "score": 3, "max_score": 5, "notes": "n"}
    good = {"selection_reason": "best", "rubric": {"c": "clear"}, "records": [score]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(good))
    report = journals.select_checkpoint(spark, str(path), str(second), str(tmp_path / "report"))
    assert report["selected_checkpoint"] == "run-2" and report["checkpoint"]["files"] == 2
    assert report["checkpoint"] == journals.artifact(spark, str(second)) != journals.artifact(spark, str(first))
    with pytest.raises(ValueError, match="no scores"):
        journals.select_checkpoint(spark, str(path), str(first), str(tmp_path / "other"))
    for change in ({"score": 6}, {"criterion": "x"}, {"notes": " "}, {"score": True}, {"max_score": 0, "score": 0}):
        path.write_text(json.dumps(good | {"records": [score | change]}))
        with pytest.raises(ValueError):
            journals.scores(spark, str(path))
    path.write_text(json.dumps(good | {"records": [score, score]}))
    with pytest.raises(ValueError, match="repeated"):
        journals.scores(spark, str(path))


def test_document_lines(spark, tmp_path):
    root = tmp_path / "r (1).x"
    (root / "d").mkdir(parents=True)
    (root / "d/a.jsonl").write_text('{"text": "one"}\n\n{"text": " "}\n{"text": "two", "n": 1}\n')
    assert sorted(map(tuple, journals.jsonl_documents(spark, str(root)).collect())) == [("d/a.jsonl/@record-1", "one"), ("d/a.jsonl/@record-4", "two")]
    assert journals.strict_lines(spark, str(root)).count() == 3
    (root / "d/b.jsonl").write_text('{"text": "one", "text": "two"}\n')
    with pytest.raises(scans.SourceError, match="repeated"):
        journals.strict_lines(spark, str(root))
    with pytest.raises(scans.SourceError, match="over 10 bytes"):
        scans.lines(spark, str(root), max_bytes=10)
    records = spark.createDataFrame([("a", "base", "train", "x"), ("b", "chat", "test", "{}\n")], "id string, stage string, partition string, payload string")
    out = journals.export_records(records, str(tmp_path / "out")).collect()
    assert {(tmp_path / "out" / r["output"]).read_text() for r in out} == {"x", "{}\n"}
    journals.stage_report(str(tmp_path / "out"), {"a": 1})
    assert json.loads((tmp_path / "out/COMPLETE").read_text())["manifest_sha256"] == hashlib.sha256((tmp_path / "out/manifest.json").read_bytes()).hexdigest()
