"""Stages one after the other on a small table with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))

    item, passage = text(30), text(60)
    rows = [(i, f"{text(40)}.\n{text(30)}.") for i in range(80)]
    rows += [(200, rows[0][1]), (201, f"{passage}\n{text(40)}"), (202, f"{passage}\n{text(50)}"), (203, f"{text(20)} {item} {text(20)}"), (204, None), (205, "")]
    rows += [(300 + i, " ".join([text(1).upper() + "!!"] * 30)) for i in range(80)]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, int(d < 300), 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "tokens"]
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got >= set(range(80)) | {201, 202}
    assert not got & {200, 203, *range(300, 380)}


def test_odd_tables(spark, tmp_path):
    """Repeated rows and ids, null ids and texts, a clashing column, a very long text, and an empty table."""
    rng = random.Random(2)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."

    a, b = text(40), text(40)
    rows = [(1, a), (1, a), (1, b), (None, text(30)), (None, None), (2, None), (3, ""), (4, text(20_000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text long, n_lines long"
    for name, some in (("full", rows), ("empty", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7, 8) for d, t in some], schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, text(30)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, at).columns == docs.columns
        got = sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in corpus_pipeline.run(spark, at).collect())
        assert got == ([(0, False), (0, True), (1, True), (1, True), (2, False), (3, False), (4, True)] if some else [])
