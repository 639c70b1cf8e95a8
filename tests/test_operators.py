import itertools
import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import audit, chat, components, metrics, sequences, split


def test_split_rank_is_in_range_and_depends_on_seed(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("a"))
    r = df.select(split.unit_rank(F.col("a"), 1).alias("x"), split.unit_rank(F.col("a"), 2).alias("y")).collect()
    assert all(0 <= x < 1 and 0 <= y < 1 for x, y in r) and all(x != y for x, y in r)
    assert 0.4 < sum(x for x, _ in r) / 500 < 0.6


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks_hold_each_adjacent_pair_once(spark):
    for n in range(0, 12):
        for context in (1, 2, 4, 5):
            row = spark.range(1).select(sequences.chunks(F.lit(list(range(n))).cast("array<int>") if n else F.array().cast("array<int>"), context).alias("c")).first()["c"]
            pairs = [p for c in row for p in zip(c, c[1:], strict=False)]
            assert pairs == [(i, i + 1) for i in range(n - 1)] if n >= 2 else not row


def test_frozen_rank_and_draws(spark):
    """Seeded splits and epochs must stay what they were, so these may never change."""
    rng = sequences.SplitMix(0)
    assert [rng.next() for _ in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert sequences.hashed_rank("a/first.txt", 42) == 12343880375399922854
    assert sequences.epoch_order(8, 0, 42).tolist() == [7, 2, 1, 0, 4, 3, 6, 5]
    draws = sequences.weighted_draws(spark, [([0, 1], 1), ([2, 3, 4], 3)], 12, 2, 42).orderBy("draw_pos")
    assert [r["example_index"] for r in draws.collect()] == [3, 3, 1, 2, 0, 4, 2, 1, 4, 2, 1, 2]


def test_draws_after_a_rejection_move(spark):
    groups, rng, want = [([0, 1, 2], 2**63 + 1), ([3, 4], 1)], sequences.SplitMix(sequences.epoch_state(5, 1)), []
    for _ in range(40):
        group = groups[0][0] if rng.below(2**63 + 2) < 2**63 + 1 else groups[1][0]
        want.append(group[rng.below(len(group))])
    assert [r["example_index"] for r in sequences.weighted_draws(spark, groups, 40, 1, 5).orderBy("draw_pos").collect()] == want
    for bad in ([], [([0], 0)], [([0], 1), ([0], 1)], [([0, 2], 1)]):
        with pytest.raises(ValueError, match="groups"):
            sequences.check_groups(bad, 2)


def test_ranks_of_any_ids(spark):
    """The rank of columns of letters against one letter at a time."""
    ids = ["", "a", "ü/ß", "x" * 70, "a/b/c.txt", "12"]
    def slow(x):
        h = sequences.FNV_START
        for b in x.encode() + b"/":
            h = (h ^ b) * sequences.FNV_PRIME % 2**64
        return int(sequences.mix(((h ^ 9) + sequences.STEP) % 2**64))

    assert sequences.hashed_ranks(ids, 9).tolist() == [slow(x) for x in ids]
    assert sequences.hashed_ranks([], 9).tolist() == []


def test_weighted_draws_follow_the_weights(spark):
    got = Counter(r["example_index"] for r in sequences.weighted_draws(spark, [([0, 1], 1), ([2, 3, 4], 3)], 4000, 0, 7).collect())
    assert set(got) == {0, 1, 2, 3, 4} and 800 < got[0] + got[1] < 1200


def test_collate(spark):
    df = spark.createDataFrame([(0, [2, 4]), (1, [11, 12, 13, 14, 15]), (2, [7, 8, 9])], "draw_pos long, ids array<int>")
    got = sequences.collate(df, 2, 30).orderBy("batch_id", "row_in_batch").collect()
    assert [r["inputs"] for r in got] == [[2, 30, 30, 30], [11, 12, 13, 14], [7, 8]]
    assert [r["targets"] for r in got] == [[4, 30, 30, 30], [12, 13, 14, 15], [8, 9]]
    assert sum(x for r in got for x in r["valid"]) == 7


def test_conversations(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "gpt", "a"), (2, 1, "human", "b"), (3, 0, "user", "a"), (4, 0, "user", " "), (4, 1, "assistant", "b"), (5, 0, "robot", "a"), (5, 1, "assistant", "b")]
    df = chat.assemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: r[1] for r in df.select("conv_id", chat.is_valid(F.col("messages"))).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_wire_mask(spark):
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "x y"), ("assistant", "z"))])
    ids, mask = chat.wire(messages, lambda c: F.transform(F.split(c, " "), lambda w: F.length(w)), {"user": 2, "assistant": 3}, 4)
    assert spark.range(1).select(ids, mask).first()[:] == ([2, 1, 1, 4, 3, 1, 4], [False, False, False, False, True, True])


def brute_pairs(rows):
    def sets(t):
        w = re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    out = []
    for (a, x), (b, y) in itertools.combinations(sorted(rows), 2):
        same = [" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in (x, y)]
        s, t = sets(x), sets(y)
        if s and t and same[0] != same[1] and len(s & t) >= 0.8 * min(len(s), len(t)):
            out.append((a, b, len(s & t), min(len(s), len(t))))
    return out


def test_containment(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * 3 for _ in range(40)] for _ in range(4)]
    rows = [("a", "one two three four five six seven eight"), ("b", "TWO three four five six seven"), ("c", "nothing in common here at all"), ("d", None), ("e", ""), ("f", "ONE two three four five six seven eight"), ("g", "one  two three four five six seven eight"), ("h", "one two"), ("i", "One, two"), ("j", "\uff2fne two")]
    for i in range(60):
        w = base[i % 4][rng.randint(0, 20) :]
        rows.append((f"x{i:02d}", " ".join(rng.choice("abcdefghij") if rng.random() < 0.02 else x for x in w)))
    got = audit.containment_pairs(spark.createDataFrame(rows, "id string, text string")).collect()
    assert sorted((r["left_id"], r["right_id"], r["shared"], r["smaller"]) for r in got) == brute_pairs(rows)
    assert ("a", "f", 4, 4) in brute_pairs(rows) and len(got) > 100
    assert audit.containment_pairs(spark.createDataFrame([], "id string, text string")).count() == 0


def test_width_variants_are_one_text(spark):
    wide = "\uff28ello \ufb01ne"
    m = [F.array(F.struct(F.lit("user").alias("role"), F.lit(a).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit(b).alias("content"))) for a, b in (("Hello fine", "ok"), (wide, "ok "))]
    row = spark.range(1).select(*[chat.identity(x).alias(f"i{i}") for i, x in enumerate(m)], *[chat.overlap_hashes(x).alias(f"o{i}") for i, x in enumerate(m)], text.sha256(text.normalized(F.lit(wide))).alias("base")).first()
    assert row["i0"] == row["i1"] and row["o0"] == row["o1"] and row["base"] in row["o0"]
    units = spark.createDataFrame([("x", "Hello fine", "train"), ("y", f" {wide} ", "test"), ("z", None, "test")], "id string, text string, partition string")
    assert [r["n"] for r in audit.exact_overlaps(units).collect()] == [2]
    assert [(r["left_id"], r["right_id"], r["cross_partition"]) for r in audit.exact_pairs(units).collect()] == [("x", "y", True)]
    got = units.select(text.normalized(F.col("text")).alias("t"), audit.reject_reason(F.col("text")).alias("r")).collect()
    assert [r["t"] for r in got] == ["Hello fine", "Hello fine", None] and got[2]["r"] == "blank"


def test_nucleus_and_draw(spark):
    rng = random.Random(8)
    rows = [[rng.choice([0.0, 0.5, 1.0, 2.5]) for _ in range(6)] for _ in range(30)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v array<double>")
    got = df.select("i", metrics.nucleus(F.col("v"), 4, 0.7).alias("n")).select("i", "n", metrics.draw(F.col("n"), F.lit(0.4)).alias("d"), metrics.draw(F.col("n"), F.lit(1.0)).alias("last")).collect()
    for r in got:
        v = rows[r["i"]]
        order = sorted(range(6), key=lambda i: (-v[i], i))[:4]
        w = [math.exp(v[i]) for i in order]
        keep = [k for k in range(4) if sum(w[:k]) < 0.7 * sum(w)]
        p = [w[k] / sum(w[: len(keep)]) for k in keep]
        assert [x["id"] for x in r["n"]] == [order[k] for k in keep]
        assert [x["p"] for x in r["n"]] == pytest.approx(p)
        assert r["d"] == next(order[k] for k in keep if sum(p[: k + 1]) > 0.4) and r["last"] == order[keep[-1]]


def test_losses_and_norms(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 3), (0, 1, 2.0, 1), (1, 0, 5.0, 2)], "epoch long, update long, loss double, targets long")
    assert {r["epoch"]: r["loss"] for r in metrics.epoch_loss(df).collect()} == {0: 1.25, 1: 5.0}
    with pytest.raises(ValueError, match="finite"):
        metrics.epoch_loss(spark.createDataFrame([(0, 0, float("nan"), 3)], df.schema))
    assert sorted(tuple(r) for r in metrics.running_targets(df).collect()) == [(0, 0, 3), (0, 1, 4), (1, 0, 2)]
    assert sorted(tuple(r) for r in metrics.resume_at(df, 3).collect()) == [(0, 1)]
    norm = metrics.global_norm(spark.createDataFrame([([3.0],), ([0.0, 4.0],)], "v array<double>"), "v").first()
    assert tuple(norm) == (5.0, True)
    got = metrics.sample_summary(spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)], "g string, v long"), "g", "v").first()
    assert tuple(got) == ("a", 4, 1, 4, 2.5, 3)
