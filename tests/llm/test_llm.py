"""Operators against brute force on small fixtures, with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import weakref
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import ann, bpe, common, decontam, linededup, neardup, pii, quality, quotes, similar, tokenbin, toxicity

DOCS = "doc_id long, text string, n long, key string, words string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "w", 0.5) for r in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_merges_and_round_trips(ranks):
    c, rng = bpe.Codec(ranks, P.PATTERN), random.Random(3)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(1500):
        t = "".join(rng.choice(["a", "the", "ing", "é", "ß", "中", "🙂", " ", "  ", "\n", "\t \n", "1", "!", "'s", "́", "<|endoftext|>", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 25)))
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_idle_workers_let_go_of_the_codec(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_S", 0.2)
    key = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    with bpe.codec(*key) as c:
        seen = weakref.ref(c)
    with bpe.codec(*key) as again:
        assert again is c
        del c, again
        time.sleep(0.6)  # in use: kept
        assert seen() is not None
    until = time.monotonic() + 20
    while seen() is not None and time.monotonic() < until:
        time.sleep(0.05)
    assert seen() is None
    with bpe.codec(*key) as new:
        assert new.decode(new.encode("Hello there")) == b"Hello there"


def test_bpe_digests(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.digests(docs(spark, [(1, "Hello there"), (None, None), (2, ""), (2, "")]), path, P.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["n_tokens"], r["decoded_sha256"]) for r in got) == sorted([(0, empty)] * 3 + [(2, hashlib.sha256(b"Hello there").hexdigest())])
    back = bpe.decoded(bpe.encoded(docs(spark, [(1, "Hé ×"), (2, None)]), path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(r["text"] for r in back) == ["", "Hé ×"]
    assert bpe.digests(docs(spark, []), path, P.PATTERN).count() == 0


def test_huffman_is_optimal_and_decodes():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 300)
    lengths = tokenbin.code_lengths(counts)
    assert (lengths[counts == 0] == 0).all() and abs(sum(2.0 ** -int(n) for n in lengths[lengths > 0]) - 1) < 1e-9
    short = tokenbin.code_lengths(2 ** np.arange(30, dtype=np.int64))
    assert short.max() == tokenbin.LIMIT
    for n in (0, 1, 511, 512, 5000):
        ids = rng.choice(np.flatnonzero(counts), n).astype("<u2")
        image = tokenbin.to_image(np.array([7]), np.array([n]), ids, lengths, tokenbin.canonical(lengths))
        assert (tokenbin.from_image(image)[2] == ids).all()


def test_token_files(spark):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(5, "Hello, WORLD's  é\xa0x <|endoftext|> 12"), (3, None), (9, ""), (4, "Ünïcode… straße\n\nIt's!!"), (4, "again"), (8, "a " * 3000)]
    got = tokenbin.round_trip(docs(spark, rows), path, 2).collect()
    want, at = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0], np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u2").tobytes())):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert tokenbin.round_trip(docs(spark, []), path, 2).count() == 0


def test_words_of_letters_and_signs_equal_the_tokenizer():
    path, rng = P.path("word_bpe_49k.json"), random.Random(4)
    t, w = Tokenizer.from_file(path), tokenbin.word_ids(path, "<u2")
    parts = ["İ", "GELD", "ß", "Σ", "ΑΣ", "é", "e\u0301", "\u0307", "ǅ", "ﬁ", "Å", "i", "I", "x", "9", "²", ".", "'", "'s", "!?", "-", "…", "中", "🙂", "ا", "\u0338", "=", " ", "\n", "\xa0", "_", "q" * 70]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        assert np.frombuffer(w.text(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)
    assert max(map(len, w)) <= tokenbin.KEY


def test_codes_of_more_ids_than_the_limit():
    n = 5 + (1 << tokenbin.LIMIT)
    lengths = tokenbin.code_lengths(np.ones(n, np.int64))
    assert lengths.max() == tokenbin.LIMIT + 1
    ids = np.random.default_rng(2).integers(0, n, 3000).astype("<u4")
    image = tokenbin.to_image(np.array([1]), np.array([len(ids)]), ids, lengths, tokenbin.canonical(lengths))
    assert (tokenbin.from_image(image)[2] == ids).all()


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "@", "b.c", ".", "1", "23", "4111111111111111", " ", "-", "+", "+1 (555) 123-4567", "255", "256", "0001.2.3.4", "é", "x@y.z"]

    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        n = lambda m: re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(n(m)) <= 19 and pii.luhn(n(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(n(m)) <= 15]

    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute(t)


def test_pii_report(spark):
    rows = [(1, "mail a.b@c.org now"), (2, None), (3, ""), (None, "ip 1.2.3.4"), (4, 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" x')] + [(10 + i, f'key "{i:02d}eb58b8af68854f0e01b4ad40cdbb6ae7f57890"') for i in range(20)]
    got = {r["doc_id"]: r for r in pii.report(docs(spark, rows)).collect()}
    assert got[1]["spans"] == "email:5:14" and got[1]["n_email"] == 1
    assert got[2]["base_sha256"] == got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["n_ip"] == 1 and got[4]["spans"].startswith("secret:9:")
    assert pii.redact("mail a.b@c.org now", got[1]["spans"]) == "mail [email] now"
    assert pii.report(docs(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "is_small", lambda *_: False)
    rng = random.Random(5)
    items = [words(rng, 40), words(rng, 13), "tiny item here", "", None, "a a a a a a a a a a a a a a a"]
    texts = [words(rng, 30) + " " + " ".join(items[0].split()[5:25]) + ". " + words(rng, 10), items[1].upper(), "some tiny, ITEM here ok", None, "", "a " * 40, words(rng, 900) + " " + items[1], items[1].upper()]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, n long")
    got = {(r["doc_id"]): r for r in decontam.report(docs(spark, list(enumerate(texts)) + [(1, texts[1])]), bench).collect()}
    win: dict = {}
    for i, t in enumerate(items):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for k in range(max(1, len(w) - 12) if w else 0):
            win.setdefault(tuple(w[k : k + min(13, len(w))]), set()).add(str(i))
    for d, t in enumerate(texts):
        w, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()), set()
        hit = [False] * len(w)
        for x, ids in win.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    found |= ids
                    hit[k : k + len(x)] = [True] * len(x)
        want = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))
        assert tuple(got[d])[1:] == want
    assert len(got) == len(texts)
    assert {r["doc_id"] for r in decontam.keep_clean(docs(spark, list(enumerate(texts))), bench).collect()} == {d for d in got if not got[d]["contaminated"]}
    assert decontam.report(docs(spark, [(1, "x")]), bench.limit(0)).first()["contaminated"] is False


@pytest.mark.parametrize("tight", [False, True])
def test_near_duplicates(spark, monkeypatch, tight):
    if tight:
        for name, n in (("HOT", 2), ("LARGE", 2), ("BLOCK", 8), ("PACK", 16), ("SORTED", 500), ("REDUCED", 500), ("SOME", 5), ("AT_ONCE", 20)):
            monkeypatch.setattr(similar, name, n)
        monkeypatch.setattr(common, "is_small", lambda *_: False)
    rng, rows = random.Random(7), []
    base = [words(rng, 60).split() for _ in range(6)]
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100, "a b"), (101, "A  b"), (102, None), (103, ""), (104, ""), (0, rows[0][1]), (None, "x y z")]
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        if d is not None:
            sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    top = {d: d for d in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
        if all(top[top[a]] == top[a] for a in sets):
            break
    got = neardup.report(docs(spark, rows), size=4).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, len(s), top[d], top[d] == d) for d, s in sets.items())
    kept = [r["doc_id"] for r in neardup.keep_one(docs(spark, rows), size=4).collect()]
    assert {d for d in kept if d is not None} == {d for d in top if top[d] == d} and None in kept
    assert neardup.report(docs(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    near = a + " end"
    rows = [(1, a), (2, near), (2, b), (3, c), (3, c), (None, c), (None, d), (None, d + " end"), (None, d), (4, ""), (5, None), (6, a.upper())]
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(docs(spark, rows)).collect()), key=str)
    of_d = [x for x in got if x[0] is None]
    assert [x for x in got if x[0] is not None] == sorted([(1, a), (2, b), (3, c), (4, ""), (5, None)], key=str)
    assert len(of_d) == 1 and of_d[0][1].startswith(d)
    assert neardup.keep_one(docs(spark, rows)).columns == docs(spark, rows).columns


def test_fuzzy_lines(spark):
    a, b = "The quick brown fox jumps over the lazy dog near the river bank today", "Another quite different line that says something else entirely here"
    near = a.replace("today", "todayy")
    rows = [(1, f"{a}\n\nunique one"), (2, f"{near}\n{b}"), (3, f"  {b.upper()} "), (4, None), (5, ""), (None, "null id line that nobody repeats")]
    got = {r["doc_id"]: r["text"] for r in linededup.without_duplicates(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: b, 3: "", 4: None, 5: "", None: rows[5][1]}
    assert {r["doc_id"] for r in linededup.clean(docs(spark, rows)).collect()} == {1, 2, 4, 5, None}
    assert linededup.report(docs(spark, [])).count() == 0


def brute_lines(rows, size=7, percent=80):
    """Texts without the lines that repeat, nearly, an earlier one: all lines against all."""
    def form(x):
        return re.sub(r"[ \t\r\x0b\f]+", " ", x).strip(" ").lower()

    places = sorted({(d, t) for d, t in rows if t}, key=lambda r: (r[0] is not None, r[0]))
    lines = [(form(x), d, t, i) for d, t in places for i, x in enumerate(t.split("\n")) if form(x)]
    forms = list(dict.fromkeys(x[0] for x in lines))
    sets = {x: {x[i : i + size] for i in range(max(1, len(x) - size + 1))} for x in forms}
    top = {x: x for x in forms}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, x in enumerate(forms):
        for y in forms[:i]:
            if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)), key=forms.index)
                top[b] = a
    first, gone = {}, set()
    for x, d, t, i in lines:
        if first.setdefault(root(x), (d, t, i)) != (d, t, i):
            gone.add((d, t, i))
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone) for d, t in rows}


def line_rows(rng):
    """Chains of lines that change a letter at a time, of which ends aren't alike, exact and hot repeats, short and very long lines."""
    def change(x):
        i = rng.randrange(len(x))
        return x[:i] + rng.choice("abcdefgh ") + x[i + 1 :]

    base, rows = [words(rng, rng.randint(3, 16)) for _ in range(12)], []
    for d in range(90):
        lines = []
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(base))
            base[i] = change(base[i]) if rng.random() < 0.7 else base[i]
            lines.append(base[i])
        lines += rng.sample(["The same line in very many documents", "  the SAME  line in very\tmany documents ", "ab", "", " ", f"row {d}"], 2)
        rows.append((d, "\n".join(lines)))
    rows += [(200, words(rng, 30_000)), (201, None), (202, ""), (None, "a line under no id\n" + base[0]), (3, rows[3][1]), (4, "another text under this id\n" + base[1])]
    return rows


@pytest.mark.parametrize("tight", [False, True])
def test_lines_against_all_pairs(spark, monkeypatch, tight):
    """tight: every bucket counts as large, blocks are small, nothing is broadcast, no estimate is made."""
    if tight:
        for name, n in (("HOT", 2), ("LARGE", 2), ("BLOCK", 8), ("PACK", 16), ("SORTED", 500), ("REDUCED", 500), ("ROUND", 7), ("SOME", 5), ("ELEMENTS", 300), ("BYTES", 300), ("AT_ONCE", 20)):
            monkeypatch.setattr(similar, name, n)
        monkeypatch.setattr(linededup, "LETTERS", 400)
        monkeypatch.setattr(linededup, "HASHED", 90)
        monkeypatch.setattr(common, "is_small", lambda *_: False)
    rows = line_rows(random.Random(12 + tight))
    found = linededup.duplicate_lines(docs(spark, rows).select("doc_id", "text"), slack=None if tight else similar.SLACK)
    got = {(r["doc_id"], r["version"]): set(r["gone"]) for r in found.collect()}
    versions = {(r["doc_id"], r["text"]): r["v"] for r in docs(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("v")).collect()}
    want = brute_lines(rows)
    for (d, t), left in want.items():
        gone = got.get((d, versions[d, t]), set())
        assert left == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    assert sum(map(len, got.values())) > 100


def test_clashing_names(spark):
    """Columns of docs with the names that operators use themselves."""
    names = ["doc_id", "text", "n_lines", "n_kept", "gone", "_row", "_text", "_words", "_lines", "_stats", "_own", "_id", "_version", "_bad_id", "key", "a.b"]
    rows = [(1, "The same line of text here.\nOne more line."), (2, "the same line of text here."), (3, None), (2, "the same line of text here.")]
    df = spark.createDataFrame([(*r, *range(len(names) - 2)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names[2:]))
    bench = spark.createDataFrame([(1, "one more line")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for got in (linededup.clean(df), quality.keep_good(df, labels), neardup.keep_one(df), decontam.keep_clean(df, bench)):
        assert got.columns == names and all(list(r)[2:] == list(range(len(names) - 2)) for r in got.collect())
    assert sorted((r["doc_id"], r["text"]) for r in linededup.clean(df).collect() if r["text"]) == [(1, rows[0][1])]
    assert sorted(r["doc_id"] for r in decontam.keep_clean(df, bench).collect()) == [2, 2, 3]
    out = linededup.without_duplicates(df).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_kept"], r["gone"]) for r in out) == [(1, 2, 2, 2), (2, 1, 0, 2), (2, 1, 0, 2), (3, 0, 0, 2)]


def test_lines_that_differ_in_inner_blanks(spark):
    a = "The quick brown fox jumps over the lazy dog near the river bank today"
    wide = a.replace(" ", "   ")
    rows = [(1, a), (2, f"{wide}\nits own line"), (3, a.replace(" ", "\t")), (4, a.replace(" ", " \t ", 3).replace("river ", "river  \f") + "\t\r"), (5, f"Table\tof   values\n{wide}"), (6, "table of values")]
    got = {r["doc_id"]: r["text"] for r in linededup.without_duplicates(docs(spark, rows)).collect()}
    assert got == {1: a, 2: "its own line", 3: "", 4: "", 5: "Table\tof   values", 6: ""}


def test_lines_at_the_threshold_share_a_band():
    """4,000 pairs of sets of exactly 0.8 Jaccard similarity: 72 of 90 numbers are in both."""
    rng = np.random.default_rng(6)
    a, b = similar.signature_tables(linededup.BANDS * linededup.ROWS, linededup.SEED)

    def keys(s):
        return similar.band_keys(similar.short_form(similar.extremes(s, a, b, largest=False)), linededup.ROWS)

    missed = 0
    for _ in range(4000):
        s = rng.integers(0, 2**64, 90, dtype=np.uint64)
        missed += not (keys(s[:81]) == keys(s[9:])).any()
    assert missed == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (None, [1.0] * 8), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=10, recall=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    d, hits = x.astype(np.float64), 0
    for q in range(0, 900, 50):
        s = d @ d[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert all(abs(s[i] - v) < 1e-9 for i, v in got[q].values())
        hits += len(set(order) & {i for i, _ in got[q].values()})
    assert hits >= 0.9 * 180
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_with_several_parts(spark):
    """Clustered vectors, of which a query probes a few parts: recall against brute force, below certainty."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 700)] * 2 + rng.normal(size=(700, 16))).astype(np.float32)
    router = ann.fit(x.astype(np.float64), len(x), 20)
    assert len(router.b2) == ann.FEWEST and 1 <= router.probes < len(router.b2)
    df, d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), x.astype(np.float64)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert abs(d[r["query_id"]] @ d[r["vec_id"]] - r["score"]) < 1e-9
    hits = sum(len(got[q] & set([i for i in np.argsort(-(d @ d[q]), kind="stable") if i != q][:20])) for q in range(0, 700, 20))
    assert all(len(v) == 20 for v in got.values()) and hits >= 0.9 * 20 * 35


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (100, 4)) for c in (1, -1, 3, -3)])
    part = ann.balanced_parts(x, ann.neighbours(x, np.arange(400), 5), 4, rng)
    assert np.bincount(part, minlength=4).max() <= 110


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there, how does the engine work?\nSecond line."),
        (1, 1, "assistant", "It works by burning fuel slowly.\n\nThat is the whole story."),
        (1, 2, "user", "> Hello there, how does the  ENGINE work?\nI ask again."),
        (1, 3, "user", "On Monday X wrote:\n>> Hello there, how does the engine work?\n> It works by burning fuel slowly.\nWhy slowly?"),
        (2, 0, "user", "> That is the whole story.\nFrom another conversation."),
        (2, 1, None, None),
        (None, 0, "user", ""),
        (2, 1, "user", "x > y is not a quote"),
    ]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["position"]): r for r in got}
    assert len(by) == 8
    assert (by[1, 1]["turn"], by[1, 1]["parent_turn"], by[1, 1]["text"]) == (2, 0, "I ask again.")
    assert (by[1, 3]["turn"], by[1, 3]["thread"], by[1, 3]["text"]) == (3, 1, "Why slowly?")
    assert (by[2, 0]["parent_conv"], by[2, 0]["parent_turn"]) == (1, 1)
    assert [by[2, i]["text"] for i in (1, 2)] == ["", "x > y is not a quote"]


TURNS = "conv_id long, turn long, role string, text string"


def parents(spark, rows):
    got = quotes.conversations(spark.createDataFrame(rows, TURNS)).collect()
    return {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in got}


def test_quotes_go_to_the_message_that_shares_most(spark):
    rows = [
        (5, 0, "user", "A passage that two conversations share."),
        (6, 0, "user", "> A passage that two conversations share.\nAsked in another one."),
        (6, 1, "user", "A passage that two conversations share."),
        (4, 0, "user", "> Quoted before it is said.\nx"),
        (4, 1, "user", "Quoted before it is said."),
        (9, 7, "user", "Quoted before it is said."),
        (7, 0, "user", "Regards, the whole team of the workshop\nshort line one"),
        (7, 1, "assistant", "The carburettor leaks.\nRegards, the whole team of the workshop"),
        (7, 2, "user", "> The carburettor leaks.\n> Regards, the whole team of the workshop\nWhere?"),
        (8, 0, "user", "Is it done yet, please?"),
        (8, 1, "user", "Is it done yet, please?"),
        (8, 2, "assistant", "> Is it done yet, please?\nYes."),
    ]
    got = parents(spark, rows)
    assert got[6, 0] == (5, 0) and got[4, 0] == (9, 7)  # its own conversation's owner comes later, so another's counts
    assert got[7, 2] == (7, 1)  # both passages against one
    assert got[8, 2] == (8, 1)  # the latest


def test_short_and_deeper_quotes(spark):
    rows = [
        (1, 0, "user", "Thanks!"),
        (1, 1, "user", "ok"),
        (1, 2, "user", "> Thanks!\nWelcome."),
        (1, 3, "user", "> ok\nGood."),
        (2, 0, "user", "> Thanks!\nShort ones are no links across conversations."),
        (3, 0, "user", "The original statement of it all."),
        (3, 1, "user", "yes"),
        (3, 2, "user", ">> The original statement of it all.\nBare."),
        (3, 3, "user", "> Somebody's words that are in no table.\n>> The original statement of it all.\nBelow."),
        (3, 4, "user", "> yes\n>> The original statement of it all.\nFirst level first."),
        (4, 0, "user", "yes"),
        (4, 1, "user", "> yes\n>> ok\n> The original statement of it all.\nA long one elsewhere before a short one here."),
    ]
    got = quotes.conversations(spark.createDataFrame(rows, TURNS)).collect()
    by = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"], r["n_quotes"]) for r in got}
    assert by[1, 2] == (1, 0, 1) and by[1, 3] == (1, 1, 1)
    assert by[2, 0] == (None, None, 1)
    assert by[3, 2] == (3, 0, 1) and by[3, 3] == (3, 0, 2) and by[3, 4] == (3, 1, 2)
    assert by[4, 1] == (3, 0, 3)
    assert {(r["conv_id"], r["turn"]): r["thread"] for r in got}[3, 2] == 0


def test_quotes_of_common_passages(spark):
    """A passage with more owners than RARE, alone and with others, against brute force."""
    rng, rows, sign = random.Random(11), [], ["Kind regards from all of us", "Sent from the old machine", "This mail may be secret"]
    for c in range(4):
        said = []
        for t in range(60):
            lines = [f"Message {rng.randrange(25)} says something new"] + rng.sample(sign, rng.randint(0, 3))
            quoted = rng.sample(rng.choice(said or [lines]), 1) + rng.sample(sign, rng.randint(0, 2)) if t % 2 else []
            said.append(lines)
            rows.append((c, t, "user", "\n".join([f"> {x}\n" for x in dict.fromkeys(quoted)] + lines)))
    got = parents(spark, rows)

    def own(text):
        return {x.lower() for x in text.split("\n") if x and x[0] != ">"}

    for c, t, _, text in rows:
        q = {x[2:].lower() for x in text.split("\n") if x.startswith(">")}
        scores = [(sum(map(len, q & own(x))), u) for d, u, _, x in rows if d == c and u < t]
        best = max([x for x in scores if x[0]], default=None)
        if best:
            assert got[c, t] == (c, best[1])
        else:
            far = min([(-sum(map(len, q & own(x))), d, u) for d, u, _, x in rows if d != c], default=None)
            assert got[c, t] == ((far[1], far[2]) if far[0] else (None, None))


def labelled(spark, label):
    rng, rows, labels = random.Random(9), [], []
    for i in range(600):
        bad = i % 3 == 0
        t = words(rng, rng.randint(20, 60))
        if label == "toxic":
            t += f" {rng.choice(['sc0undrel', 'Scoundrel', 'sсoundrel'])} " * bad + words(rng, 5)
        elif bad:
            t = t.upper() + "!!!"
        rows.append((i, t))
        labels.append((i, int(bad if label == "toxic" else not bad)))
    return docs(spark, [*rows, (1000, None), (1001, ""), (None, "x")]), spark.createDataFrame([*labels, (3, None), (None, 1)], f"doc_id long, {label} int"), dict(labels)


@pytest.mark.parametrize(("label", "classify"), [("toxic", toxicity.classify), ("quality", quality.classify)])
def test_classifiers_on_held_out_rows(spark, label, classify):
    df, labels, truth = labelled(spark, label)
    got = classify(df, labels).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert classify(df.limit(0), labels).count() == 0
    assert classify(df, labels.limit(0)).count() == 603


def test_folding():
    assert toxicity.fold("1D10T Straße ÉTÉ") == toxicity.fold("idiot strasse ete")
    assert toxicity.Matcher((" ciown ",), ("ciown fish",)).hits(toxicity.fold("clown fish, a clown")) == [(14, 0)]


def test_matches_equal_a_naive_search():
    rng = random.Random(13)
    for _ in range(300):
        entries = tuple({rng.choice([f" {w} ", f" {w}"]) for w in ("ab", "abc", "b", "ba", "cab", "c") if rng.random() < 0.6})
        phrases = tuple({" ".join(rng.choice(["ab", "abc", "b", "c"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 4))})
        text = " " + " ".join(rng.choice(["ab", "abc", "b", "ba", "cab", "c", "abca"]) for _ in range(rng.randint(0, 25))) + " "
        spans = [(i, i + len(p) + 1) for p in phrases for i in range(len(text)) if text.startswith(f" {p} ", i)]
        want = []
        for i in range(len(text)):
            found = max(((len(e), k) for k, e in enumerate(entries) if text.startswith(e, i)), default=None)
            if found and not any(a <= i and i + found[0] - 1 <= b for a, b in spans):
                want.append((i, found[1]))
        assert sorted(toxicity.Matcher(entries, phrases).hits(text)) == want


def test_words_that_go_along_are_not_entries():
    entries = [" bad ", " mild ", " rare ", " lo", " copy "]
    found = [[0, 4]] * 10 + [[0]] * 40 + [[1]] * 40 + [[2]] * 3 + [[3]] * 6 + [[4]]
    y = [1] * 50 + [1, 0] * 20 + [1] * 3 + [1] * 6 + [1]
    assert toxicity.covering(entries, found, y, 3.0) == [" bad ", " lo"]


def test_benign_sentences(spark):
    """Words that begin like those of the lexicon don't count."""
    df, labels, _ = labelled(spark, "toxic")
    benign = ["We scout the scoured path.", "A sunny day at the lake.", "scoundre", ""]
    lexicon = toxicity.fit(df, labels)
    got = toxicity.scored(spark.createDataFrame([(t,) for t in [*benign, "You sc0undrel of a word"]], "text string"), lexicon).collect()
    assert [r["score"] > 0.5 for r in got] == [False] * len(benign) + [True]
    assert [e for e, _ in lexicon.entries] == [" " + toxicity.fold("scoundrel").strip() + " "]


def test_spans_that_are_added(spark):
    """The classifier sees looks, not votes, and follows the votes where looks tell them apart."""
    secret = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    rows = [(i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" x') for i in range(30)] + [(100 + i, f"row {'0' * 40} in 000-00-0000 and {i}") for i in range(30)]
    rows += [(200, f'key "{secret}"'), (201, "call (030) 123-4567"), (202, None), (203, "call " + "0" * 100_000)]
    got = {r["doc_id"]: r for r in pii.report(docs(spark, rows)).collect()}
    assert all(got[i]["n_added"] == 1 and got[i]["spans"] == "secret:9:49" for i in range(30))
    assert all("secret" not in got[100 + i]["spans"] for i in range(30))
    assert got[200]["spans"] == "secret:5:45" and got[202]["n_added"] == 0
    for t, n in (("abc 1234", 4), ("x", 1), ("=\"q\"", 1)):
        assert len(pii.looks(t, t, 0, len(t))) == len(pii.LOOKS) and all(v < m for v, m in zip(pii.looks(t, t, 0, n), pii.LOOKS, strict=True))


def test_ascending():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    close = np.repeat(x[:50], 40) ^ np.tile(np.arange(40, dtype=np.uint64), 50)  # only low bits tell these apart
    for values in (x[:0], x[:1], x, np.repeat(x, 3), rng.permutation(np.concatenate([x, close]))):
        order = similar._ascending(values)
        assert sorted(order.tolist()) == list(range(len(values)))
        assert (values[order] == np.sort(values)).all()
