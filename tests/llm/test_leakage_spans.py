import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import leakage as L
from tidemark.llm import spans as S
from tidemark.session import read


def test_words_compare_equal():
    assert L.words("Café STRASSE_x, l'été 12,5") == L.words("café straße x L ÉTÉ 12 5") and L.words(None) == []


def test_fingerprints_do_not_depend_on_blocks(monkeypatch):
    h = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = L.fingerprints(h)
    monkeypatch.setattr(L, "_BLOCK", 101)
    assert (L.fingerprints(h) == whole).all() and len(L.fingerprints(h[:5])) == 0


def test_blocks_miss_nothing_within_the_radius():
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(40))) for i in range(50)]
    for radius in (0, 1, 3):
        index = L.Index(items, radius=radius)
        near = []
        for p in index.prints[:200]:
            for b in rng.sample(range(64), radius):
                p = p ^ np.uint64(1 << b)
            near.append(p)
        place, window = index.candidates(np.array(near, np.uint64))
        assert {(i, i) for i in range(200)} <= set(zip(place.tolist(), window.tolist()))


def brute(docs, items, n=13):
    grams = {}
    for i, t in items:
        w = L.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(i, d) for d, t in docs for w in [L.words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_find_against_brute_force(spark, scale):
    d = f"/root/testdata/{scale}"
    docs, items = read(spark, d, "documents").withColumn("windows", F.lit(1)), read(spark, d, "eval_items")
    got = {(r["item_id"], r["doc_id"]) for r in L.find(docs, items).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_leak_edges(spark, monkeypatch):
    base = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, base), (2, "too short"), (3, None), (4, base), (4, base)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " * 50_000 + base.upper().replace(" ", " -- ")), (2, base[: len("word0 " * 12)]), (3, None), (4, ""), (5, base), (5, base)], "doc_id bigint, text string")
    want = {(1, 1), (4, 1), (1, 5), (4, 5)}
    assert {(r[0], r[1]) for r in L.find(docs, items).collect()} == want
    monkeypatch.setattr(L, "SLICE", 10)  # items in several slices
    assert {(r[0], r[1]) for r in L.find(docs, items).collect()} == want
    assert L.find(docs.limit(0), items).count() == 0 and L.find(docs, items.limit(0)).count() == 0


def test_reworked_windows_against_brute_force(spark, monkeypatch):
    """Every window of weighted similarity 0.8 or more, whichever words were changed."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(30))) for i in range(40)]
    docs = []
    for i, t in items:
        for changes in (0, 1, 2, 3):
            w = t.split()
            for k in rng.sample(range(len(w)), changes):
                w[k] = f"new{rng.randrange(9)}"
            docs.append((len(docs), " ".join(["lead", *w[rng.randrange(8) :], "tail"])))
    index, want = L.Index(items), {}
    for d, t in docs:
        ids = np.array([index.vocabulary.get(x, -1) for x in L.words(t)])
        for p in range(len(ids) - L.SIZE + 1):
            share = index.similarity(ids, np.full(len(index.start), p), np.arange(len(index.start)))
            for i in set(index.owner[share >= 0.8].tolist()):
                want[i, d] = want.get((i, d), 0) + 1
    one = {d for (_, d) in want if d % 4 == 1}
    assert len(one) > 30  # one changed word is within 0.8
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r[0], r[1]): r[2] for r in L.find(*args, similarity=0.8).collect()} == want
    edge = np.cumsum([0] + [len(L.words(t)) for _, t in docs])
    ids = np.array([index.vocabulary.get(x, -1) for _, t in docs for x in L.words(t)])
    signed = L.Index(items, least=0.8)
    whole = {p for a, b in signed.reworked(ids, edge) for p in zip(a.tolist(), b.tolist())}
    monkeypatch.setattr(L, "_PAIRS", 7)
    assert {p for a, b in signed.reworked(ids, edge) for p in zip(a.tolist(), b.tolist())} == whole


def shares(a, b, n=200):
    have = {a[k : k + n] for k in range(len(a) - n + 1)}
    return any(b[k : k + n] in have for k in range(len(b) - n + 1))


@pytest.mark.parametrize("seed", range(6))
def test_every_run_of_200_holds_a_whole_chunk(seed):
    r = random.Random(seed)
    alphabet = ["abcdefgh ", "a", "ab", "aé😀 \n", "0123456789abcdef", "xyz"][seed]
    t = "".join(r.choice(alphabet) for _ in range(3000))
    s, e, d = S.chunks(t, 200)
    for at in range(0, len(t) - 200):
        assert ((s >= at) & (e <= at + 200)).any(), at
    moved = S.chunks("## inserted " + t, 200)
    assert len(set(d.tolist()) - set(moved[2].tolist())) <= 12  # only what is near the insertion changes


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    r = random.Random(3)
    t = "".join(r.choice("abcdef ") for _ in range(5000))
    whole = set(zip(*[x.tolist() for x in S.chunks(t, 200)]))
    monkeypatch.setattr(S, "_CHUNK", 1200)
    assert whole - set(zip(*[x.tolist() for x in S.chunks(t, 200)])) == set()


def test_pairs_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents").withColumn("rep", F.lit(1))
    pairs, copies = S.shared_pairs(docs)
    got = {tuple(r) for r in S.expand_copies(pairs, copies).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.filter("length(text) >= 200").collect()]
    grams = {}
    for i, t in texts:
        for k in range(len(t) - 199):
            grams.setdefault(hash(t[k : k + 200]), set()).add(i)
    assert got == {(a, b) for g in grams.values() if len(g) > 1 for a in g for b in g if a < b}


def test_extent_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").filter("doc_id <= 400")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    where = {}
    for i, t in texts.items():
        for k in range(len(t) - 199):
            where.setdefault(hash(t[k : k + 200]), set()).add(i)
    for r in S.shared_extent(docs).collect():
        t = texts[r["doc_id"]]
        inside = set()
        for k in range(len(t) - 199):
            if len(where[hash(t[k : k + 200])]) > 1:
                inside.update(range(k, k + 200))
        assert r["shared_chars"] == len(inside), r


def test_span_edges(spark):
    r = random.Random(5)
    body = "".join(r.choice("abcdefghij ") for _ in range(400))
    other = "".join(r.choice("klmnop ") for _ in range(300))
    rows = [(1, body), (2, body), (3, "zz" + body[100:300] + other), (4, "zz" + body[100:299] + other[::-1]), (5, None), (6, ""), (7, "short"), (8, "short"), (9, "a" * 30_000), (10, "b" + "a" * 250), (2, body)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs, copies = S.shared_pairs(docs)
    assert {tuple(x) for x in S.expand_copies(pairs, copies).collect()} == {(1, 2), (1, 3), (2, 3), (3, 4), (9, 10)}  # 3 and 4 share 201 characters, their beginnings
    got = {x["doc_id"]: (x["class_id"], x["copies"], x["shared_chars"], x["n_chars"]) for x in S.shared_extent(docs.dropDuplicates(["doc_id"])).collect()}
    assert got[1] == (1, 2, 400, 400) and got[3][2] == 202 and got[4][2] == 201 and got[10][2:] == (250, 251) and got[5] == (5, 1, 0, 0)
    e = S.shared_pairs(docs.limit(0))
    assert S.expand_copies(*e).count() == 0
    with pytest.raises(ValueError):
        S.shared_pairs(docs, least=100)


def test_chunk_that_many_records_hold(spark, monkeypatch):
    """Boilerplate shorter than the least span pairs nobody; a longer one pairs all, whichever way they are found."""
    import random

    from tidemark.llm import spans as S

    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, long = noise(190), noise(230)
    rows = [(i, noise(300) + (short if i % 2 else long) + noise(300)) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(a, b) for a in range(0, 40, 2) for b in range(a + 2, 40, 2)}
    for few in (16, 1000):
        monkeypatch.setattr(S, "FEW", few)
        pairs, copies = S.shared_pairs(docs)
        assert {(x["a"], x["b"]) for x in pairs.collect()} == want
    got = {}
    for x in S.spans_of_all(docs).collect():
        got.setdefault((x["doc_id"], x["class_id"]), []).append((x["start"], x["end"]))
    text = dict(rows)
    assert got.pop((100, 0)) == got.pop((101, 0)) == got.pop((0, 0)) == [(0, len(text[0]))]
    assert set(got) == {(i, i) for i in range(2, 40, 2)} and all(long in text[i][s:e] and e - s <= 240 for (i, _), [(s, e)] in got.items())
