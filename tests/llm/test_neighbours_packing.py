import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import neighbours as N
from tidemark.llm import packing as P
from tidemark.session import read


def brute(vectors, least=0.9, k=10):
    out, near = set(), {}
    for g, p in vectors.toPandas().groupby("grp"):
        raw, ok = N.usable(p["vec"])
        x = raw.astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys = p["key"].to_numpy()[ok]
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i in range(len(keys)):
            order = sorted(range(len(keys)), key=lambda j: (-round(s[i, j], 9), keys[j]))[:k]
            near[g, keys[i]] = {keys[j] for j in order}
            out |= {(g, min(keys[i], keys[j]), max(keys[i], keys[j])) for j in order if s[i, j] >= least}
    return out, near


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return N.tables(read(spark, d, "chunks").withColumn("key", F.lit(0)), read(spark, d, "vectors")).cache()


def test_close_pairs(spark, tables):
    got = {(r["grp"], r["key_a"], r["key_b"]) for r in N.close_pairs(tables).collect()}
    want, _ = brute(tables)
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_recall_of_a_stated_query_set(spark, tables):
    queries = F.col("key") % 7 == 0
    got = {}
    for r in N.nearest(tables, queries).collect():
        got.setdefault((r["grp"], r["q"]), set()).add(r["s"])
    _, near = brute(tables)
    want = {k: v for k, v in near.items() if k[1] % 7 == 0}
    assert sum(len(v & got.get(k, set())) for k, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_hot_group_of_copies_and_hot_cells(spark, monkeypatch):
    """A third of all rows are one vector; cells are small enough to be cut, and blocks to meet."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[:300] = x[0]
    x[300:320] = x[300] + 0.05 * rng.normal(size=(20, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = N.plain(spark.createDataFrame(rows, "key bigint, vec array<float>"), [F.lit("t")], "key", "vec")
    want, _ = brute(df)
    monkeypatch.setattr(N, "HOT", 8)
    monkeypatch.setattr(N, "STORED_BLOCK", 7)
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    got = {(r["grp"], r["key_a"], r["key_b"]) for r in N.close_pairs(df).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)


def test_hot_group_of_noisy_copies(spark, monkeypatch):
    """A third of all rows are near-copies of one template, nearer to each other than their codes tell."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1800, 32))
    x[:600] = x[0] + 0.01 * rng.normal(size=(600, 32))
    df = N.plain(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, vec array<float>"), [F.lit("t")], "key", "vec")
    want, _ = brute(df)
    for hot, block in ((N.HOT, N.STORED_BLOCK), (70, 150)):
        monkeypatch.setattr(N, "POOL", 20)
        monkeypatch.setattr(N, "HOT", hot)
        monkeypatch.setattr(N, "STORED_BLOCK", block)
        monkeypatch.setattr(N.candidates, "__defaults__", (20,))
        got = {(r["grp"], r["key_a"], r["key_b"]) for r in N.close_pairs(df).collect()}
        assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_size_of_a_cell_changes_nothing(spark, tables, monkeypatch):
    """What meets is the same whether a cell is one block or many."""
    filed, handle = N.encode(tables)
    pairs = lambda: {(r["grp"], r["q"], r["s"]) for r in N.candidates(filed, handle, None, 0.9).collect()}
    want = pairs()
    monkeypatch.setattr(N, "HOT", 8)
    monkeypatch.setattr(N, "STORED_BLOCK", 50)
    monkeypatch.setattr(N, "QUERY_BLOCK", 20)
    assert want and pairs() == want


def test_vector_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, 0.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [float("nan")] * 4), (8, [float("inf"), 0.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "key bigint, vec array<float>")
    p = N.plain(df, [F.lit("t")], "key", "vec")
    assert [(r["key_a"], r["key_b"]) for r in N.close_pairs(p).collect()] == [(4, 5)]
    assert N.close_pairs(N.plain(df.limit(0), [F.lit("t")], "key", "vec")).count() == 0
    e = spark.createDataFrame([], "doc_id bigint, ordinal bigint, model string, vec array<float>")
    assert N.found(e, e).count() == 0


def test_codes_get_closer_with_each_stage():
    x = np.random.default_rng(0).normal(size=(600, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors = []
    for stages in (1, 3, 6):
        q = N.Quantiser(x, stages, 32, words=32)
        word, codes, norms, fit = q.encode(x, 4)
        total = q.books[0][word] + sum(c[codes[:, m]] for m, c in enumerate(q.books[1:]))
        assert np.allclose(fit, (x * total).sum(1) / norms, atol=1e-4)
        assert np.allclose(q.scores(x[:9], word, codes), total @ x[:9].T, atol=1e-4)
        assert np.allclose(norms, np.linalg.norm(total, axis=1), atol=1e-4)
        errors.append(((x - total) ** 2).sum())
    assert errors[0] > errors[1] > errors[2]


def test_no_pair_above_the_threshold_is_below_the_bound():
    """The bound holds for every pair, however badly the code stands for the vector."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24))
    y = x + rng.uniform(0, 0.25, size=(400, 1)) * rng.normal(size=x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    code = x + rng.uniform(0, 0.5, size=(400, 1)) * rng.normal(size=x.shape)
    code /= np.linalg.norm(code, axis=1, keepdims=True)
    for least in (0.5, 0.9, 1.0):
        close = (x * y).sum(1) >= least
        assert ((y * code).sum(1) >= N.bound(least, (x * code).sum(1)))[close].all()


def test_more_groups_than_go_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(g * 100 + i, f"m{g}", [float(v) for v in r]) for g in range(5) for i, r in enumerate(np.repeat(rng.normal(size=(6, 8)), 2, axis=0))]
    df = N.plain(spark.createDataFrame(rows, "key bigint, model string, vec array<float>"), [F.col("model")], "key", "vec")
    monkeypatch.setattr(N, "TOGETHER", 2)
    assert N.close_pairs(df).count() == 30 == len(brute(df)[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from(["a", "b", None]), st.integers(0, 5)), max_size=40), st.integers(1, 2))
def test_best_fit(items, quota):
    sizes, sources, clusters = ([x[k] for x in items] for k in range(3))
    got = P.best_fit(sizes, sources, clusters, [quota] * len(items), 50)
    bins = {}
    for i, b in enumerate(got):
        bins.setdefault(b, []).append(i)
    for b in bins.values():
        assert sum(sizes[i] for i in b) <= 50 and len({clusters[i] for i in b}) == len(b)
        for s in ("a", "b"):
            assert sum(sources[i] == s for i in b) <= quota


def test_best_fit_takes_the_tightest():
    # 30 and 40 open two bins; 10 goes where 10 are left, not where 20 are.
    assert P.best_fit([30, 40, 10], [None] * 3, [1, 2, 3], [1] * 3, 50) == [1, 0, 0]
    assert P.best_fit([30, 40, 10], [None] * 3, [1, 3, 3], [1] * 3, 50) == [1, 0, 1]  # its copy is there: the next tightest


def test_containers(spark, sf):
    docs = read(spark, sf, "documents").withColumn("quota", F.lit(9))
    out = P.containers(docs).cache()
    items = {r["doc_id"]: r["tokens"] for r in P.measure(docs).collect()}
    enc = P.encoding()
    t = {r["doc_id"]: r["text"] for r in docs.filter("text is not null").collect()}
    assert items == {k: len(enc.encode_ordinary(v)) for k, v in t.items()}
    per = {}
    for r in out.collect():
        per.setdefault(r["doc_id"], []).append((r["part"], r["first_token"], r["tokens"]))
    assert per.keys() == items.keys()
    for d, parts in per.items():
        assert sum(p[2] for p in parts) == items[d] and (len(parts) == 1 or items[d] > P.CAPACITY)
        at = 0
        for _, first, n in sorted(parts):
            assert first == at
            at += n
    assert out.groupBy("container_id").agg(F.sum("tokens").alias("t")).filter(F.col("t") > P.CAPACITY).count() == 0
    assert P.fill(out).first()["fill"] > 0.9
    cluster = out.join(P.measure(docs).select("doc_id", "cluster"), "doc_id").filter("tokens < 2048").groupBy("container_id", "cluster").agg(F.count_distinct("doc_id").alias("n"))
    assert cluster.filter("n > 1").count() == 0


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", None), (3, "word " * 5000, "s"), (4, "one", "s"), (4, "one", "s")], "doc_id bigint, text string, source string")
    out = P.containers(df)
    assert sorted((r["doc_id"], r["part"]) for r in out.collect())[:1] == [(2, 0)] and out.filter("doc_id = 4").count() == 2
    assert out.groupBy("container_id").agg(F.sum("tokens").alias("t")).filter("t > 2048").count() == 0
    assert P.containers(df.limit(0)).count() == 0
