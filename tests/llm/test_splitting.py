import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import splitting as S
from tidemark.session import read


def text(seed, n):
    r = random.Random(seed)
    out = ""
    while len(out) < n:
        out += r.choice(["word", "é😀", "x" * 40, "# Head", "- item"]) + r.choice([" ", " ", " ", "\t", "\n", "\n\n", "\r\n\r\n"] if seed % 3 else [" ", ""])
    return out[:n]


@pytest.mark.parametrize("seed", range(9))
def test_pieces_hold_the_rules(seed):
    t = text(seed, 30_000 if seed else 5000)
    got = S.pieces(t)
    assert got[0][0] == 0 and got[-1][1] == len(t)
    assert t == t[: got[0][1]] + "".join(t[a[1] : b[1]] for a, b in zip(got, got[1:]))
    for (a, b), (c, _) in zip(got, got[1:]):
        assert c == b - 256 and a + 1500 < b <= a + 2048
        ends = range(a + 1501, a + 2049)
        for level in (lambda p: t[p - 2 : p] == "\n\n", lambda p: t[p - 1] == "\n", lambda p: t[p - 1] in " \t\n"):
            if any(level(p) for p in ends):
                assert level(b)
                break


def test_whole_sections_are_preferred():
    t = "a" * 1600 + "\n\n# One\n" + "b" * 200 + "\n\n" + "c" * 3000
    assert S.Tree(t).meets(1500, 2048) == (S.BLANK, 1602)  # before the heading, though a later paragraph would fit


def test_own_cut_passes_the_audit(spark, sf):
    docs = read(spark, sf, "docs").select("id", "body", F.lit("x").alias("w"), F.lit(1).alias("last"))
    mine = S.split(docs, "id", "body").withColumnRenamed("id", "doc_id").withColumn("project", F.lit(None).cast("string"))
    assert mine.count() >= docs.filter("length(body) > 0").count() and S.audit(mine, docs).count() == 0


def test_audit_against_brute_force(spark):
    t = text(1, 6000)
    good = S.pieces(t)
    rows, bodies, want = [], [(0, None), (1, ""), (2, "q" * 3000), (3, "short")], {(2, -1)}
    for k, broken in enumerate([None, (0, 1, 0), (1, 0, -1), (1, 0, 1), (2, 1, 0), (len(good) - 1, 0, -1)], 10):
        bodies.append((k, t))
        p = [list(x) for x in good]
        if broken:
            i, ds, de = broken
            p[i][0] += ds
            p[i][1] += de
        rows += [("p", k, i, a, b) for i, (a, b) in enumerate(p)]
        for i, (a, b) in enumerate(p):
            bad = b <= a or b - a > 2048 or b > len(t) or (a != 0 if i == 0 else a != p[i - 1][1] - 256)
            if i == len(p) - 1:
                bad |= b != len(t)
            else:
                for level in (lambda x: t[x - 2 : x] == "\n\n", lambda x: t[x - 1] == "\n", lambda x: t[x - 1] in " \t\n"):
                    ends = [x for x in range(a + 1501, min(a + 2048, len(t)) + 1) if level(x)]
                    if ends:
                        bad |= b not in ends
                        break
            if bad:
                want.add((k, i))
    rows += [("p", 99, 0, 0, 5), ("p", 3, 1, 0, 5), ("p", 3, 1, 0, 5), ("p", 0, 0, None, None)]
    want |= {(99, 0), (3, 1), (0, 0)}
    c = spark.createDataFrame(rows, "project string, doc_id bigint, ordinal bigint, start_offset bigint, end_offset bigint")
    d = spark.createDataFrame(bodies, "id bigint, body string")
    assert {tuple(r) for r in S.audit(c, d).collect()} == want
    assert {tuple(r) for r in S.audit(c.limit(0), d.filter("id < 4")).collect()} == {(2, -1)}


def test_no_boundary_and_bad_limits(spark):
    assert S.pieces("x" * 5000) == [(0, 2048), (1792, 3840), (3584, 5000)] and S.pieces("") == []
    with pytest.raises(ValueError):
        S.split(spark.createDataFrame([], "id bigint, body string"), "id", "body", limit=100)
    assert S.split(spark.createDataFrame([(1, None), (None, "x")], "id bigint, body string"), "id", "body").count() == 0


def test_the_tree_of_headings_lists_and_fences():
    t = "# A\n\nintro\n\n## B\n- one\n  - two\n- three\n\n```\n# no heading\n\ncode\n```\n\n# C\nend"
    tree = S.Tree(t)
    depth = {t[e:].split("\n")[0]: r for e, r in zip(tree.ends, tree.ranks)}
    assert depth["# C"] < depth["## B"] < depth["intro"] and depth["# C"][1] == 1 and depth["## B"][1] == 2
    assert depth["- three"] < depth["  - two"] < depth["# no heading"] and depth["code"][1] == depth["# no heading"][1] == 15
    assert tree.meets(0, len(t)) == (S.BLANK, t.index("# C")) and tree.meets(t.index("# no"), t.index("code") + 3) == (S.BLANK, t.index("code"))
    # A heading after a single line feed is a line end, but the best of those; a line feed at the very end of reach counts.
    t = "x" * 1600 + "\n# H\n" + "y" * 100 + "\n" + "z" * 3000
    assert S.Tree(t).meets(1500, 2048) == (S.LINE, 1601) and S.Tree("ab\n").meets(0, 3) == (S.LINE, 3) and S.Tree("a\n\n").meets(1, 3) == (S.BLANK, 3)
    assert S.Tree("ab\r\n\r\ncd").meets(0, 8) == (S.LINE, 6) and S.Tree("ab cd").meets(0, 5) == (S.SPACE, 3) and S.Tree("").meets(0, 0) == (S.NONE, 0)
