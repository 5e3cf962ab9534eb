"""Full-text search: postings, BM25, and the query language (any, all, phrase, advanced, substring).

A query is parsed into leaves (phrases, prefixes, nearness) and a predicate over them. Each leaf is
counted per row by array expressions over the row's words, so one pass over the narrow (id, title, body)
columns scores a query; the collection's statistics come from the same pass, aggregated before any
filter, because they cover every row. `postings` is the stored form for collections that are searched
often: partitioned by a hash of the term, so that a query reads its terms' share only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text

K1, B = 1.2, 0.75
FLOOR = 1e-6
#: Folders of the postings, by a hash of the term.
BUCKETS = 64


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_title": text.tokens(F.col("title")), "_body": text.tokens(F.col("body"))})


@dataclass
class Leaf:
    """A phrase (its last word a prefix if so marked), or phrases near each other; column None, title or body."""

    words: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = ("_title", "_body")
    near: list[list[str]] | None = None
    distance: int = 10

    def hits(self, column: str) -> Column:
        if column not in self.columns or (not self.words and not self.near):
            return F.lit(0)
        if self.near:
            held = _all([F.array_contains(column, w) for p in self.near for w in p])
            return F.when(held, _let(F.col(column), lambda toks: F.when(_near(toks, self.near, self.distance), 1).otherwise(0))).otherwise(0)
        n = len(self.words)
        if n == 1 and not self.first:
            w = self.words[0]
            return F.size(F.filter(F.col(column), lambda t: t.startswith(w) if self.prefix else t == w))
        held = _all([F.array_contains(column, w) for w in (self.words[:-1] if self.prefix else self.words)])
        first = self.first

        def count(toks: Column) -> Column:
            every = F.sequence(F.lit(0), F.greatest(F.size(toks) - n, F.lit(0)))
            return F.when(F.size(toks) >= n, F.size(F.filter(every, lambda i: _at(toks, i, self.words, self.prefix) & ((i == 0) if first else F.lit(True))))).otherwise(0)

        return F.when(held, _let(F.col(column), count)).otherwise(0)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(toks: Column, i: Column, words: list[str], prefix: bool = False) -> Column:
    out = F.lit(True)
    for k, w in enumerate(words):
        t = F.coalesce(F.get(toks, i + k), F.lit(""))
        out = out & (t.startswith(w) if prefix and k == len(words) - 1 else t == w)
    return out


def _near(toks: Column, phrases: list[list[str]], distance: int) -> Column:
    """Whether the phrases all occur with at most `distance` words between the end of the first and the start of the last."""
    every = F.sequence(F.lit(0), F.greatest(F.size(toks) - 1, F.lit(0)))

    def place(phrase: list[str]) -> Column:
        return F.filter(every, lambda i: _at(toks, i, phrase))

    def reached(start: Column, length: int, other: Column) -> Column:
        return F.exists(other, lambda x: (x >= start) & (x - (start + length) <= distance))

    def window(at: Column, k: int) -> Column:
        """Some place of phrase k from which all others are in reach."""
        return F.exists(F.get(at, F.lit(k)), lambda s: _all([reached(s, len(phrases[k]), F.get(at, F.lit(j))) for j in range(len(phrases)) if j != k]))

    return _let(F.array(*[place(p) for p in phrases]), lambda at: _any([window(at, k) for k in range(len(phrases))]))


def _all(xs: list[Column]) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out


class Query:
    """leaves, and a predicate over their hit counts."""

    def __init__(self, leaves: list[Leaf], test, scored: list[int] | None = None):
        self.leaves, self.test = leaves, test
        self.scored = list(range(len(leaves))) if scored is None else scored


def words_of(s: str) -> list[str]:
    import unicodedata

    base = "".join(ch for ch in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(ch))
    return re.findall(r"[^\W_]+", base)


def parse(query: str, mode: str = "any") -> Query | None:
    """None for a query that restricts nothing (empty or *)."""
    if len(query) > 2000:
        raise ValueError("a query has at most 2000 characters")
    if query.strip() in ("", "*"):
        return None
    if mode == "phrase":
        return Query([Leaf(words_of(query.replace('"', " ")))], lambda h: h[0])
    if mode == "advanced":
        return _Parser(query).parse()
    if query.count('"') % 2:
        raise ValueError("a quotation isn't closed")
    parts = [a or b for a, b in re.findall(r'"([^"]*)"|(\S+)', query)]
    leaves = [Leaf(words_of(p)) for p in parts if p.strip()]
    if mode == "all":
        return Query(leaves, lambda h: _all(h))
    if mode == "any":
        return Query(leaves, lambda h: _any(h))
    raise ValueError(f"no such mode: {mode}")


def _any(xs: list[Column]) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x
    return out


class _Parser:
    """word, prefix*, "a phrase", ^first, a + b, NEAR(a b, n), column: or {columns}:, AND, OR, NOT, brackets; words side by side mean AND."""

    def __init__(self, query: str):
        self.toks = re.findall(r'"(?:[^"]|"")*"|[(){}:,*^+]|[^\s(){}:,*^+"]+', query)
        if '"' in re.sub(r'"(?:[^"]|"")*"', "", query):
            raise ValueError("a quotation isn't closed")
        self.at, self.leaves, self.scored = 0, [], []

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want and t != want):
            raise ValueError(f"a query can't have {t or 'its end'} here")
        self.at += 1
        return t

    def parse(self) -> Query:
        test = self.either(("_title", "_body"), True)
        if self.peek():
            raise ValueError(f"a query can't have {self.peek()} here")
        return Query(self.leaves, test, self.scored)

    def either(self, cols, score):
        out = self.both(cols, score)
        while self.peek() == "OR":
            self.take()
            a, b = out, self.both(cols, score)
            out = lambda h, a=a, b=b: a(h) | b(h)
        return out

    def both(self, cols, score):
        out = self.without(cols, score)
        while self.peek() and self.peek() not in ("OR", ")", "NOT"):
            if self.peek() == "AND":
                self.take()
            a, b = out, self.without(cols, score)
            out = lambda h, a=a, b=b: a(h) & b(h)
        return out

    def without(self, cols, score):
        out = self.one(cols, score)
        while self.peek() == "NOT":
            self.take()
            a, b = out, self.one(cols, False)
            out = lambda h, a=a, b=b: a(h) & ~b(h)
        return out

    def one(self, cols, score):
        t = self.peek()
        if t == "(":
            self.take()
            out = self.either(cols, score)
            self.take(")")
            return out
        if t == "{" or (self.at + 1 < len(self.toks) and self.toks[self.at + 1] == ":"):
            names = []
            if t == "{":
                self.take()
                while self.peek() != "}":
                    names.append(self.take())
                self.take()
            else:
                names.append(self.take())
            self.take(":")
            if bad := [n for n in names if n not in ("title", "body")]:
                raise ValueError(f"no such column: {bad[0]}")
            return self.one(tuple("_" + n for n in names), score)
        if t == "NEAR" and self.at + 1 < len(self.toks) and self.toks[self.at + 1] == "(":
            self.at += 2
            phrases, distance = [], 10
            while self.peek() not in (")", ","):
                phrases.append(words_of(self.take().strip('"')))
            if self.peek() == ",":
                self.take()
                distance = int(self.take())
            self.take(")")
            return self.leaf(Leaf([], columns=cols, near=[p for p in phrases if p], distance=distance), score)
        first = t == "^" and bool(self.take())
        words = words_of(self.word())
        while self.peek() == "+":
            self.take()
            words += words_of(self.word())
        prefix = self.peek() == "*" and bool(self.take())
        return self.leaf(Leaf(words, prefix, first, cols), score)

    def word(self) -> str:
        t = self.take()
        if t in ("(", ")", "{", "}", ":", ",", "*", "^", "+", "AND", "OR", "NOT"):
            raise ValueError(f"a query can't have {t} here")
        return t.strip('"')

    def leaf(self, leaf: Leaf, score: bool):
        k = len(self.leaves)
        self.leaves.append(leaf)
        if score:
            self.scored.append(k)
        return lambda h: h[k]


def bm25(docs: DataFrame, query: Query, title_weight: float = 1.0) -> DataFrame:
    """docs that match, with rank: the lower, the better. Statistics cover all of docs, so filter the result, not the input."""
    return bm25_counted(counted(docs, query), query, title_weight).select(*docs.columns, "rank")


def counted(docs: DataFrame, query: Query) -> DataFrame:
    """docs with the hits of every leaf and the length: all that a search needs of the texts."""
    return _counted(with_tokens(docs).withColumn("_len", F.size("_title") + F.size("_body")), query).drop("_title", "_body")


def bm25_counted(hits: DataFrame, query: Query, title_weight: float = 1.0) -> DataFrame:
    """`bm25` of rows that are `counted`. It reads them twice; whoever wants the texts read once keeps their counts."""
    stats = hits.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *_frequencies(query))  # one row
    return _ranked(hits, query, stats, title_weight)


def _counted(rows: DataFrame, query: Query) -> DataFrame:
    for k, leaf in enumerate(query.leaves):
        rows = rows.withColumns({f"_t{k}": leaf.hits("_title"), f"_b{k}": leaf.hits("_body")})
    return rows


def _frequencies(query: Query) -> list[Column]:
    return [F.count_if(F.col(f"_t{k}") + F.col(f"_b{k}") > 0).alias(f"_df{k}") for k in range(len(query.leaves))]


def _ranked(hits: DataFrame, query: Query, stats: DataFrame, title_weight: float) -> DataFrame:
    met = hits.filter(query.test([F.col(f"_t{k}") + F.col(f"_b{k}") > 0 for k in range(len(query.leaves))])).crossJoin(F.broadcast(stats))
    rank = F.lit(0.0)
    for k in query.scored:
        f = F.col(f"_t{k}") * title_weight + F.col(f"_b{k}")
        df = F.col(f"_df{k}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, FLOOR).otherwise(idf)
        rank = rank - F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))).otherwise(0.0)
    return met.withColumn("rank", rank)


def substring(docs: DataFrame, pattern: str, after_id: int | None = None, scan: int | None = None) -> DataFrame:
    """Rows whose title or body matches a glob; with scan, only the next `scan` rows by id are looked at."""
    rows = docs if after_id is None else docs.filter(F.col("id") > after_id)
    if scan is not None:
        rows = rows.orderBy("id").limit(scan)
    rx = text.glob_regex(pattern)
    return rows.filter(F.coalesce(F.col("title"), F.lit("")).rlike(rx) | F.coalesce(F.col("body"), F.lit("")).rlike(rx))


def postings(docs: DataFrame) -> DataFrame:
    """(term, bucket, id, col, tf, places): the stored index; write it partitioned by bucket, a hash of the term."""
    t = with_tokens(docs).select("id", F.explode(F.array(F.struct(F.lit("title").alias("col"), F.col("_title").alias("w")), F.struct(F.lit("body").alias("col"), F.col("_body").alias("w")))).alias("c"))
    rows = t.select("id", F.col("c.col").alias("col"), F.posexplode("c.w").alias("place", "term"))
    out = rows.groupBy("term", "id", "col").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))
    return out.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def update_postings(index: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """The index after some documents changed or went: their postings replaced, all others kept."""
    touched = changed.select("id").unionByName(gone.select("id")).distinct()
    return index.join(touched, "id", "left_anti").unionByName(postings(changed))


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, df, cf) over titles and bodies; counted within each row first."""
    w = with_tokens(docs).select("id", F.explode(F.concat("_title", "_body")).alias("term"))
    return w.groupBy("term", "id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


@dataclass
class Index:
    """A written index: postings by bucket of the term, the length of every row, and one row of statistics (n, avg)."""

    postings: DataFrame
    lengths: DataFrame
    statistics: DataFrame


def write_index(docs: DataFrame, path: str) -> Index:
    """Postings and statistics of all rows, once; searches read the buckets of their words from then on."""
    docs = docs.withColumn("id", F.col("id").cast("bigint"))
    rows = postings(docs)
    rows.repartition("bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    with_tokens(docs).select("id", (F.size("_title") + F.size("_body")).alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")
    spark = docs.sparkSession
    spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("len").alias("avg")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    held = {"postings": "term string, id bigint, col string, tf bigint, places array<int>, bucket int", "lengths": "id bigint, len int", "statistics": "n bigint, avg double"}
    return Index(*(spark.read.schema(of).parquet(f"{path}/{x}") for x, of in held.items()))


def bm25_indexed(index: Index, query: Query, title_weight: float = 1.0) -> DataFrame:
    """(id, rank) as `bm25` gives them, from the postings of the query's own words alone.

    Buckets of other terms are not read (a prefix has to look into all, at its own range of terms). A row's words are laid out
    again at their places, with nothing between them, so that phrases and nearness are told as from the whole text.
    """
    whole, prefixes = set(), set()
    for leaf in query.leaves:
        for p in leaf.near or [leaf.words]:
            whole |= set(p[:-1] if leaf.prefix else p)
            prefixes |= set(p[-1:]) if leaf.prefix else set()
    rows, spark = index.postings, index.postings.sparkSession
    wanted = F.col("term").isin(sorted(whole)) if whole else F.lit(False)
    for p in sorted(prefixes):
        wanted = wanted | F.col("term").startswith(p)
    if not prefixes and whole:
        words = spark.createDataFrame([(w,) for w in sorted(whole)], "term string")
        buckets = sorted({r[0] for r in words.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).collect()})  # as many as the query has words
        rows = rows.filter(F.col("bucket").isin(buckets))
    plain = all(len(x.words) == 1 and not x.first and not x.near for x in query.leaves)
    held = rows.filter(wanted).groupBy("id").agg(F.collect_list(F.struct("col", "term", "tf", "places")).alias("h"))  # one entry per word of the query

    def laid_out(name: str) -> Column:
        mine = F.filter("h", lambda x: x["col"] == name)
        if plain:  # only how often counts
            return F.flatten(F.transform(mine, lambda x: F.array_repeat(x["term"], x["tf"].cast("int"))))
        at = F.map_from_entries(F.flatten(F.transform(mine, lambda x: F.transform(x["places"], lambda p: F.struct(p, x["term"])))))
        last = F.array_max(F.map_keys(at))
        return F.when(last.isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.element_at(at, i), F.lit("")))).otherwise(F.array().cast("array<string>"))

    hits = _counted(held.withColumns({"_title": laid_out("title"), "_body": laid_out("body")}), query).drop("h", "_title", "_body")
    frequencies = hits.agg(*_frequencies(query))
    stats = index.statistics.select(F.col("n").alias("_n"), F.col("avg").alias("_avg")).crossJoin(frequencies)  # one row and one row
    return _ranked(hits.join(index.lengths.withColumnRenamed("len", "_len"), "id"), query, stats, title_weight).select("id", "rank")
