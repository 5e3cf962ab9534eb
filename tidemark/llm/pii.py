"""Personal information in free text: places, and text with typed placeholders (problem 4).

A linear-chain conditional random field over word shapes: a text is cut into words, numbers and signs;
each has a few features (shape, ending, sign, frequent word, word of the training sentences, roster membership, space before it),
and the score of a label is the sum of the weights of the features from three tokens before to three
after. Weights are fitted to the labelled table of `pii_examples` by maximum likelihood (forward and
backward sums over padded batches, AdaGrad). Texts are decoded by Viterbi in numpy, many stretches of a
fixed length at a time; the scores of a word are worked out once per batch and looked up from then on.

A check of the decoded spans follows (an email has its two signs and no space before them, a phone enough digits, an
item begins and ends with a word, and so on).

Defined cases: null and empty texts have no items and stay as they are; very long texts are decoded in
overlapping stretches; repeated rows give repeated items, of which `items` keeps one; positions are code
points. The roster (given and family names) may be empty; beyond MAX_ROSTER rows it is refused.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii_examples

TYPES = {"E": "email", "P": "phone", "I": "id_number", "A": "address", "N": "name"}
LABELS = ["O"] + [b + t for t in TYPES for b in "BI"]
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
REACH, SLOTS = 3, 6
MAX_ROSTER = 100_000
_TOKEN = re.compile(r"[0-9A-Za-z+/=]{48,}|[^\W\d_]+|\d+|[^\w\s]|_")
_CLOSED = frozenset(pii_examples.CLOSED)
_STRETCH, _OVERLAP, _BLOCK = 96, 16, 48_000


def shape(w: str) -> str:
    if w[0].isdigit():
        return f"d{min(len(w), 12)}"
    if len(w) >= 48:
        return "blob"
    if not w[0].isalpha():
        return w
    if len(w) == 1:
        return "X" if w.isupper() else "x"
    return "XX" if w.isupper() else "Xx" if w[0].isupper() and w[1:].islower() else "xx" if w.islower() else "xX"


def features(w: str, known: set[str], given: set[str], family: set[str]) -> list[str]:
    s, low = shape(w), w.lower()
    out = ["s=" + s]
    if s[0] in "Xx":
        if low in _CLOSED:
            out.append(f"c={s}")
        elif low in known:
            out.append("w=" + low)
            out.append(f"k={s}")
        elif len(w) > 2:
            out.append("u=" + s)
            out.append("e=" + low[-4:])
        roster = (low in given) + 2 * (low in family)
        out.append(f"r={roster}")
        out.append(f"n={min(len(w), 6)}")
    elif s[0] == "d":
        out.append("d" + ("0" if w[0] == "0" else "9" if w[0] == "9" else "+"))
    return out


def tokens(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    spans = np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)
    return _TOKEN.findall(text), spans[:, 0], spans[:, 1]


def _gaps(text: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """0 no space before the token, 1 space, 2 line break."""
    gap = np.ones(len(start), np.int64)
    if len(start):
        gap[1:][start[1:] == end[:-1]] = 0
        for k in np.flatnonzero(gap):
            if "\n" in text[(end[k - 1] if k else 0) : start[k]]:
                gap[k] = 2
    return gap


class Field:
    """The trained weights: a row of labels per (offset, feature), per (offset, gap), and transitions."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray, gaps: np.ndarray, moves: np.ndarray, known: set[str]):
        self.ids, self.weights, self.gaps, self.moves, self.known = ids, weights, gaps, moves, known

    def scorer(self, given: set[str], family: set[str]) -> Scorer:
        return Scorer(self, given, family)


class Scorer:
    """Label scores of token streams; what a word adds at each offset is worked out once."""

    def __init__(self, field: Field, given: set[str], family: set[str]):
        self.f, self.given, self.family = field, given, family
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.rows = np.zeros((1 << 12, 2 * REACH + 1, len(LABELS)), np.float32)

    def number(self, words: list[str]) -> np.ndarray:
        place = self.place
        out = [place.get(w, -1) for w in words]
        if -1 in out:
            for k, n in enumerate(out):
                if n < 0:
                    w = words[k]
                    n = place.get(w)
                    if n is None:
                        n = place[w] = len(place)
                        if n >= len(self.rows):
                            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                        ids = [self.f.ids[x] for x in features(w, self.f.known, self.given, self.family) if x in self.f.ids]
                        self.rows[n] = self.f.weights[:, ids].sum(1) if ids else 0
                    out[k] = n
        return np.array(out, np.int64)

    def emissions(self, ids: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        n = len(ids)
        wide, wide_gap = np.zeros(n + 2 * REACH, np.int64), np.full(n + 2 * REACH, 2, np.int64)
        wide[REACH : REACH + n], wide_gap[REACH : REACH + n] = ids, gaps
        out = np.zeros((n, len(LABELS)), np.float32)
        for o in range(2 * REACH + 1):
            out += self.rows[wide[o : o + n], o]
            out += self.f.gaps[o][wide_gap[o : o + n]]
        return out

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best labels by Viterbi over overlapping stretches, all at once."""
        n, size = len(scores), len(LABELS)
        step = _STRETCH - 2 * _OVERLAP
        k = max(1, -(-n // step))
        pad = np.zeros((k * step + 2 * _OVERLAP, size), np.float32)
        pad[:, 1:] = -1e4
        pad[_OVERLAP : _OVERLAP + n] = scores
        # Stretches where no label can beat O, whatever the moves, are O throughout.
        e = np.lib.stride_tricks.sliding_window_view(pad, _STRETCH, axis=0)[::step].transpose(0, 2, 1)
        gain = max(0.0, float(2 * (self.f.moves.max() - self.f.moves[0, 0])))
        open_ = np.flatnonzero((e[:, :, 1:].max(2) - e[:, :, 0] + gain > 0).any(1))
        out = np.zeros((k, step), np.int8)
        if len(open_):
            e = np.ascontiguousarray(e[open_].transpose(1, 0, 2))
            back = np.empty((_STRETCH, len(open_), size), np.int8)
            best, moves = e[0], self.f.moves.T[None]
            for t in range(1, _STRETCH):
                s = best[:, None, :] + moves
                back[t] = s.argmax(2)
                best = s.max(2) + e[t]
            at = best.argmax(1).astype(np.int8)
            rows = np.arange(len(open_))
            for t in range(_STRETCH - 1, -1, -1):
                if _OVERLAP <= t < _STRETCH - _OVERLAP:
                    out[open_, t - _OVERLAP] = at
                at = back[t][rows, at] if t else at
        return out.ravel()[:n]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of each text, in blocks of tokens so that memory stays bounded."""
        out, words, gaps, cut = [], [], [], []
        queue = []

        def flush() -> None:
            if not queue:
                return
            scores = self.emissions(self.number(words), np.concatenate(gaps))
            labels = self.decode(scores)
            at = 0
            for text, s, e in queue:
                out.append(_join(text, labels[at : at + len(s)], s, e))
                at += len(s) + REACH
            words.clear(), gaps.clear(), queue.clear(), cut.clear()
            if len(self.place) > 400_000:
                self._reset()

        for t in texts:
            w, s, e = tokens(t)
            words.extend(w)
            words.extend([""] * REACH)  # nothing reaches from one text into the next
            gaps.append(_gaps(t, s, e))
            gaps.append(np.full(REACH, 2, np.int64))
            queue.append((t, s, e))
            if len(words) > _BLOCK:
                flush()
        flush()
        return out


def _join(text: str, labels: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    where = np.flatnonzero(labels)
    k = 0
    while k < len(where):
        i = j = where[k]
        kind = (labels[i] - 1) // 2
        while k + 1 < len(where) and where[k + 1] == j + 1 and labels[j + 1] == 2 * kind + 2:
            if kind == _NAME and text[start[j + 1]] in "/;:":  # two names, one after the other
                k += 1
                break
            k, j = k + 1, j + 1
        k += 1
        s, e, name = int(start[i]), int(end[j]), list(TYPES.values())[kind]
        if name == "phone" and s and text[s - 1] in "+(":
            s -= 1
        if name in ("id_number", "phone"):
            name = "phone" if _THREE_FOUR.fullmatch(text, s, e) else "id_number" if _TWO_FOUR.fullmatch(text, s, e) else name
        host = _HOST.match(text, e) if name == "name" else None
        if host:  # what looks like a name is the account before a sign
            name, e = "email", host.end()
        if name == "email":
            s = _email_start(text, s, e)
        if not _inside_word(text, s) and not _inside_word(text, e) and sound(text[s:e], name):
            out.append((s, e, name))
    return out


def _inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def _email_start(text: str, s: int, e: int) -> int:
    """An address has no space before its sign, but for those around signs that are spelt out."""
    m = re.search(r"@|\s*[(\[]?\bat\b[)\]]?\s*", text[s:e], re.I)
    if not m or not m.start():
        return s
    sign = s + m.start()
    if m[0] == "@":
        return sign - len(_LOCAL.search(text[max(0, sign - 64) : sign])[0])
    local = re.search(r"(?:\S+?\s+[(\[]?dot[)\]]?\s+)*\S+$", text[s:sign], re.I)
    return s + local.start() if local else s


_HOST, _LOCAL = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}\b"), re.compile(r"[\w.+-]*$")
_TWO_FOUR = re.compile(r"\d{3}([ -])\d{2}\1\d{4}")  # and no phone number like this
_THREE_FOUR = re.compile(r"\d{3}([ .-])\d{3}\1\d{4}")  # no identity number is grouped like this
_NAME = list(TYPES).index("N")
_DIGIT, _UPPER = re.compile(r"\d"), re.compile(r"[^\W\d_]*[A-ZÀ-Þ]")


def sound(span: str, kind: str) -> bool:
    """A last look at a decoded span: has it what its type can't do without?"""
    digits = len(_DIGIT.findall(span))
    if kind == "email":
        return not re.search(r"\s@|@\s", span) and bool(re.search(r"\S\s?(@|\bat\b|\(at\)|\[at\])\s?\S", span, re.I)) and bool(re.search(r"\.|\bdot\b", span, re.I)) and not span.lower().startswith("git@")
    if kind == "phone":
        return 8 <= digits <= 15
    if kind == "id_number":
        return 7 <= digits <= 12 and ":" not in span
    if kind == "address":
        return digits >= 1 and bool(_UPPER.search(span))
    return digits == 0 and len(re.findall(r"[^\W\d_]+", span)) >= 2


def train(n: int = 4000, rounds: int = 10, seed: int = 11) -> Field:
    """Maximum likelihood by forward and backward sums, on the labelled table."""
    examples, given, family = pii_examples.table(n, seed)
    known = pii_examples.lexicon()
    ids: dict[str, int] = {}
    count: dict[str, int] = {}
    rows = []
    for text, spans in examples:
        w, s, e = tokens(text)
        lab = np.zeros(len(w), np.int64)
        for a, b, t in spans:
            inside = np.flatnonzero((s >= a) & (e <= b))
            lab[inside] = LABELS.index("I" + t)
            if len(inside):
                lab[inside[0]] = LABELS.index("B" + t)
        fs = [features(x, known, given, family) for x in w]
        for x in fs:
            for f in x:
                count[f] = count.get(f, 0) + 1
        rows.append((fs, lab, _gaps(text, s, e)))
    for f, c in count.items():
        if c >= (8 if f.startswith("e=") else 2):
            ids[f] = len(ids)
    nf, size, width = len(ids) + 1, len(LABELS), 2 * REACH + 1  # the last row stands for "no feature"
    weights, gapw, moves = np.zeros((width, nf, size)), np.zeros((width, 3, size)), np.zeros((size, size))
    begin = np.zeros(size)
    begin[2::2] = -1e4
    fixed = np.zeros((size, size))
    for j in range(2, size, 2):  # I follows only its own B or I
        fixed[:, j] = -1e4
        fixed[j - 1, j] = fixed[j, j] = 0
    acc = [np.full_like(x, 1e-6) for x in (weights, gapw, moves)]
    rng = np.random.default_rng(seed)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i][1]))
    batches = [order[i : i + 80] for i in range(0, len(order), 80)]
    packed = []
    for b in batches:
        length = max(len(rows[i][1]) for i in b)
        f = np.full((len(b), length + 2 * REACH, SLOTS), nf - 1)
        g = np.full((len(b), length + 2 * REACH), 2)
        y, m = np.zeros((len(b), length), np.int64), np.zeros((len(b), length), bool)
        for r, i in enumerate(b):
            fs, lab, gap = rows[i]
            for t, x in enumerate(fs):
                x = [ids[z] for z in x if z in ids][:SLOTS]
                f[r, t + REACH, : len(x)] = x
            g[r, REACH : REACH + len(lab)] = gap
            y[r, : len(lab)], m[r, : len(lab)] = lab, True
        packed.append((f, g, y, m))
    for turn in range(rounds):
        for b in rng.permutation(len(packed)):
            f, g, y, m = packed[b]
            n_, length = y.shape
            e = np.zeros((n_, length, size))
            for o in range(width):
                e += weights[o][f[:, o : o + length]].sum(2) + gapw[o][g[:, o : o + length]]
            a = moves + fixed
            alpha, beta = np.empty_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + begin
            for t in range(1, length):
                s = alpha[:, t - 1, :, None] + a
                top = s.max(1)
                nxt = top + np.log(np.exp(s - top[:, None]).sum(1)) + e[:, t]
                alpha[:, t] = np.where(m[:, t, None], nxt, alpha[:, t - 1])
            top = alpha[:, -1].max(1)
            z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
            for t in range(length - 2, -1, -1):
                s = a + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
                top = s.max(2)
                nxt = top + np.log(np.exp(s - top[:, :, None]).sum(2))
                beta[:, t] = np.where(m[:, t + 1, None], nxt, 0)
            p = np.exp(alpha + beta - z[:, None, None]) * m[:, :, None]
            gold = np.eye(size)[y] * m[:, :, None]
            d = (p - gold).reshape(-1, size)
            gw, gg = np.zeros_like(weights), np.zeros_like(gapw)
            for o in range(width):
                ff, gf = f[:, o : o + length].reshape(-1, SLOTS), g[:, o : o + length].ravel()
                for j in range(size):
                    gw[o, :, j] = np.bincount(ff.ravel(), np.repeat(d[:, j], SLOTS), nf)
                    gg[o, :, j] = np.bincount(gf, d[:, j], 3)
            gw[:, -1] = 0
            both = m[:, 1:]
            pair = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            gm = pair.sum((0, 1))
            np.subtract.at(gm, (y[:, :-1][both], y[:, 1:][both]), 1)
            for x, grad, h in zip((weights, gapw, moves), (gw, gg, gm), acc):
                grad = grad + 0.02 * x * (grad != 0)
                h += grad * grad
                x -= 0.35 * grad / np.sqrt(h)
    return Field(ids, weights.astype(np.float32), gapw.astype(np.float32), (moves + fixed).astype(np.float32), known)


@functools.lru_cache(maxsize=1)
def field() -> Field:
    return train()


#: Setting that names the folder of the published weights; where it is unset, each session trains its own (half a minute).
WEIGHTS = "tidemark.pii.weights"


def publish(spark: SparkSession, path: str) -> None:
    """Write the trained weights as a table (part, name, place, weights), for other sessions to read."""
    f = field()
    rows = [("word", x, o, f.weights[o, i].tolist()) for x, i in f.ids.items() for o in range(2 * REACH + 1)]
    rows += [("gap", str(g), o, f.gaps[o, g].tolist()) for o in range(2 * REACH + 1) for g in range(3)]
    rows += [("move", "", i, m.tolist()) for i, m in enumerate(f.moves)]
    spark.createDataFrame(rows, "part string, name string, place int, weights array<float>").coalesce(1).write.mode("overwrite").parquet(path)


def published(spark: SparkSession, path: str) -> Field:
    """The field of a table that `publish` wrote: a few thousand rows, as many as there are features."""
    rows = spark.read.parquet(path).collect()
    ids = {x: i for i, x in enumerate(sorted({r["name"] for r in rows if r["part"] == "word"}))}
    weights, gaps, moves = (np.zeros(n, np.float32) for n in ((2 * REACH + 1, len(ids) + 1, len(LABELS)), (2 * REACH + 1, 3, len(LABELS)), (len(LABELS), len(LABELS))))
    for r in rows:
        if r["part"] == "move":
            moves[r["place"]] = r["weights"]
        elif r["part"] == "gap":
            gaps[r["place"], int(r["name"])] = r["weights"]
        else:
            weights[r["place"], ids[r["name"]]] = r["weights"]
    return Field(ids, weights, gaps, moves, pii_examples.lexicon())


def weights(spark: SparkSession) -> Field:
    path = spark.conf.get(WEIGHTS, None)
    return published(spark, path) if path else field()


def roster(people: DataFrame | None) -> tuple[set[str], set[str]]:
    if people is None:
        return set(), set()
    rows = people.select(F.lower("given"), F.lower("family")).limit(MAX_ROSTER + 1).collect()
    if len(rows) > MAX_ROSTER:
        raise ValueError(f"a roster of more than {MAX_ROSTER} rows")
    return {r[0] for r in rows if r[0]}, {r[1] for r in rows if r[1]}


def tag(rows: DataFrame, id_: str, texts: list[str], people: DataFrame | None = None) -> DataFrame:
    """(id, field, spans: array<struct<s,e,type>>) of every text with items; no shuffle."""
    spark = rows.sparkSession
    given, family = roster(people)
    handle = spark.sparkContext.broadcast((weights(spark), given, family))  # weights: a fixed few hundred KB; the roster is bounded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, g, h = handle.value
        scorer = f.scorer(g, h)
        for pdf in batches:
            out = []
            for c in texts:
                part = pdf[pdf[c].notna() & (pdf[c] != "")]
                for i, spans in zip(part["_id"], scorer.spans(part[c].tolist())):
                    if spans:
                        out.append((i, c, [{"s": s, "e": e, "type": t} for s, e, t in spans]))
            yield pd.DataFrame(out, columns=["_id", "field", "spans"])

    narrow = rows.select(F.col(id_).cast("bigint").alias("_id"), *texts).filter(F.col("_id").isNotNull())
    return narrow.mapInPandas(run, "_id bigint, field string, spans array<struct<s:bigint,e:bigint,type:string>>").withColumnRenamed("_id", id_)


def items(docs: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, pii_type, start_offset) of bodies and quotes."""
    found = tag(docs, "id", ["body", "quote"], people)
    return found.select(F.col("id").alias("doc_id"), "field", F.explode("spans").alias("x")).select("doc_id", "field", F.col("x.type").alias("pii_type"), F.col("x.s").alias("start_offset")).distinct()


def redact(docs: DataFrame, id_: str, texts: str | list[str], people: DataFrame | None = None) -> DataFrame:
    """(id, each of texts, n_items): the texts with typed placeholders, otherwise unchanged; one row a row. Of a single name: (id, redacted, n_items)."""
    given, family = roster(people)
    handle = docs.sparkSession.sparkContext.broadcast((weights(docs.sparkSession), given, family))
    names = ["redacted"] if isinstance(texts, str) else list(texts)
    texts = [texts] if isinstance(texts, str) else names
    held = [f"_text{k}" for k in range(len(texts))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, g, h = handle.value
        scorer = f.scorer(g, h)
        for pdf in batches:
            out, n = {"_id": pdf["_id"]}, np.zeros(len(pdf), np.int64)
            for k, c in enumerate(held):
                plain, done = [t if isinstance(t, str) else "" for t in pdf[c]], []
                for i, (raw, t, spans) in enumerate(zip(pdf[c], plain, scorer.spans(plain))):
                    parts, at = [], 0
                    for s, e, kind in spans:
                        parts += [t[at:s], PLACEHOLDER[kind]]
                        at = e
                    done.append("".join([*parts, t[at:]]) if isinstance(raw, str) else None)
                    n[i] += len(spans)
                out[f"_out{k}"] = done
            yield pd.DataFrame(out | {"n_items": n})

    narrow = docs.select(F.col(id_).cast("bigint").alias("_id"), *[F.col(t).alias(c) for t, c in zip(texts, held)])
    made = ", ".join(f"_out{k} string" for k in range(len(texts)))
    return narrow.mapInPandas(run, f"_id bigint, {made}, n_items bigint").toDF(id_, *names, "n_items")
