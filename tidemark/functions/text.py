"""Text functions as column expressions; Arrow functions only where no expression will do."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F

# Words that carry no topic when statements are compared.
OVERLAP_STOP = "the and for that this with from owner claude was were are not its has have had should will into over approved approves rejected rejects requested asked wants wanted".split()
# Words dropped from a recall topic.
TOPIC_STOP = "a an the we i you our your my me did do have has had was were about of for on in to with and or it that this keep choose chose discussed something similar before".split()
# Secrets, in the order in which they are replaced. Look-arounds stand for word borders, which must be those of ASCII.
SCRUBBED = "[scrubbed]"
SECRETS = [
    (r"(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{16,}", SCRUBBED),
    (r"(?<![A-Za-z0-9_])ghp_[A-Za-z0-9]{20,}", SCRUBBED),
    (r"(?<![A-Za-z0-9_])xox[abp]-[A-Za-z0-9-]{10,}", SCRUBBED),
    (r"(?<![A-Za-z0-9_])AKIA[A-Z0-9]{16}(?![A-Za-z0-9_])", SCRUBBED),
    (r"(?<![A-Za-z0-9_])Bearer\s+[A-Za-z0-9._~+/=-]{16,}", "Bearer " + SCRUBBED),
    (r"(?i)(?<![A-Za-z0-9_])(token|key|secret|password)(?![A-Za-z0-9_])([^\n]{0,40}?)([A-Fa-f0-9]{32,}|[A-Za-z0-9+/=]{32,})", "$1$2" + SCRUBBED),
    (r"(?m)^([A-Za-z0-9_]*(?:_KEY|_SECRET|_TOKEN|PASSWORD))=[^\r\n]*$", "$1=" + SCRUBBED),
]


def _accents() -> tuple[str, str]:
    """Precomposed Latin letters and their bases, by Unicode's own decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs += [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x1E00, 0x1F00)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def fold(c: Column) -> Column:
    """Lower case without accents, composed or not."""
    return F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), _FROM, _TO))


def tokens(c: Column) -> Column:
    """Words of a text for full-text search: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), 0)


def collapse(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def quote_key(c: Column) -> Column:
    """Key under which two quotes are the same: composed, white space collapsed, case kept. Text that is ASCII skips Python."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(plain.rlike(r"^\p{ASCII}*$"), plain).otherwise(_nfc(plain))


def scrub(c: Column) -> Column:
    for pattern, to in SECRETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def contains_phrase(body: Column, phrase: str) -> Column:
    """The phrase as whole words, white space and case aside; an empty phrase is in nothing."""
    words = phrase.split()
    if not words:
        return F.lit(False)
    return body.rlike(r"(?iu)(?<![\p{L}\p{N}])" + r"\s+".join(_literal(w) for w in words) + r"(?![\p{L}\p{N}])")


def _literal(s: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", s)


def glob_regex(pattern: str, exact: bool = False) -> str:
    """Wildcards * and ?, \\ before a sign that stands for itself; matches anywhere unless exact."""
    out, k = [], 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "\\":
            k += 1
            if k == len(pattern):
                raise ValueError("a pattern can't end with an escape")
            out.append(_literal(pattern[k]))
        else:
            out.append(".*" if ch == "*" else "." if ch == "?" else _literal(ch))
        k += 1
    body = "".join(out)
    return f"(?isu)^{body}$" if exact else f"(?isu){body}"


def topic_tokens(c: Column) -> Column:
    """Distinct words of three or more characters that carry a topic."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), 0))
    return F.array_except(found, F.array(*[F.lit(w) for w in OVERLAP_STOP]))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two word sets; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


# What a request asks for, first match wins.
RULES = r"(?i)^(?:please\s+)?(?:(?:what\s+are|(?:show|list)(?:\s+me)?|give\s+me)\s+)?(?:all\s+)?(?:(?:my|our|the)\s+)?(?:current\s+)?(?:standing\s+(?:orders|rules)|rules)(?:\s+(?:about|for|on|regarding)\s+(.+))?$"
INTENTS = [
    ("continue", r"\b(continue|resume|pick up|where (we|i) left off)\b"),
    ("overview", r"\b(what do you remember about|catch me up|overview)\b"),
    ("rationale", r"\bwhy (did|do|was|were)\b"),
    ("decision", r"\b(decide|decided|decision|agreed|choose|chose)\b"),
    ("instruction", r"\b(told you|my rules|standing orders|preference|always|never)\b"),
    ("related-history", r"\b(similar|before|remember|discussed)\b"),
]


def intent(c: Column) -> Column:
    low, bare = F.lower(c), F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+\z", ""), r"[?!.]+\z|\s+[?!.]+\z", "")
    out = F.when(bare.rlike(RULES), "instruction")
    for name, pattern in INTENTS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("recollection")


def fuzzy_span(body: str | None, quote: str | None, gap: int = 3, least: int = 4) -> str | None:
    """The body's own words where the quote's stand in order with at most `gap` others between neighbours."""
    want = [w.lower() for w in re.findall(r"[^\W_]+", quote or "")]
    if len(want) < least:
        return None
    have = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", body or "")]
    for s, (w, a, _) in enumerate(have):
        if w != want[0]:
            continue
        k, last = 1, s
        while k < len(want):
            nxt = next((i for i in range(last + 1, min(last + gap + 2, len(have))) if have[i][0] == want[k]), None)
            if nxt is None:
                break
            last, k = nxt, k + 1
        if k == len(want):
            return re.sub(r"\s+", " ", body[a : have[last][2]])
    return None


@F.pandas_udf(T.StringType())
def fuzzy_quote(body: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_span(b, q) for b, q in zip(body, quote)], dtype=object)
