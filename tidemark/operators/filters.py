"""Hard filters and derived columns over the document table; every one is a plain column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.schema import KINDS, OUTCOMES, SPEAKERS

TOOL_ONLY = "(tool-only turn:"


def speaker() -> Column:
    return F.when((F.col("kind") == "turn") & (F.col("role") == "user"), "owner").when((F.col("kind") == "turn") & (F.col("role") == "assistant"), F.col("source_client")).otherwise(F.col("who"))


def live() -> Column:
    return (F.col("status") == "active") & F.col("superseded_by").isNull()


def direct() -> Column:
    return (F.col("kind") == "turn") & (F.col("origin") == "direct") & F.col("role").isin("user", "assistant")


def tool_only() -> Column:
    return F.coalesce(F.lower("body").startswith(TOOL_ONLY), F.lit(False))


def not_tool() -> Column:
    return (F.coalesce("origin", F.lit("")) != "tool") & ~F.lower("body").startswith(TOOL_ONLY)


def unclear_standing() -> Column:
    return (F.coalesce("outcome", F.lit("")) == "standing") & (F.coalesce("origin", F.lit("")) == "decision-unclear")


def indexable() -> Column:
    """Rows that the vector lane may hold."""
    return (F.col("status") == "active") & F.col("superseded_by").isNull() & ~F.coalesce("origin", F.lit("")).isin("tool", "reference") & ~tool_only()


def spoken() -> Column:
    return (F.col("kind") == "turn") & live() & not_tool()


def files_glob(pattern: str) -> Column:
    """A glob over the path and each of the row's files, slashes alike."""
    rx = text.glob_regex(pattern.replace("\\", "/"))
    files = F.coalesce(F.from_json("files_json", "array<string>"), F.array().cast("array<string>"))
    slashed = lambda c: F.translate(c, "\\", "/")
    return F.coalesce(slashed(F.col("path")).rlike(rx), F.lit(False)) | F.coalesce(F.exists(files, lambda f: slashed(f).rlike(rx)), F.lit(False))


@dataclass
class Scope:
    """The filters of a search; checked when made, applied by `where`."""

    project: str | None = None
    kinds: list[str] = field(default_factory=list)
    client: str | None = None
    who: str | None = None
    session: str | None = None
    outcomes: list[str] = field(default_factory=list)
    files: str | None = None
    lo: int | None = None
    hi: int | None = None
    direct: bool = False
    tools: bool = False
    include_superseded: bool = False
    include_unclear: bool = False
    order: str = "relevance"

    def __post_init__(self):
        for value, allowed, name in ((self.kinds, KINDS, "kind"), (self.outcomes, OUTCOMES, "outcome")):
            if bad := [x for x in value if x not in allowed]:
                raise ValueError(f"no such {name}: {bad[0]}")
        if self.who and self.who not in [*SPEAKERS, "assistant"]:
            raise ValueError(f"no such speaker: {self.who}")
        if self.order not in ("relevance", "oldest", "newest"):
            raise ValueError(f"no such order: {self.order}")
        if self.direct and self.tools:
            raise ValueError("direct and tools exclude each other")
        if self.outcomes and not self.kinds:
            self.kinds = ["statement"]

    def where(self, docs: DataFrame) -> DataFrame:
        out = docs
        if self.project is not None:
            out = out.filter(F.col("project") == self.project)
        if not self.include_superseded:
            out = out.filter(live())
        if self.kinds:
            out = out.filter(F.col("kind").isin(self.kinds))
        if self.client and self.client != "all":
            out = out.filter(F.col("source_client") == self.client)
        if self.who:
            out = out.filter(speaker().isin("claude", "codex") if self.who == "assistant" else speaker() == self.who)
        if self.direct:
            out = out.filter(direct())
        elif not self.tools:
            out = out.filter(not_tool())
        if self.outcomes:
            out = out.filter(F.col("outcome").isin(self.outcomes))
            if "standing" in self.outcomes and not self.include_unclear:
                out = out.filter(~unclear_standing())
        if self.session:
            out = out.filter(F.col("session_id") == self.session)
        ms = dates.event_ms(F.col("ts"))
        if self.lo is not None:
            out = out.filter(ms >= self.lo)
        if self.hi is not None:
            out = out.filter(ms < self.hi)
        if self.order != "relevance":
            out = out.filter(ms.isNotNull())
        if self.files:
            out = out.filter(files_glob(self.files))
        return out


def resolve_session(docs: DataFrame, prefix: str) -> str:
    """The one session whose id, or id without its client, begins with the prefix."""
    native = F.regexp_replace("session_id", "^[a-z]+:", "")
    hits = docs.filter(F.col("session_id").startswith(prefix) | native.startswith(prefix)).select("session_id").distinct().limit(2).collect()
    if len(hits) != 1:
        raise ValueError("no such session" if not hits else "several sessions begin like this")
    return hits[0][0]


def snippet(body: Column, words: list[str], before: int = 60, length: int = 200) -> Column:
    """The stretch of a body around the first of the words, white space collapsed; its beginning if none is there."""
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")
    at = F.array_min(F.filter(F.array(*[F.instr(F.lower(plain), F.lit(w.lower())) for w in words or [""]]), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - before)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(plain, start, F.lit(length)), F.when(F.length(plain) >= start + length, "…").otherwise(""))


# The line of a pending decision, and what it says once no evidence was found.
PENDING, UNVERIFIED = "PENDING: ", "UNVERIFIED: no matching owner evidence was linked after ingest; this is not a verified decision"


def shown_body() -> Column:
    """A decision's body as it is shown: an outdated pending line of an unverified one is put right, the stored text is not."""
    return F.when(F.col("status") == "unverified", F.regexp_replace("body", r"(?m)^PENDING: [^\n]*$", UNVERIFIED)).otherwise(F.col("body"))
