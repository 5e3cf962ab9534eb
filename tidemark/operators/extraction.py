"""Around a reader of conversations (a callable): what it is shown, what of its replies is kept, what was done already."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import filters, relations

ITEM = "turn string, outcome string, statement string, quote string, reason string, who string, scope string, certainty string, context_turn string"
_FIELDS = [f.split(" ")[0] for f in ITEM.split(", ")]
_KEY = ["session_id", "first_id", "last_id", "model", "prompt_sha"]


def slices(docs: DataFrame, most: int) -> DataFrame:
    """(session_id, chunk, first_id, last_id, shown): packed turns as one text, a line a turn. A slice is bounded by `most` characters."""
    packed = relations.packed_turns(docs, most)
    turns = docs.filter(filters.spoken()).select("id", "body", filters.speaker().alias("who"))
    line = F.concat(F.lit("[T"), F.col("id").cast("string"), F.lit("] "), F.coalesce("who", F.lit("?")), F.lit(": "), F.coalesce("body", F.lit("")))
    met = packed.join(turns, "id")
    shown = met.groupBy("session_id", "chunk").agg(F.min_by("id", "k").alias("first_id"), F.max_by("id", "k").alias("last_id"), F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("l"))
    return shown.select("session_id", "chunk", "first_id", "last_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("shown"))


def undone(chunks: DataFrame, ledger: DataFrame | None, model: str, prompt_sha: str) -> DataFrame:
    """Slices that no successful run of this model and prompt covers."""
    todo = chunks.withColumns({"model": F.lit(model), "prompt_sha": F.lit(prompt_sha)})
    return todo if ledger is None else todo.join(ledger.select(*_KEY), _KEY, "left_anti")


def parse_reply(reply: str | None) -> tuple[list[dict] | None, str | None]:
    """(items, fault): a JSON object with items, a list, one object a line, or {"none": true}; fault says why there are none."""
    s = re.sub(r"^```\w*\s*|\s*```$", "", (reply or "").strip())
    if not s:
        return None, "empty reply"
    try:
        got = json.loads(s)
    except ValueError:
        try:
            got = [json.loads(x) for x in s.splitlines() if x.strip()]
        except ValueError:
            return None, "not JSON"
    if isinstance(got, dict):
        if got.get("none") is True:
            return [], None
        got = got.get("items", [got] if "outcome" in got else None)
    if not isinstance(got, list):
        return None, "no items"
    return [x for x in got if isinstance(x, dict)], None


def read_slices(todo: DataFrame, reader: Callable[[str], str]) -> DataFrame:
    """todo's keys with items (array), fault and reply: one call per slice; a call that raises is a fault of its slice alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items, faults, replies = [], [], []
            for shown in pdf["shown"]:
                try:
                    reply = reader(shown)
                    got, fault = parse_reply(reply)
                except Exception as e:
                    reply, got, fault = None, None, f"{type(e).__name__}: {e}"[:300]
                items.append([{f: None if x.get(f) is None else str(x[f]) for f in _FIELDS} for x in got or []])
                faults.append(fault)
                replies.append(reply)
            yield pdf[_KEY].assign(items=items, fault=faults, reply=replies)

    struct = ", ".join(f"{f}:string" for f in _FIELDS)
    return todo.mapInPandas(run, f"session_id string, first_id bigint, last_id bigint, model string, prompt_sha string, items array<struct<{struct.replace(', ', ',')}>>, fault string, reply string")


def split_outcome(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, ledger rows, dead letters): a slice without a fault is done, one with a fault is kept with its reply and tried again."""
    good = read.filter("fault is null")
    items = good.select("session_id", "first_id", F.posexplode("items").alias("n", "i")).select(F.concat_ws(":", F.col("first_id").cast("string"), F.col("n").cast("string")).alias("item"), "session_id", "i.*")
    return items, good.select(*_KEY, F.size("items").alias("found")), read.filter("fault is not null").select(*_KEY, "fault", "reply")


def score(found: DataFrame, gold: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(slice, hits, wanted, forbidden): found and gold are (slice, turn, outcome); forbidden is (slice, outcome)."""
    f = found.select("slice", "turn", "outcome").distinct()
    hits = f.join(gold, ["slice", "turn", "outcome"], "left_semi").groupBy("slice").agg(F.count("*").alias("hits"))
    bad = f.join(forbidden, ["slice", "outcome"], "left_semi").groupBy("slice").agg(F.count("*").alias("forbidden"))
    want = gold.groupBy("slice").agg(F.count("*").alias("wanted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return want.join(hits, "slice", "full").join(bad, "slice", "full").select("slice", zero("hits"), zero("wanted"), zero("forbidden"))


def quote_similarity(a, b):
    """Shared share of two quotes' words, for reports of near-identical decisions."""
    return text.overlap(text.topic_tokens(a), text.topic_tokens(b))
