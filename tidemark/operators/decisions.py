"""Checks of extracted statements and recorded decisions, as rule columns: reject_reason is null where all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import filters
from tidemark.schema import OUTCOMES, SPEAKERS

# Words by which a sentence states a rule for all future work.
GENERAL = (
    r"(?i)\b(never|always|from now on|going forward|every time|each time|any time|whenever|in future|by default|do not ever|don't ever|no more|stop (doing|using|saying)|must (always|never)|rule)\b"
    r"|\b(do not|don't|never)\b[^.]*\bagain\b"
)
SHORT = 6
# An earlier outcome and the later ones that may replace it.
MAY_REPLACE = {"standing": ["standing"], "approved": ["approved", "rejected"], "rejected": ["approved", "rejected"], "open": ["approved", "rejected", "open"]}


def _question(c: Column) -> Column:
    return c.rlike(r"\?\s*$")


def cited_turn(turn: Column) -> Column:
    return F.regexp_extract(turn.cast("string"), r"^[Tt]?(\d+)$", 1).try_cast("bigint")


def validate(items: DataFrame, docs: DataFrame) -> DataFrame:
    """items (item, turn, outcome, statement, quote, reason, who) against the turns they cite.

    Gives item, doc_id, who, outcome, statement, quote (the turn's own words), evidence, reject_reason.
    """
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    turns = docs.filter(filters.spoken()).select("id", "role", "body", filters.speaker().alias("_who"), F.lag("id").over(w).alias("_pid"), F.lag("role").over(w).alias("_prole"))
    met = items.withColumn("_turn", cited_turn(F.col("turn"))).join(turns, F.col("_turn") == F.col("id"), "left")
    q = F.trim(F.coalesce("quote", F.lit("")))
    exact = F.contains(text.collapse(F.col("body")), text.collapse(q))
    met = met.withColumn("_q", F.when((q == "") | (F.length(q) > 240), None).when(exact, q).otherwise(text.fuzzy_quote(F.col("body"), q)))
    reason = (
        F.when(F.col("who").isNotNull() & ~F.col("who").isin(SPEAKERS), "speaker").when(~F.coalesce(F.col("outcome").isin(OUTCOMES), F.lit(False)), "outcome")
        .when(F.trim(F.coalesce("statement", F.lit(""))) == "", "no statement").when(F.col("id").isNull(), "turn not there").when(F.col("_q").isNull() | (F.length("_q") > 240), "quote not in turn")
        .when(F.col("outcome").isin("standing", "approved") & (F.col("_who") != "owner"), "not the owner's").when((F.col("outcome") == "open") & _question(F.col("_q")), "a question is not open work")
    )
    pair = (F.col("role") == "assistant") & (F.col("_prole") == "user")
    return met.select(
        "item", F.col("id").alias("doc_id"), F.col("_who").alias("who"), "outcome", F.substring(F.trim("statement"), 1, 300).alias("statement"), F.col("_q").alias("quote"),
        F.when(pair, F.array("_pid", "id")).when(F.col("id").isNotNull(), F.array("id")).alias("evidence"), F.nullif(F.trim("reason"), F.lit("")).alias("reason"), reason.alias("reject_reason"),
    )


def _words_pattern(quote: Column) -> Column:
    """A quote's words one after the other, whatever white space is between them."""
    literal = lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(quote, r"\s+", " ")), " "), literal), r"\s+")


def ends_as_question(body: Column, quote: Column) -> Column:
    """Whether the sentence that holds the quote ends with a question mark; white space and case of the quote don't matter."""
    rest = F.call_function("regexp_extract", body, F.concat(F.lit("(?isu)"), _words_pattern(quote), F.lit("(.*)$")), F.lit(1))
    end = F.regexp_extract(rest, r"(?s)^.*?([!?\n]|\.(?=\s|$))", 1)
    return (F.trim(quote) != "") & (F.substring(end, 1, 1) == "?")


def holds_phrase(body: Column, quote: Column) -> Column:
    """Whether a text has the quote as whole words anywhere; white space and case don't matter, an empty quote is in nothing."""
    whole = F.concat(F.lit(r"(?isu)(?<![\p{L}\p{N}])"), _words_pattern(quote), F.lit(r"(?![\p{L}\p{N}])"))
    return F.coalesce((F.trim(quote) != "") & F.regexp_like(body, whole), F.lit(False))


def validate_decisions(items: DataFrame, docs: DataFrame) -> DataFrame:
    """As `validate`, for decisions of the owner: no questions, short replies need a proposal before them, rules must be said as rules (else certainty = unclear)."""
    v = validate(items, docs)
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    context = docs.filter(filters.spoken()).select(F.col("id").alias("doc_id"), "body", F.last(F.when(F.col("role") == "assistant", F.col("id")), True).over(w).alias("context"))
    met = v.join(context, "doc_id", "left")
    short = (F.size(F.split(F.trim("quote"), r"\s+")) < SHORT) & F.col("outcome").isin("approved", "rejected")
    reason = F.coalesce(
        F.col("reject_reason"),
        F.when(F.col("who") != "owner", "not the owner's").when(_question(F.col("quote")), "a question").when(ends_as_question(F.col("body"), F.col("quote")), "part of a question").when(short & F.col("context").isNull(), "a short reply to nothing"),
    )
    certainty = F.when((F.col("outcome") == "standing") & ~F.col("quote").rlike(GENERAL), "unclear").otherwise("clear")
    evidence = F.when(F.col("context").isNotNull(), F.array("context", "doc_id")).otherwise(F.array("doc_id"))
    return met.select("item", "doc_id", "outcome", "statement", "quote", evidence.alias("evidence"), certainty.alias("certainty"), reason.alias("reject_reason"))


def check(inputs: DataFrame) -> DataFrame:
    """inputs (outcome, client, quote, statement, scope) with certainty and reject_reason, before anything is recorded."""
    q, s = F.trim(text.scrub(F.coalesce("quote", F.lit("")))), F.trim(text.scrub(F.coalesce("statement", F.lit(""))))
    reason = (
        F.when(~F.coalesce(F.lower("outcome").isin("approved", "rejected", "standing", "open"), F.lit(False)), "outcome").when(~F.coalesce(F.lower("client").isin("claude", "codex"), F.lit(False)), "client")
        .when(q == "", "no quote").when(F.length(q) > 400, "quote too long").when(_question(q), "a question").when((F.length(s) < 12) | (text.collapse(s) == text.collapse(q)), "says not what was decided")
        .when(F.trim(F.coalesce("scope", F.lit(""))) == "", "no scope")
    )
    certainty = F.when((F.lower("outcome") == "standing") & ~q.rlike(GENERAL), "unclear").otherwise("clear")
    return inputs.withColumns({"certainty": certainty, "reject_reason": reason})


def link_pending(pending: DataFrame, turns: DataFrame, spoken: DataFrame | None = None, back: int = 12) -> DataFrame:
    """(id, turn_id, context_id, state): pending quotes and the one owner turn that holds each.

    pending: id, project, ms (when it was recorded), quote and, if there, client, session_id, context (words of what was
    answered), status. turns: the owner's turns (id, project, ms, body and, if there, client, session_id, ts). spoken: all
    spoken turns (id, session_id, ts, role, body), among which the proposal is looked for.

    A turn counts from a day before to two minutes after; it holds the quote as whole words or, failing that, its words in
    order with small gaps. Where a context is given, one of the `back` spoken turns before must hold it. state: linked
    (exactly one exchange is left), ambiguous (several, or several conversations where neither session nor context is
    given), unverified (none, though the client's conversation goes on ten minutes later) or waiting.
    """
    from tidemark.operators.relations import turns_around

    has = lambda df, c, t="string": F.col(c) if c in df.columns else F.lit(None).cast(t)
    p = pending.select(F.col("id").alias("anchor"), "project", "ms", "quote", has(pending, "client").alias("p_client"), has(pending, "session_id").alias("p_session"), has(pending, "context").alias("context"), has(pending, "status").alias("p_status"))
    t = turns.select("id", "project", "ms", "body", has(turns, "client").alias("client"), has(turns, "session_id").alias("session_id"))
    near = turns_around(p.select("anchor", "project", "ms"), t.select("id", "project", "ms"), 86_400_000, 120_000, 400)
    met = near.join(p.drop("project", "ms"), "anchor").join(t.drop("project", "ms"), "id")
    same = (F.col("p_client").isNull() | F.col("p_client").eqNullSafe(F.col("client"))) & (F.col("p_session").isNull() | F.col("p_session").eqNullSafe(F.col("session_id")))
    met = met.filter(same).withColumn("_exact", holds_phrase(F.col("body"), F.col("quote")))
    # Python sees only the texts that do not hold the quote as it stands.
    exact, loose = met.filter("_exact"), met.filter("not _exact").withColumn("_f", text.fuzzy_quote(F.col("body"), F.col("quote"))).filter("_f is not null").drop("_f")
    hits = exact.unionByName(loose).select("anchor", "id", "session_id", "p_session", "context")
    if spoken is not None:
        w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(-back, -1)
        before = spoken.select("id", F.collect_list("id").over(w).alias("_before")).join(hits.select("id").distinct(), "id", "left_semi")
        said = spoken.select(F.col("id").alias("_c"), F.col("role").alias("_role"), F.col("body").alias("_said"))
        near = hits.join(before, "id", "left").select("anchor", "id", "context", F.posexplode_outer("_before").alias("_place", "_c")).join(said, "_c", "left")
        fits = F.when(F.col("context").isNotNull(), holds_phrase(F.col("_said"), F.col("context"))).otherwise(F.col("_role") == "assistant")
        context = near.groupBy("anchor", "id").agg(F.max_by("_c", F.when(F.coalesce(fits, F.lit(False)), F.col("_place"))).alias("context_id"))
        hits = hits.join(context, ["anchor", "id"])
    else:
        hits = hits.withColumn("context_id", F.lit(None).cast("bigint"))
    left = F.col("context").isNull() | F.col("context_id").isNotNull()
    per = hits.groupBy("anchor").agg(
        F.count_if(left).alias("n"), F.min(F.when(left, F.struct(F.col("id").alias("turn_id"), "context_id"))).alias("hit"),
        (F.max(F.coalesce("context", "p_session").isNull()) & (F.count_distinct(F.coalesce("session_id", F.lit(""))) > 1)).alias("scattered"),
    )
    latest = t.groupBy(F.col("project").alias("_p"), F.col("client").alias("_cl")).agg(F.max("ms").alias("_last"))
    out = p.join(per, "anchor", "left").join(latest, (F.col("project") == F.col("_p")) & F.col("p_client").eqNullSafe(F.col("_cl")), "left")
    gone = F.coalesce((F.col("p_status") == "unverified") | (F.col("p_client").isNotNull() & (F.col("_last") > F.col("ms") + 600_000)), F.lit(False))
    one = (F.col("n") == 1) & ~F.coalesce("scattered", F.lit(False))
    state = F.when(one, "linked").when((F.col("n") > 1) | F.col("scattered"), "ambiguous").when(gone, "unverified").otherwise("waiting")
    return out.select(F.col("anchor").alias("id"), F.when(one, F.col("hit.turn_id")).alias("turn_id"), F.when(one, F.col("hit.context_id")).alias("context_id"), state.alias("state"))


def relation(pairs: DataFrame) -> DataFrame:
    """pairs (old_id, old_outcome, old_status, old_ts, new_outcome, new_ts, new_quote, turn_body, certainty) with relation replaces or conflict, and why."""
    allowed = F.lit(False)
    for old, new in MAY_REPLACE.items():
        allowed = allowed | ((F.col("old_outcome") == old) & F.col("new_outcome").isin(new))
    directive = r"(?is)^replace decision #([1-9]\d*) with:\s*(.+)$"
    said = F.trim("turn_body")
    named = F.regexp_extract(said, directive, 1).try_cast("bigint") == F.col("old_id")
    same = (text.quote_key(F.regexp_extract(said, directive, 2)) == text.quote_key(F.col("new_quote"))) | (text.quote_key(said) == text.quote_key(F.col("new_quote")))
    why = (
        F.when(F.col("certainty") != "clear", "the new decision is unclear").when(F.col("old_status") != "active", "the earlier one is not in force").when(~F.coalesce(F.col("new_ts") > F.col("old_ts"), F.lit(False)), "not said later")
        .when(~allowed, "outcomes that don't replace each other").when(~F.coalesce(said.rlike(directive) & named & same, F.lit(False)), "no explicit replacement")
    )
    return pairs.withColumns({"relation": F.when(why.isNull(), "replaces").otherwise("conflict"), "why": why})
