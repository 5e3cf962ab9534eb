"""The document table: schema, fixed sets of values, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2
# Fixed values.
KINDS = ["turn", "statement", "handoff", "memory", "compact_summary", "map_section", "changelog"]
STATUSES = ["active", "superseded", "struck", "pending", "unverified"]
OUTCOMES = ["approved", "rejected", "standing", "completed", "open", "proposed", "superseded"]
SPEAKERS = ["owner", "claude", "codex"]
DOCS = (
    "id bigint, project string, kind string, status string, session_id string, ts string, role string, path string, title string, body string, files_json string, "
    "tools_json string, who string, outcome string, evidence_ids string, quote string, reason string, superseded_by bigint, sha string, source_client string, "
    "native_session string, item_key string, turn_key string, ordinal bigint, segment string, src_offset bigint, origin string, adapter string"
)
_ADDED = ["source_client", "native_session", "item_key", "turn_key", "ordinal", "segment", "src_offset", "origin", "adapter"]


def migrate(docs: DataFrame) -> DataFrame:
    """A version 1 table as version 2: missing columns added, client and origin filled in; a version 2 table unchanged."""
    types = dict(x.strip().split(" ") for x in DOCS.split(","))
    new = {c: F.lit(None).cast(types[c]) for c in _ADDED if c not in docs.columns}
    out = docs.withColumns(new) if new else docs
    client = F.when(F.col("kind").isin("turn", "compact_summary", "statement"), F.coalesce("source_client", F.lit("claude"))).otherwise(F.col("source_client"))
    origin = (
        F.when(F.col("kind") == "compact_summary", "summary").when(F.col("kind") == "statement", F.lit(None).cast("string"))
        .when(F.col("kind") != "turn", "file").when(F.lower("body").startswith("(tool-only turn:"), "tool").otherwise("direct")
    )
    return out.withColumns({"source_client": client, "origin": F.coalesce("origin", origin)})
