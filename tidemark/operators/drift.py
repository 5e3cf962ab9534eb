"""Records whose JSON payload drifts between files, read into one agreed table (problem 2).

Rescue-column ingestion: `ingest` enforces the agreed fields, each in a column of its agreed type, and
keeps whatever does not fit (unlisted fields, listed fields of another type) as JSON in ``_rescued``;
a payload that is no JSON object is kept whole in ``_raw``. `replay` moves approved rescued fields into
typed columns later, without reading the raw files again. `departures` reports, per file and kind, how
its records depart from the agreement.

Defined cases: null, cut-off or non-object payloads give null fields and ``_raw``; repeated records are
kept; a null type counts as the empty kind; an empty table gives empty results; further columns pass
through, but for ones named like a column that `ingest` makes, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: JSON types as bits, so that the types of a field over a file merge by one OR.
BITS = {"string": 1, "number": 2, "boolean": 4, "object": 8, "array": 16}
SPARK = {"string": "string", "number": "double", "boolean": "boolean", "object": "variant", "array": "variant"}
_SEP = "\u0001"
#: The agreement is a driver-side table; beyond this many fields it is refused, never cut.
MAX_AGREED = 20_000


def agreement(schema: DataFrame) -> list[tuple[str, str, str, bool]]:
    rows = [tuple(r) for r in schema.select("kind", "field", "json_type", F.coalesce("required", F.lit(False))).limit(MAX_AGREED + 1).collect()]
    if len(rows) > MAX_AGREED:
        raise ValueError(f"an agreement of more than {MAX_AGREED} fields")
    return rows


def json_bit(value: Column) -> Column:
    """Bit of a variant's JSON type; 0 for null."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", 1).when(t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), 2).when(t == "BOOLEAN", 4)
        .when(t.startswith("OBJECT"), 8).when(t.startswith("ARRAY"), 16).otherwise(0)
    )


def _exact(value: Column) -> Column:
    """Whether a number survives the double column it goes to; one that does not is rescued as it is written."""
    t = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "decimal(38,0)")
    written, kept = F.try_variant_get(value, "$", "decimal(38,18)"), F.try_variant_get(value, "$", "double").try_cast("decimal(38,18)")
    return F.when(t == "BIGINT", F.abs(whole) <= 2**53).when(t.startswith("DECIMAL"), F.coalesce(written == kept, F.lit(False))).otherwise(True)


def with_fields(df: DataFrame, payload: str = "payload", type_: str = "type") -> DataFrame:
    """Adds _d_kind and _d_map (field -> variant; null unless the payload is a JSON object)."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of a key given twice the last counts, as in other readers
    v = F.try_parse_json(payload)
    out = df.withColumn("_d_map", F.try_variant_get(v, "$", "map<string,variant>"))
    inner = F.element_at("_d_map", "type")
    name = F.when(json_bit(inner) == 1, F.concat(F.lit("|"), F.try_variant_get(inner, "$", "string"))).otherwise("")
    return out.withColumn("_d_kind", F.concat(F.coalesce(F.col(type_), F.lit("")), F.coalesce(name, F.lit(""))))


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()])) if pairs else F.create_map(F.lit(""), F.lit(0))


def ingest(df: DataFrame, schema: DataFrame, payload: str = "payload", type_: str = "type", prefix: str = "f_") -> DataFrame:
    """df without its payload, plus kind, one typed column f_<field> per agreed field (f_<field>_<type> where kinds disagree),
    _nulls (agreed fields given as null), _rescued, _raw and _object (whether the payload was a JSON object)."""
    agreed = agreement(schema)
    listed = _literal_map({k + _SEP + f: BITS[t] for k, f, t, _ in agreed})
    rows = with_fields(df, payload, type_)
    key = lambda f: F.concat(F.col("_d_kind"), F.lit(_SEP), f)
    fits = lambda k, v: (json_bit(v) == listed[key(k)]) | ((json_bit(v) == 0) & listed[key(k)].isNotNull())
    ok = lambda v: F.coalesce(json_bit(v) == 0, F.lit(True)) | _exact(v)
    rows = rows.withColumns({
        "_d_ok": F.map_filter("_d_map", lambda k, v: F.coalesce((json_bit(v) == listed[key(k)]) & ok(v), F.lit(False))),
        "_nulls": F.map_keys(F.map_filter("_d_map", lambda k, v: (json_bit(v) == 0) & listed[key(k)].isNotNull())),
        "_d_bad": F.map_filter("_d_map", lambda k, v: ~F.coalesce(fits(k, v) & ok(v), F.lit(False))),
    })
    columns, names = [], columns_of(agreed, prefix)
    for name, f, t in names:
        value = F.element_at("_d_ok", f)
        value = F.when(json_bit(value) == BITS[t], value)
        columns.append((F.to_json(value) if SPARK[t] == "variant" else F.try_variant_get(value, "$", SPARK[t])).alias(name))
    made = {"kind", "_nulls", "_rescued", "_raw", "_object", "_d_kind", "_d_map", payload} | {name for name, _, _ in names}
    keep = [F.col(c) for c in df.columns if c not in made]
    rescued = F.when(F.size("_d_bad") > 0, F.to_json("_d_bad"))
    whole = F.col("_d_map").isNotNull()
    return rows.select(*keep, F.col("_d_kind").alias("kind"), *columns, "_nulls", rescued.alias("_rescued"), F.when(~whole, F.col(payload)).alias("_raw"), whole.alias("_object"))


def replay(table: DataFrame, kind: str, field: str, into: str, json_type: str) -> DataFrame:
    """Move an approved rescued field of one kind into column `into` (made if absent) and out of _rescued."""
    rescued = F.try_variant_get(F.try_parse_json("_rescued"), "$", "map<string,variant>")
    value = F.element_at(rescued, field)
    hit = F.coalesce((F.col("kind") == kind) & (json_bit(value) == BITS[json_type]), F.lit(False))
    got = F.to_json(value) if SPARK[json_type] == "variant" else F.try_variant_get(value, "$", SPARK[json_type])
    rest = F.map_filter(rescued, lambda k, v: k != field)
    before = F.col(into) if into in table.columns else F.lit(None)
    return table.withColumns(
        {into: F.coalesce(before, F.when(hit, got)), "_rescued": F.when(hit, F.when(F.size(rest) > 0, F.to_json(rest))).otherwise(F.col("_rescued"))}
    )


def columns_of(agreed: list[tuple[str, str, str, bool]], prefix: str = "f_") -> list[tuple[str, str, str]]:
    """(column, field, JSON type) of the typed columns that `ingest` makes."""
    types: dict[str, set[str]] = {}
    for _, f, t, _ in agreed:
        types.setdefault(f, set()).add(t)
    return [(prefix + f + ("" if len(types[f]) == 1 else "_" + t), f, t) for f in sorted(types) for t in sorted(types[f])]


def facts(table: DataFrame, agreed: list[tuple[str, str, str, bool]], path: str = "path") -> DataFrame:
    """(path, kind, field, n, bits) of an ingested table: in how many records of a file a field occurs and with which types.

    What fits is counted in its typed column, agreed fields given as null in _nulls, all else in _rescued. The row with
    the empty field counts the records. Only these sums are shuffled, so neither a large file nor a kind that holds most
    records weighs on one task.
    """
    pair = lambda f, bit: F.struct(F.lit(f).cast("string").alias("field"), F.lit(bit).alias("bit"))
    typed = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), pair(f, BITS[t])) for c, f, t in columns_of(agreed)])) if agreed else F.array()
    nulls = F.transform("_nulls", lambda f: F.struct(f.alias("field"), F.lit(0).alias("bit")))
    rescued = F.map_entries(F.coalesce(F.try_variant_get(F.try_parse_json("_rescued"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    rest = F.transform(rescued, lambda e: F.struct(e["key"].alias("field"), json_bit(e["value"]).alias("bit")))
    every = F.concat(F.array(pair(None, 0)), *([typed] if agreed else []), nulls, rest)
    return (
        table.filter("_object").select(F.col(path).alias("path"), "kind", F.explode(every).alias("e"))
        .groupBy("path", "kind", F.col("e.field").alias("field"))
        .agg(F.count("*").alias("n"), F.bit_or("e.bit").alias("bits"))
    )


def departures(df: DataFrame, schema: DataFrame, path: str = "path", payload: str = "payload", type_: str = "type") -> DataFrame:
    """(path, kind, field, change) with change in kind_added, retyped, renamed, removed, added: told from the ingested table."""
    agreed = agreement(schema)
    spark = df.sparkSession
    listed = spark.createDataFrame([(k, f, BITS[t], r) for k, f, t, r in agreed], "kind string, field string, want int, required boolean")
    kinds = sorted({k for k, *_ in agreed})
    table = ingest(df.select(path, payload, type_), schema, payload, type_)
    seen = materialise(facts(table, agreed, path), "facts")  # read several times below; one narrow row per field of a file
    totals = seen.filter(F.col("field").isNull()).select("path", "kind", F.col("n").alias("total"))
    known = totals.filter(F.col("kind").isin(kinds))
    added = totals.filter(~F.col("kind").isin(kinds)).select("path", "kind", F.lit("*").alias("field"), F.lit("kind_added").alias("change"))
    expected = known.join(listed, "kind").select("path", "kind", "field", "want", "required")
    got = seen.filter(F.col("field").isNotNull() & F.col("kind").isin(kinds))
    same = F.col("path").eqNullSafe(F.col("p2")) & (F.col("kind") == F.col("k2")) & (F.col("field") == F.col("f2"))
    both = got.join(expected.select(F.col("path").alias("p2"), F.col("kind").alias("k2"), F.col("field").alias("f2"), "want", "required"), same, "full").select(
        F.coalesce("path", "p2").alias("path"), F.coalesce("kind", "k2").alias("kind"), F.coalesce("field", "f2").alias("field"), "n", "bits", "want", "required"
    )
    both = both.join(known.select(F.col("path").alias("p2"), F.col("kind").alias("k2"), "total"), F.col("path").eqNullSafe(F.col("p2")) & (F.col("kind") == F.col("k2"))).drop("p2", "k2")
    missing = F.col("required") & F.col("n").isNull()
    candidate = F.col("want").isNull() & (F.col("n") == F.col("total")) & F.col("bits").isin(*BITS.values())
    w = Window.partitionBy("path", "kind", F.coalesce("want", "bits"))
    both = both.withColumns({"_gone": F.coalesce(F.max(missing).over(w), F.lit(False)), "_new": F.coalesce(F.max(candidate).over(w), F.lit(False))})
    change = (
        F.when(F.col("want").isNotNull() & F.col("n").isNotNull(), F.when(F.col("bits").bitwiseAND(F.bitwise_not("want")) != 0, "retyped"))
        .when(F.col("want").isNotNull(), F.when(F.col("required"), F.when(F.col("_new"), "renamed").otherwise("removed")))
        .otherwise(F.when(~(candidate & F.col("_gone")), "added"))
    )
    return both.select("path", "kind", "field", change.alias("change")).filter("change is not null").unionByName(added)
