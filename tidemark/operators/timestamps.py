"""Mixed timestamp notations to one UTC instant (problem 7).

Everything up to the zone estimate is column expressions: one regular expression per family of
notations turns the text into separated parts, parts are range-checked, and the instant follows by
integer arithmetic. Named zones are resolved by trying the offsets in force before and after the
local time: if both fit, the clock showed the time twice; if none fits, it skipped it.

Zones missing from the text are chosen per file (`choose_zones`): offset histories are laid over the
file's zone-less times, and a zone fits if under it none of them is skipped or falls outside the instants
known before and after it in the file's sequence, or after the file was stored. Where the file's record
names its zone, that history alone is laid and taken, and its violations are reported; elsewhere every
distinct history of the zone database is tried. If none fits, or zones that give different instants fit,
the zone stays open.

Defined cases: null, blank or unparsable text, impossible dates or times, dates alone, times alone:
no instant (utc_ms null). Repeated rows are kept. An empty table gives an empty table. Columns other
than those named are passed through, but for ones named utc_ms, zone_from or ``_t_...``, which the operator's own replace.
"""

from __future__ import annotations

import functools
import zoneinfo
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

# Zone abbreviations that name one offset, in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "JST": 540,
}
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
DAYS = "SunMonTueWedThuFriSat"
CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"

_ZONE = r"(Z|z|[+-]\d\d(?::?\d\d)?|[A-Z]{3,4}|\[?[A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+)*\]?)?"
_ISO = rf"^(\d{{4}})([-/]?)(\d\d)\2(\d\d)(?:[Tt]| )(\d\d)(:?)(\d\d)(?:\6(\d\d)(?:[.,](\d+))?)? ?{_ZONE}(?:\[[A-Za-z_/+-]+\])?$"
_RFC = rf"^(?:([A-Z][a-z]{{2}}), )?(\d{{1,2}}) ([A-Z][a-z]{{2}}) (\d{{4}}) (\d{{1,2}}):(\d\d)(?::(\d\d))? ?{_ZONE}$"
_US = rf"^([A-Z][a-z]{{2}}) (\d{{1,2}}), (\d{{4}}),? (\d{{1,2}}):(\d\d)(?::(\d\d))? ([AP]M) ?{_ZONE}$"
_EPOCH = r"^(\d{9,17})(?:\.(\d+))?$"
#: Ends in a wall time: such a text takes its zone from elsewhere.
_ZONELESS = r"^(\d{4}[-/]?\d\d[-/]?\d\d(?:[Tt]| )\d\d:?\d\d(?::?\d\d(?:[.,]\d+)?)?|.*\d{1,2} [A-Z][a-z]{2} \d{4} \d{1,2}:\d\d(?::\d\d)?|[A-Z][a-z]{2} \d{1,2}, \d{4},? \d{1,2}:\d\d(?::\d\d)? [AP]M)$"
_DAY_MS = 86_400_000


def _known_zones() -> list[str]:
    return sorted(zoneinfo.available_timezones())


# Zone names in capitals alone that are no abbreviation of several zones.
CAPITALS = ("GB", "HST", "MET", "NZ", "PRC", "ROK", "UCT", "UTC", "GMT")


def is_zone(name: Column) -> Column:
    """Whether the session's zone database knows a name; asked of the database itself, so no list of names stands in the plan."""
    known = F.concat(F.lit("2000-01-01 00:00:00 "), name).try_cast("timestamp").isNotNull()
    return F.coalesce((name.rlike("^[A-Z][A-Za-z_/+-]*$") & name.rlike("[a-z]") | name.isin(*CAPITALS)) & known, F.lit(False))


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _three_digits(frac: Column) -> Column:
    return F.rpad(F.substring(F.coalesce(frac, F.lit("")), 1, 3), 3, "0").cast("int")


def _number(names: str, c: Column, size: int) -> Column:
    """1-based place of a three-letter name, null if it is none."""
    at = F.instr(F.lit(names), c)
    return F.when((F.length(c) == 3) & (at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3).cast("int") + 1)


def _split(s: Column) -> Column:
    """Array year, month, day, hour, minute, second, extra, zone of a text in one of the families; null if it is in none.

    extra is the fraction of a second, the week day or AM/PM, after the family's number 0, 1 or 2 in the first place.
    """
    iso = F.regexp_replace(s, _ISO, "0~$1~$3~$4~$5~$7~$8~$9~$10")
    rfc = F.regexp_replace(s, _RFC, "1~$4~$3~$2~$5~$6~$7~$1~$8")
    us = F.regexp_replace(s, _US, "2~$3~$1~$2~$4~$5~$6~$7~$8")
    return F.split(F.when(s.rlike(_ISO), iso).when(s.rlike(_RFC), rfc).when(s.rlike(_US), us), "~")


def _parts(a: Column) -> Column:
    """Struct of numbers and the zone's text from what `_split` made."""
    g = lambda i: F.get(a, F.lit(i))
    family, extra = g(0), g(7)
    month = F.when(family == "0", _int(g(2))).otherwise(_number(MONTHS, g(2), 12))
    hour = _int(g(4))
    hour = F.when(family != "2", hour).when(hour.between(1, 12), hour % 12 + F.when(extra == "PM", 12).otherwise(0))
    return F.when(
        family.isNotNull(),
        F.struct(
            _int(g(1)).alias("y"), month.alias("mo"), _int(g(3)).alias("d"), hour.alias("h"), _int(g(5)).alias("mi"), F.coalesce(_int(g(6)), F.lit(0)).alias("s"),
            F.when(family == "0", _three_digits(extra)).otherwise(0).alias("ms"), F.translate(g(8), "[]", "").alias("zone"), F.when(family == "1", extra).otherwise("").alias("day"),
        ),
    )


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a bare number of seconds, milliseconds or microseconds, told apart by their digits."""
    whole = F.regexp_extract(ts, _EPOCH, 1)
    n, digits = whole.cast("bigint"), F.length(whole)
    frac = F.regexp_extract(ts, _EPOCH, 2)
    return F.when(
        ts.rlike(_EPOCH),
        F.when(digits <= 11, n * 1000 + _three_digits(frac)).when(digits <= 14, n).otherwise(F.floor(n / 1000)),
    )


def _local_ms(p: Column) -> Column:
    """Wall time in milliseconds as if it were UTC; null for impossible dates, times or week days."""
    first = F.make_date(p["y"], p["mo"], F.lit(1))
    days = F.unix_date(first) + p["d"] - 1
    week_day = F.pmod(days + 4, F.lit(7)) + 1
    good = p["mo"].between(1, 12) & (p["h"] < 24) & (p["mi"] < 60) & (p["s"] < 60) & (p["d"] >= 1) & (p["y"] >= 1)
    fits = F.when(good, (p["d"] <= F.dayofmonth(F.last_day(first))) & ((p["day"] == "") | p["day"].isNull() | (_number(DAYS, p["day"], 7) == week_day)))
    ms = days.cast("bigint") * _DAY_MS + p["h"] * 3_600_000 + p["mi"] * 60_000 + p["s"] * 1000 + p["ms"]
    return F.when(fits, ms)


def _fixed_offset_ms(zone: Column) -> Column:
    """Offset of Z, +hh, +hhmm, +hh:mm or an abbreviation; null for anything else."""
    digits = F.regexp_replace(zone, "[:+-]", "")
    hours, minutes = F.substring(digits, 1, 2).cast("int"), F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    signed = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1))
    names = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    minutes_off = (
        F.when(F.upper(zone) == "Z", 0).when(zone.rlike(r"^[+-]\d\d(:?\d\d)?$"), signed).when(zone.rlike("^[A-Z]{3,4}$"), names[zone])
    )
    return minutes_off.cast("bigint") * 60_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable isn't copied into each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zone_instant(local: Column, zone: Column) -> Column:
    """The one instant at which a named zone's clock showed `local`; null if it was skipped or shown twice."""
    offset = lambda u: F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(u), zone)) - u
    fits = lambda u: offset(u) == local - u

    def choose(p: Column) -> Column:
        before, after = local - p["b"], local - p["a"]
        return F.when(before == after, before).when(fits(before) & ~fits(after), before).when(fits(after) & ~fits(before), after)

    around = F.struct(offset(local - 36 * 3_600_000).alias("b"), offset(local + 36 * 3_600_000).alias("a"))
    return F.when(local.isNotNull() & zone.isNotNull(), let(around, choose))


def zone_skips(local: Column, zone: Column) -> Column:
    """Whether a named zone's clock never showed `local`."""
    offset = lambda u: F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(u), zone)) - u
    misses = lambda u: offset(u) != local - u
    return misses(local - offset(local - 36 * 3_600_000)) & misses(local - offset(local + 36 * 3_600_000))


def parse(df: DataFrame, ts: str) -> DataFrame:
    """Adds _t_ms (instant, where the text alone names one), _t_local (wall time of a zone-less text).

    Each step is a column of its own, so that what several later ones use is worked out once.
    """
    zone = F.coalesce(F.col("_t_p.zone"), F.lit(""))
    own = F.when(zone != "", F.coalesce(F.col("_t_wall") - _fixed_offset_ms(zone), F.when(is_zone(zone), zone_instant(F.col("_t_wall"), zone))))
    return (
        df.withColumn("_t_s", F.trim(F.col(ts)))
        .withColumn("_t_a", _split(F.col("_t_s")))
        .withColumn("_t_p", _parts(F.col("_t_a")))
        .withColumn("_t_wall", _local_ms(F.col("_t_p")))
        .withColumns({"_t_ms": F.when(F.col("_t_a").isNull(), epoch_ms(F.col("_t_s"))).otherwise(own), "_t_local": F.when(zone == "", F.col("_t_wall"))})
        .drop("_t_s", "_t_a", "_t_p", "_t_wall")
    )


def file_zones(sources: DataFrame) -> DataFrame:
    """(_t_path, _t_zone, _t_stored) of each file record; an unknown zone name counts as none."""
    tz = F.get_json_object("state", "$.tz")
    stored = parse(sources.select("path", tz.alias("tz"), F.col("ingested_at").alias("_at")), "_at")
    return stored.select(F.col("path").alias("_t_path"), F.when(is_zone(F.col("tz")), F.col("tz")).alias("_t_zone"), F.col("_t_ms").alias("_t_stored"))


#: Names that are preferred for a history that several zones share.
CANDIDATES = ("UTC", "America/New_York", "America/Los_Angeles", "Europe/London", "Europe/Berlin", "Asia/Kolkata", "Australia/Sydney")


@functools.lru_cache(maxsize=1)
def histories() -> tuple[str, ...]:
    """A zone for every distinct offset history that the session's zone database holds; CANDIDATES come first."""
    jvm = SparkSession.active()._jvm
    known = jvm.java.util.TreeSet(jvm.java.time.ZoneId.getAvailableZoneIds()).toString()[1:-1].split(", ")
    rules = jvm.java.util.HashMap()
    usual = [z for z in known if z in set(_known_zones())]
    return tuple(z for z in dict.fromkeys((*CANDIDATES, *usual)) if rules.putIfAbsent(jvm.java.time.ZoneId.of(z).getRules(), z) is None)


def choose_zones(rows: DataFrame, zones: DataFrame, candidates: Sequence[str] | None = None, block: int = 4096) -> DataFrame:
    """(_t_path, _t_zone, zone_from, violations, zoneless, readings) for files with zone-less times.

    zone_from is `file` where the record names the zone: that one history is laid and taken, whatever its violations.
    Elsewhere it is `estimate`, over `candidates` (all `histories` if not stated): _t_zone is the first of those with no
    violation, if they all give the same instants (readings 1), else null; violations are those of the best candidate.

    rows: _t_path, _t_order (place in the file), _t_ms, _t_local. The nearest known instants before and
    after each zone-less row are found in two levels, within blocks of `block` units of place and over
    the blocks' summaries, so one file of any length is spread over many tasks. A file without a zone that has
    no known instant at all, nor a time of storing, is left open without being tried.
    """
    asked = rows.filter(F.col("_t_local").isNotNull()).select("_t_path").distinct().join(zones, "_t_path", "left")
    part = rows.join(asked, "_t_path").withColumn("_t_block", F.floor(F.coalesce("_t_order", F.lit(0)) / block))
    inner = Window.partitionBy("_t_path", "_t_block").orderBy("_t_order", "_t_ms", "_t_local")
    back, ahead = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(1, Window.unboundedFollowing)
    near = part.select(
        "*", F.last("_t_ms", True).over(back).alias("_t_prev"), F.first("_t_ms", True).over(ahead).alias("_t_next")
    ).filter(F.col("_t_local").isNotNull())
    summary = part.groupBy("_t_path", "_t_block").agg(
        F.max_by("_t_ms", F.when(F.col("_t_ms").isNotNull(), F.struct("_t_order", "_t_ms"))).alias("_t_last"),
        F.min_by("_t_ms", F.when(F.col("_t_ms").isNotNull(), F.struct("_t_order", "_t_ms"))).alias("_t_first"),
    )
    outer = Window.partitionBy("_t_path").orderBy("_t_block")
    around = summary.select(
        "_t_path", "_t_block",
        F.last("_t_last", True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_t_before"),
        F.first("_t_first", True).over(outer.rowsBetween(1, Window.unboundedFollowing)).alias("_t_after"),
    )
    bounds = near.join(around, ["_t_path", "_t_block"], "left").select(
        "_t_path", "_t_zone", "_t_local", F.coalesce("_t_prev", "_t_before").alias("_t_low"), F.coalesce("_t_next", "_t_after").alias("_t_high"), "_t_stored"
    )
    # Rows of one file that say the same are one: a wall time with its bounds, and how often it comes.
    bounds = materialise(bounds.groupBy(*bounds.columns).agg(F.count("*").alias("_t_n")), "zoneless")
    # Each becomes as many rows as there are histories, which no size of the table tells beforehand.
    bounds = bounds.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_t_path", "_t_local")
    z = F.col("_t_try")
    names = F.array(*[F.lit(c) for c in candidates or histories()])
    tried = F.when(F.col("_t_zone").isNotNull(), F.array("_t_zone")).otherwise(names)
    bad = (
        F.coalesce((F.col("_t_at") < F.col("_t_low")).cast("int"), F.lit(0)) + F.coalesce((F.col("_t_at") > F.col("_t_high")).cast("int"), F.lit(0))
        + F.coalesce((F.col("_t_at") > F.col("_t_stored")).cast("int"), F.lit(0)) + F.when(F.col("_t_at").isNull(), zone_skips(F.col("_t_local"), z).cast("int")).otherwise(0)
    )
    scored = (
        bounds.select("*", F.posexplode(tried).alias("_t_rank", "_t_try"))
        .withColumn("_t_at", zone_instant(F.col("_t_local"), z))
        .groupBy("_t_path", "_t_rank", F.col("_t_try"), F.col("_t_zone").isNotNull().alias("_t_known"))
        .agg(F.sum(bad * F.col("_t_n")).alias("violations"), F.sum("_t_n").alias("zoneless"), F.sum(F.xxhash64("_t_local", "_t_at").cast("decimal(20,0)") * F.col("_t_n")).alias("_t_sum"),
             F.max(F.coalesce("_t_low", "_t_high", "_t_stored").isNotNull()).alias("_t_tied"))
    )
    least = F.min("violations").over(Window.partitionBy("_t_path"))
    chosen = (
        scored.withColumn("_t_least", least).filter(F.col("violations") == F.col("_t_least")).groupBy("_t_path", "_t_known")
        .agg(
            F.min_by("_t_try", "_t_rank").alias("_t_zone"), F.min("violations").alias("violations"), F.max("zoneless").alias("zoneless"),
            F.count_distinct("_t_sum").alias("readings"), F.max("_t_tied").alias("_t_tied"),
        )
    )
    settled = F.col("_t_known") | (F.col("_t_tied") & (F.col("violations") == 0) & (F.col("readings") == 1))
    return chosen.select(
        "_t_path", F.when(settled, F.col("_t_zone")).alias("_t_zone"), F.when(F.col("_t_known"), "file").otherwise("estimate").alias("zone_from"), "violations", "zoneless", "readings"
    )


def normalise(
    df: DataFrame, ts: str, path: str, order: str, sources: DataFrame, candidates: Sequence[str] | None = None, estimate: bool = True
) -> DataFrame:
    """df with utc_ms (bigint or null) and zone_from: text, file, estimate or null.

    Texts that carry their zone are not joined with anything; only zone-less ones meet the zones of their files.
    zone_from = 'estimate' marks instants that rest on an estimated zone, so that a caller for whom an
    unknown zone names no instant can leave them out. With `estimate`, df is read once and its parsed rows are
    written (hand in narrow rows); without, nothing is written and files without a recorded zone stay open.
    """
    df = df.drop("utc_ms", "zone_from", *[c for c in df.columns if c.startswith("_t_")])
    keep = df.columns
    if estimate:
        parsed = materialise(parse(df, ts).withColumns({"_t_path": F.col(path), "_t_order": F.col(order).cast("bigint")}), "parsed")
        own, local = parsed.filter("_t_local is null"), parsed.filter("_t_local is not null")
        zones = materialise(file_zones(sources), "file-zones")
        picked = choose_zones(parsed.select("_t_path", "_t_order", "_t_ms", "_t_local"), zones, candidates).select("_t_path", "_t_zone", F.col("zone_from").alias("_t_from"))
    else:
        zoneless = F.coalesce(F.trim(F.col(ts)).rlike(_ZONELESS), F.lit(False))
        own, local = parse(df.filter(~zoneless), ts), parse(df.filter(zoneless), ts).withColumn("_t_path", F.col(path))
        picked = file_zones(sources).select("_t_path", "_t_zone", F.lit("file").alias("_t_from"))
    own = own.select(*keep, F.col("_t_ms").alias("utc_ms"), F.when(F.col("_t_ms").isNotNull(), "text").alias("zone_from"))
    filed = local.join(picked, "_t_path", "left").select(
        *keep, zone_instant(F.col("_t_local"), F.col("_t_zone")).alias("utc_ms"), F.col("_t_from").alias("zone_from")
    )
    return own.unionByName(filed.withColumn("zone_from", F.when(F.col("utc_ms").isNotNull(), F.col("zone_from"))))


def canonical(utc_ms: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ of an instant, whatever the session's zone."""
    days = F.floor(utc_ms / _DAY_MS)
    rest = F.pmod(utc_ms, F.lit(_DAY_MS))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(
        F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd"), F.lit("T"), two(rest / 3_600_000), F.lit(":"),
        two(rest / 60_000 % 60), F.lit(":"), two(rest / 1000 % 60), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"),
    )
