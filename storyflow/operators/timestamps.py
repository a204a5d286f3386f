"""Mixed timestamp spellings and zones resolved to one UTC instant.

A value contributes to the likelihood of its source under every spelling it can be read in. Per
source an expectation-maximisation over the mixture of spellings gives posteriors; a value is
settled by the reading whose posterior reaches ``min_posterior`` and is otherwise kept as
``ambiguous``. All parsing is done by built-in expressions; only the mixture weights, whose
input is aggregated to counts per source and set of readings, run in pandas.

Defined results: null, empty and unusable text -> status ``unusable``; text without a zone whose
feed names no usable zone -> ``no_zone``; repeated rows are kept as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Names of months in the five languages, by number.
MONTHS = (
    ("JAN", "JANUARY", "ENE", "ENERO", "JANV", "JANVIER", "JANEIRO", "JANUAR", "JÄNNER"),
    ("FEB", "FEBRUARY", "FEBRERO", "FÉVR", "FÉVRIER", "FEV", "FEVEREIRO", "FEBRUAR"),
    ("MAR", "MARCH", "MARZO", "MARS", "MARÇO", "MÄR", "MÄRZ"),
    ("APR", "APRIL", "ABR", "ABRIL", "AVR", "AVRIL"),
    ("MAY", "MAYO", "MAI", "MAIO"),
    ("JUN", "JUNE", "JUNIO", "JUIN", "JUNHO", "JUNI"),
    ("JUL", "JULY", "JULIO", "JUIL", "JUILLET", "JULHO", "JULI"),
    ("AUG", "AUGUST", "AGO", "AGOSTO", "AOÛT"),
    ("SEP", "SEPT", "SEPTEMBER", "SEPTIEMBRE", "SEPTEMBRE", "SET", "SETEMBRO"),
    ("OCT", "OCTOBER", "OCTUBRE", "OCTOBRE", "OUT", "OUTUBRO", "OKT", "OKTOBER"),
    ("NOV", "NOVEMBER", "NOVIEMBRE", "NOVEMBRE", "NOVEMBRO"),
    ("DEC", "DECEMBER", "DIC", "DICIEMBRE", "DÉC", "DÉCEMBRE", "DEZ", "DEZEMBRO", "DEZEMBER"),
)
# Zone abbreviations and their minutes from UTC.
ZONE_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600, "NST": -210, "NDT": -150, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NPT": 345, "ART": -180, "BRT": -180,
}
# Abbreviations with two meanings; the first is the commoner.
ZONE_EITHER = {"IST": (330, 60), "CST": (-360, 480), "BST": (60, 360), "AST": (-240, 180)}

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|[A-Z]{2,5}|(?:GMT|UTC)?[+-]\d{1,2}(?::?\d{2})?)?"
#: Spelling -> (pattern over upper-case text, year|month|day|hour|minute|second|fraction|zone|half of day).
SPELLINGS = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME} ?{_ZONE}(?:\[[^\]]*\])?$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    "slash_ymd": (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[T ]{_TIME} ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}})?(?:\.(\d{{1,9}}))? ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    "dotted_dmy": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?[T ]{_TIME} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    "mail": (rf"^(?:[A-Z]{{2,9}}\.?, ?)?(\d{{1,2}})[ -]([^\d\s,.-]{{3,10}})\.?[ -](\d{{4}}),? {_TIME} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    "month_first": (rf"^(?:[A-Z]{{2,9}}\.?, ?)?([^\d\s,.]{{3,10}})\.? (\d{{1,2}}),? (\d{{4}}),? {_TIME} ?([AP]M)? ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    "de_month": (rf"^(?:[^\d,]{{2,10}}, ?)?(\d{{1,2}}) DE ([^\d\s,.]{{3,10}}) DE (\d{{4}}),? (?:A LAS |ÀS )?{_TIME} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    "slash_dmy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?[T ]{_TIME} ?([AP]M)? ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
}
#: Second readings: spelling -> (name of the reading, its field order).
EITHER = {"slash_dmy": ("slash_mdy", "$3|$1|$2|$4|$5|$6|$7|$9|$8")}
_EPOCH = r"^\d{9,10}$|^\d{12,13}$|^\d{15,16}$|^\d{18,19}$"


def ntz_ms(ntz: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone that means UTC, whatever the session's zone."""
    s = F.unix_date(ntz.cast("date")).cast("long") * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60
    return s * 1000 + F.floor(F.extract(F.lit("SECOND"), ntz) * 1000).cast("long")


def feed_zones(feeds: DataFrame) -> DataFrame:
    """One row per feed with a usable zone: ``feed_id``, ``zone_offset_min``, ``zone_name`` (one of the two).

    Offsets are read in any common spelling; zone names must be known to the JVM. Feeds listed twice
    are merged; feeds with null or useless text are left out.
    """
    spark = feeds.sparkSession
    known = sorted(z for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)
    zones = spark.createDataFrame(pd.DataFrame({"_zone": [z.upper() for z in known], "zone_name": known}))
    z = F.regexp_replace(F.upper(F.regexp_replace(F.col("timezone_gmt"), r"^\s+|\s+$", "")), "[−–]", "-")
    z = F.regexp_replace(F.replace(z, F.lit("±"), F.lit("+")), r"^(GMT|UTC|UT)(?=.)\s*|^(GMT|UTC|UT|Z)$", "+")
    z = F.regexp_replace(F.regexp_replace(z, r"^\+\s*(?=[+-])", ""), r"^\+$", F.lit("+"))
    bare = F.upper(F.trim("timezone_gmt")).isin("GMT", "UTC", "UT", "Z")
    sign, hour, minute = (F.regexp_extract(z, r"^([+-])\s*(\d{1,2})(?::?(\d{2}))?$", i) for i in (1, 2, 3))
    minutes = F.when(bare, F.lit(0)).when((hour != "") & (hour.try_cast("int") <= 14), F.when(sign == "-", -1).otherwise(1) * (hour.try_cast("int") * 60 + F.coalesce(minute.try_cast("int"), F.lit(0))))
    rows = feeds.select("feed_id", minutes.alias("zone_offset_min"), F.upper(F.trim("timezone_gmt")).alias("_zone"))
    rows = rows.join(F.broadcast(zones), "_zone", "left").groupBy("feed_id").agg(F.max("zone_name").alias("zone_name"), F.max("zone_offset_min").alias("zone_offset_min"))
    return rows.filter("feed_id is not null and (zone_name is not null or zone_offset_min is not null)")


def _month_map() -> Column:
    return F.create_map(*[F.lit(x) for n, names in enumerate(MONTHS, 1) for m in names for x in (m, n)])


def _minutes(sign: str, hour: str, minute: str) -> Column:
    return F.when(F.col(sign) == "-", -1).otherwise(1) * (F.col(hour).try_cast("int") * 60 + F.coalesce(F.col(minute).try_cast("int"), F.lit(0)))


def _add_reading(df: DataFrame, tag: str, parts: str, name: Column, zone_second: Column) -> DataFrame:
    """Add the column ``tag``: struct (fmt, utc_ms, no_zone) of one reading of the split text ``parts``.

    Built in steps, so that each intermediate value is computed once per row.
    """
    c = lambda x: f"_{tag}_{x}"
    col = lambda x: F.col(c(x))
    g = lambda i: F.try_element_at(F.col(parts), F.lit(i + 1))
    df = df.withColumns({
        c("mo"): F.coalesce(g(1).try_cast("int"), F.try_element_at(_month_map(), g(1))),
        c("h0"): g(3).try_cast("int"), c("mi"): g(4).try_cast("int"), c("zone"): g(7), c("pm"): g(8),
        c("s"): F.when(g(5) == "", 0).otherwise(g(5).try_cast("int")),
        c("frac"): F.when(g(6) == "", 0).otherwise(F.rpad(F.substring(g(6), 1, 3), 3, "0").try_cast("int")),
    })
    df = df.withColumns({
        c("day"): F.concat(g(0), F.lit("-"), F.lpad(col("mo").cast("string"), 2, "0"), F.lit("-"), F.lpad(g(2), 2, "0")).try_cast("date"),
        c("h"): F.when(col("pm") == "", col("h0")).when(col("h0").between(1, 12), col("h0") % 12 + F.when(col("pm") == "PM", 12).otherwise(0)),
        c("num"): F.split(F.regexp_replace(col("zone"), r"^(?:GMT|UTC)?([+-])(\d{1,2}?)(?::?(\d{2}))?$", "$1|$2|$3"), r"\|", -1),
    })
    df = df.withColumns({
        c("sign"): F.try_element_at(col("num"), F.lit(1)), c("oh"): F.try_element_at(col("num"), F.lit(2)), c("om"): F.try_element_at(col("num"), F.lit(3)),
        c("good"): col("day").isNotNull() & col("h").between(0, 23) & col("mi").between(0, 59) & col("s").between(0, 59),
        c("local"): F.unix_date(col("day")).cast("long") * 86400 + col("h") * 3600 + col("mi") * 60 + col("s"),
    })
    named = F.create_map(*[F.lit(x) for k, v in (ZONE_MINUTES | {k: v[0] for k, v in ZONE_EITHER.items()}).items() for x in (k, v)])
    other = F.create_map(*[F.lit(x) for k, v in ZONE_EITHER.items() for x in (k, v[1])])
    good_offset = (col("oh").try_cast("int") <= 18) & (F.coalesce(col("om").try_cast("int"), F.lit(0)) < 60)
    ntz = F.when(F.col("zone_name").isNotNull() & (col("zone") == "") & col("good"), F.concat_ws(" ", col("day").cast("string"), F.format_string("%02d:%02d:%02d", col("h"), col("mi"), col("s"))).try_cast("timestamp_ntz"))
    df = df.withColumns({
        c("off"): F.when(good_offset, _minutes(c("sign"), c("oh"), c("om"))).when(zone_second, F.try_element_at(other, col("zone"))).otherwise(F.try_element_at(named, col("zone"))),
        c("utc"): F.convert_timezone(F.col("zone_name"), F.lit("UTC"), ntz),
    })
    utc = col("utc")
    utc_s = F.unix_date(utc.cast("date")).cast("long") * 86400 + F.hour(utc) * 3600 + F.minute(utc) * 60 + F.second(utc)
    by_feed = F.when(F.col("zone_name").isNotNull(), utc_s).otherwise(col("local") - F.col("zone_offset_min") * 60)
    secs = F.when(col("good"), F.when(col("zone") == "", by_feed).otherwise(col("local") - col("off") * 60))
    missing = col("good") & (col("zone") == "") & F.col("zone_name").isNull() & F.col("zone_offset_min").isNull()
    return df.withColumn(tag, F.struct(name.alias("fmt"), (secs * 1000 + col("frac")).cast("long").alias("utc_ms"), F.coalesce(missing, F.lit(False)).alias("no_zone")))


def alternatives(value: Column) -> Column:
    """The spellings a time text fits: array of (name, field order applied to the text, second meaning of its zone)."""
    u = F.regexp_replace(F.upper(F.regexp_replace(value, r"^\s+|\s+$", "")), r"\s+", " ")
    return F.transform(F.array(u), _fits)


def _fits(u: Column) -> Column:
    def alt(name: str, order: str, pattern: str) -> Column:
        return F.struct(F.lit(name).alias("fmt"), F.regexp_replace(u, pattern, order).alias("text"))

    out = F.array().cast("array<struct<fmt:string,text:string>>")
    for name, (pattern, order) in reversed(SPELLINGS.items()):
        both = [alt(name, order, pattern)] + ([alt(EITHER[name][0], EITHER[name][1], pattern)] if name in EITHER else [])
        out = F.when(u.rlike(pattern), F.array(*both)).otherwise(out)
    return F.when(u.rlike(_EPOCH), F.array(F.struct(F.lit("epoch").alias("fmt"), u.alias("text")))).otherwise(out)


def _epoch_ms(text: Column) -> Column:
    digits, n = F.length(text), text.try_cast("long")
    return F.when(digits <= 10, n * 1000).when(digits <= 13, n).when(digits <= 16, F.floor(n / 1000)).otherwise(F.floor(n / 1000000)).cast("long")


def parse_readings(values: DataFrame) -> DataFrame:
    """One row per value and possible reading: adds fmt, utc_ms, no_zone to ``values`` (which has raw and the feed's zone).

    A value that fits no spelling gives one row with null fmt.
    """
    keep = [c for c in values.columns if c != "raw"]
    either = list(ZONE_EITHER)
    df = values.withColumn("_alts", F.flatten(alternatives(F.col("raw")))).select(*keep, F.explode_outer("_alts").alias("_alt"))
    df = df.select(*keep, F.col("_alt.fmt").alias("_fmt"), F.col("_alt.text").alias("_text"), F.split("_alt.text", r"\|", -1).alias("_parts"))
    second = F.when(F.try_element_at("_parts", F.lit(8)).isin(either), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    df = df.select("*", F.explode(second).alias("_second"))
    df = df.withColumn("_name", F.when(F.col("_second"), F.concat("_fmt", F.lit("+zone"))).otherwise(F.col("_fmt")))
    df = _add_reading(df, "r", "_parts", F.col("_name"), F.col("_second"))
    epoch = F.col("_fmt") == "epoch"
    return df.select(
        *keep, F.when(epoch, F.concat(F.lit("epoch_"), F.length("_text").cast("string"))).otherwise(F.col("_name")).alias("fmt"),
        F.when(epoch, _epoch_ms(F.col("_text"))).otherwise(F.col("r.utc_ms")).alias("utc_ms"), (~F.coalesce(epoch, F.lit(False)) & F.col("r.no_zone")).alias("no_zone"),
        (F.col("_second") | F.col("_fmt").isin([*EITHER, *[x for x, _ in EITHER.values()]]) | F.coalesce(F.try_element_at("_parts", F.lit(8)).isin(either), F.lit(False))).alias("_either"),
    )


#: Rounds of the expectation-maximisation at most, and pseudo-count of every spelling.
EM_ROUNDS, EM_PRIOR = 50, 0.5


def _em(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mixture weights of one source from counts per set of readings."""
    sets = [(s.split(" "), n) for s, n in zip(pdf.sig, pdf.n)]
    names = sorted({x for s, _ in sets for x in s})
    w = dict.fromkeys(names, 1 / len(names))
    for _ in range(EM_ROUNDS):
        got = dict.fromkeys(names, EM_PRIOR)
        for s, n in sets:
            z = sum(w[x] for x in s)
            for x in s:
                got[x] += n * w[x] / z
        total = sum(got.values())
        new = {x: v / total for x, v in got.items()}
        done = max(abs(new[x] - w[x]) for x in names) < 1e-9
        w = new
        if done:
            break
    return pd.DataFrame({"source": pdf.source.iloc[0], "fmt": names, "weight": [w[x] for x in names]})


def format_mixture(sets: DataFrame) -> DataFrame:
    """Mixture of spellings per source, (source, fmt, weight), from rows (source, sig, n); sig lists the readings of a value.

    Counts come aggregated, so a source with a third of all rows sends only its few distinct sets of
    readings; a group holds at most the number of such sets.
    """
    return sets.groupBy("source").applyInPandas(_em, "source string, fmt string, weight double")


def resolve_instants(rows: DataFrame, feeds: DataFrame, fields: list[str], keys: list[str], source: str = "source_host", min_posterior: float = 0.95) -> DataFrame:
    """One row per input row and field: ``keys``, source, field, utc_ms (or null), status, fmt, posterior.

    Status: ``canonical``, ``resolved``, ``ambiguous``, ``no_zone`` or ``unusable``. ``keys`` identify a row.
    """
    zones = feed_zones(feeds).withColumnRenamed("feed_id", "_feed")
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]))
    long = rows.select(*keys, F.col(source).alias("source"), each)
    is_canonical = F.coalesce(F.col("raw").rlike(CANONICAL), F.lit(False))
    cols = [*keys, "source", "field", "fmt", "utc_ms", "no_zone", "_either"]
    ntz = F.translate(F.substring("raw", 1, 23), "T", " ").try_cast("timestamp_ntz")
    canonical = long.filter(is_canonical).select(*keys, "source", "field", F.lit("canonical").alias("fmt"), ntz_ms(ntz).alias("utc_ms"), F.lit(False).alias("no_zone"), F.lit(False).alias("_either"))
    other = long.filter(~is_canonical).join(zones, F.col("source") == F.col("_feed"), "left").drop("_feed")
    parsed = materialize(canonical.unionByName(parse_readings(other).select(*cols)), "instants")
    usable = F.col("utc_ms").isNotNull() | F.col("no_zone")
    # values with one reading are settled; the others are brought together per value and weighed
    one = parsed.filter(~F.coalesce(F.col("_either"), F.lit(False)))
    ident = [*keys, "source", "field"]
    sets = parsed.filter("_either").groupBy(*ident).agg(F.sort_array(F.collect_set(F.when(usable, F.struct("fmt", "utc_ms", "no_zone")))).alias("r"))
    sets = sets.withColumn("r", F.when(F.size(F.array_distinct(F.transform("r", lambda x: x["utc_ms"]))) == 1, F.slice("r", 1, 1)).otherwise(F.col("r")))
    counts = one.filter("fmt is not null").groupBy(F.coalesce("source", F.lit("")).alias("source"), F.col("fmt").alias("sig")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(sets.filter("size(r) > 0").groupBy(F.coalesce("source", F.lit("")).alias("source"), F.concat_ws(" ", F.transform("r", lambda x: x["fmt"])).alias("sig")).agg(F.count("*").alias("n")))
    weights = format_mixture(counts).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("fmt", "weight"))).alias("weights"))
    weighed = sets.join(weights.withColumnRenamed("source", "_source"), F.coalesce("source", F.lit("")) == F.col("_source"), "left")
    weighed = weighed.withColumn("r", F.transform("r", lambda x: F.struct(F.coalesce(F.try_element_at("weights", x["fmt"]), F.lit(0.0)).alias("w"), x["utc_ms"].alias("utc_ms"), x["fmt"].alias("fmt"), x["no_zone"].alias("no_zone"))))
    weighed = weighed.select(*ident, F.array_max("r").alias("b"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x["w"]).alias("total"))
    posterior = F.try_divide(F.col("b.w"), F.col("total"))
    settled = weighed.select(*ident, F.col("b.utc_ms").alias("utc_ms"), F.col("b.fmt").alias("fmt"), F.col("b.no_zone").alias("no_zone"), posterior.alias("posterior"))
    out = one.select(*ident, "utc_ms", "fmt", "no_zone", F.when(usable, F.lit(1.0)).alias("posterior")).unionByName(settled)
    sure = F.col("posterior") >= min_posterior
    status = F.when(F.col("posterior").isNull(), "unusable").when(~sure, "ambiguous").when(F.col("no_zone"), "no_zone").when(F.col("fmt") == "canonical", "canonical").otherwise("resolved")
    return out.select(*ident, F.when(sure, F.col("utc_ms")).alias("utc_ms"), status.alias("status"), "fmt", F.round("posterior", 6).alias("posterior"))
