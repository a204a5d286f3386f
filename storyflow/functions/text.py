"""Column expressions over text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed a single time per row, though later filters and columns use it.

    The optimiser moves a filter below the projection it looks at and computes the column for both; it can't move one below a
    generator. For expensive expressions over long texts only.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))

#: White space as scripting runtimes see it (wider than the regex class of the JVM).
WIDE_SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Fixed value: runs of letters and digits.
WORD = "[\\p{L}\\p{N}]+"


def clean_text(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(c, WIDE_SPACE + "+", " "))


def strip_nul(c: Column) -> Column:
    """Remove NUL characters."""
    return F.replace(c, F.lit("\u0000"), F.lit(""))


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def non_empty(c: Column) -> Column:
    """True for text that is neither null nor blank."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def truncate(c: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(c, 1, n)


def escape_xml(c: Column) -> Column:
    """The five XML entities, ampersand first; null becomes empty."""
    out = F.coalesce(c, F.lit(""))
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def word_count(c: Column) -> Column:
    """Substantive words: a letter or digit followed by at least one letter, digit, apostrophe or hyphen."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([\\p{L}\\p{N}][\\p{L}\\p{N}'-]+)"), F.lit(1)))


def lenient_json(c: Column) -> Column:
    """The text as a JSON variant, else the widest ``{...}`` span of it, else null."""
    span = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.when(span != "", span)))


def token_estimate(c: Column) -> Column:
    """Rough model tokens: one per 3.6 characters, rounded up."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(3.6))


#: Shapes of secrets that must not reach a log; what group 1 (and 2) holds stays.
SECRET_PATTERNS = (
    r"(?i)(bearer\s+)[a-z0-9._~+/=-]{8,}",
    r"(?i)((?:api[_-]?key|token|secret|password|passwd|authorization)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;&\[]{4,}",
    r"(\bsk-)[A-Za-z0-9_-]{8,}",
    r"(\bghp_)[A-Za-z0-9]{16,}",
    r"(\bxox[abprs]-)[A-Za-z0-9-]{8,}",
    r"(\bAIza)[A-Za-z0-9_-]{16,}",
    r"(\bAKIA)[A-Z0-9]{12,}",
    r"(\bgsk_)[A-Za-z0-9]{8,}",
    r"(\bnvapi-)[A-Za-z0-9_-]{8,}",
    r"(\bgithub_pat_)[A-Za-z0-9_]{8,}",
    r"(\bcsk-)[A-Za-z0-9_-]{8,}",
    r"(\btgp_v1_)[A-Za-z0-9_-]{8,}",
    r"(\brl_live_)[A-Za-z0-9]{8,}",
    r"(\bapf_)[A-Za-z0-9]{8,}",
    r"(://[^/\s:@]+:)[^@\s/]+@",
)


def redact_secrets(c: Column) -> Column:
    """Secrets are replaced by a marker; the label before them stays."""
    for p in SECRET_PATTERNS:
        c = F.regexp_replace(c, p, "$1[REDACTED]" + ("@" if p.endswith("@") else ""))
    return c


def retry_seconds(c: Column) -> Column:
    """Seconds to wait from ``retry-after: 30``, ``1h2m3s``, ``750ms``; null where none is named."""
    after = F.regexp_extract(F.lower(c), r"retry[- ]after[\"']?\s*[:=]?\s*(\d+(?:\.\d+)?)(?:\s*s(?:ec(?:ond)?s?)?)?(?:\b|$)", 1).try_cast("double")
    units = F.map_from_arrays(F.array(*map(F.lit, ("h", "m", "s", "ms"))), F.array(*map(F.lit, (3600.0, 60.0, 1.0, 0.001))))
    span = F.regexp_extract(F.lower(c), r"\b((?:\d+(?:\.\d+)?(?:ms|h|m|s))+)\b", 1)
    numbers = F.regexp_extract_all(span, F.lit(r"(\d+(?:\.\d+)?)(?:ms|h|m|s)"), F.lit(1))
    names = F.regexp_extract_all(span, F.lit(r"\d+(?:\.\d+)?(ms|h|m|s)"), F.lit(1))
    total = F.aggregate(F.zip_with(numbers, names, lambda n, u: n.try_cast("double") * F.try_element_at(units, u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(span != "", total).otherwise(after)


def mentions(c: Column, term: str) -> Column:
    """Lower-case text mentions a term; short terms of plain letters and digits must stand alone."""
    if len(term) <= 4 and term.isascii() and term.isalnum():
        return c.rlike(f"(^|[^a-z0-9]){term}([^a-z0-9]|$)")
    return F.contains(c, F.lit(term))


def mentions_any(c: Column, terms) -> Column:
    """True where at least one of the terms is mentioned."""
    hit = F.lit(False)
    for term in terms:
        hit |= mentions(c, term)
    return hit


def guard(c: Column, required=(), excluded=(), excluded_unless=()) -> Column:
    """Whether lower-case text passes a topic's lexical guard.

    Of every group of ``required`` a term must be mentioned and none of ``excluded``; for each (terms, rescue) of ``excluded_unless``
    none of the terms, unless a term of the rescue is mentioned too. Null gives null.
    """
    ok = c.isNotNull() | F.lit(None).cast("boolean")
    for group in required:
        ok &= mentions_any(c, group)
    ok &= ~mentions_any(c, excluded)
    for terms, rescue in excluded_unless:
        ok &= ~mentions_any(c, terms) | mentions_any(c, rescue)
    return ok


# Words too common to tell stories apart.
STOPWORDS = ("about", "after", "again", "amid", "before", "from", "have", "into", "more", "over", "says", "that", "their", "there", "they", "this", "under", "were", "what", "when", "with", "will")


def story_tokens(c: Column, most: int = 80) -> Column:
    """Distinct tokens of at least four characters that are no stop words, the first ``most`` of them."""
    parts = F.filter(F.split(F.lower(c), "[^a-z0-9+.-]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*STOPWORDS))
    return F.slice(F.array_distinct(parts), 1, most)


#: Spellings of units in Latin script and Chinese, and the name each stands for.
UNITS = {
    "%": "percent", "percent": "percent", "per cent": "percent", "pct": "percent", "prozent": "percent",
    "$": "usd", "usd": "usd", "dollars": "usd", "us dollars": "usd", "€": "eur", "eur": "eur", "euros": "eur", "£": "gbp", "gbp": "gbp",
    "k": "thousand", "thousand": "thousand", "m": "million", "mn": "million", "million": "million", "bn": "billion", "billion": "billion", "tn": "trillion", "trillion": "trillion",
    "万": "ten thousand", "亿": "hundred million", "万亿": "trillion", "元": "cny", "美元": "usd", "欧元": "eur",
    "mw": "megawatt", "gw": "gigawatt", "km": "kilometre", "tonnes": "tonne", "tons": "tonne",
}


def strong_tokens(title: Column, summary: Column, units: dict[str, str] = UNITS) -> Column:
    """Distinct acronyms of the title, and amounts of the summary as number and unit; all spellings of a unit give one token."""
    acronyms = F.regexp_extract_all(title, F.lit(r"(?:^|[^\p{L}\p{N}])([A-Z][A-Z0-9]{2,})(?:$|[^\p{L}\p{N}])"), F.lit(1))
    aliases = "|".join(re.escape(a) for a in sorted(units, key=lambda a: (-len(a), a)))
    amounts = F.regexp_extract_all(F.lower(summary), F.lit(rf"((?:[0-9][0-9.,]*[0-9]|[0-9])\s*(?:{aliases}))"), F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    number = lambda x: F.replace(F.regexp_extract(x, r"^([0-9.,]+)", 1), F.lit(","), F.lit(""))
    unit = lambda x: F.try_element_at(names, F.regexp_extract(x, r"^[0-9.,]+\s*(.*)$", 1))
    return F.array_distinct(F.concat(acronyms, F.transform(amounts, lambda x: F.concat_ws(" ", number(x), unit(x)))))


def strip_nul_json(c: Column) -> Column:
    """JSON text without escaped or plain NUL characters at any depth, in keys and values; an escaped backslash before ``u0000`` stays."""
    return F.regexp_replace(strip_nul(c), r"(?<!\\)((?:\\\\)*)\\u0000", "$1")


# --- settings given as text ---


def as_number(c: Column, default: float) -> Column:
    """A number, the default where there is none."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(float(default)))


def as_flag(c: Column, default: bool) -> Column:
    """True for 1, true, yes and on, false for 0, false, no and off, else the default."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("1", "true", "yes", "on"), True).when(v.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def as_list(c: Column) -> Column:
    """Trimmed entries between commas, without empty ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def as_limits(c: Column) -> Column:
    """``name:number`` entries between commas as a map; entries without a number are left out, of repeated names the last counts."""
    pairs = F.transform(as_list(c), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).try_cast("double").alias("v")))
    good = F.filter(pairs, lambda p: (p["k"] != "") & p["v"].isNotNull())
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def call_cost(tokens_in: Column, cached: Column, tokens_out: Column, rate_in: float, rate_cached: float, rate_out: float) -> Column:
    """Cost of a call from rates per million tokens; cached tokens are part of the input and have a rate of their own."""
    hit = F.least(F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)), F.coalesce(tokens_in, F.lit(0)))
    return ((F.coalesce(tokens_in, F.lit(0)) - hit) * rate_in + hit * rate_cached + F.coalesce(tokens_out, F.lit(0)) * rate_out) / 1_000_000
