"""Column expressions over web addresses, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Parameters that only track a reader.
TRACKING_PARAM = "^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$"


def url_host(c: Column) -> Column:
    """Lower-case host without a leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def story_url(c: Column) -> Column:
    """A story address in lower case without fragment, tracking parameters and one closing slash; parameters keep their order."""
    u = F.regexp_replace(F.lower(F.trim(c)), "#.*$", "")
    base = F.regexp_replace(F.substring_index(u, "?", 1), "/$", "")
    params = F.array_join(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING_PARAM)), "&")
    return F.concat(base, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))


#: IPv4 ranges that are not public, as (network, prefix length).
PRIVATE_V4 = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))


def ip_number(c: Column) -> Column:
    """A dotted IPv4 address as a number, else null."""
    parts = F.split(c, r"\.")
    n = F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), n)


def is_private_ip(c: Column) -> Column:
    """True for an IPv4 or IPv6 address that no public server has."""
    n = ip_number(c)
    v4 = F.lit(False)
    for net, bits in PRIVATE_V4:
        start = 0
        for octet in net.split("."):
            start = start * 256 + int(octet)
        v4 |= n.between(start, start + (1 << (32 - bits)) - 1)
    low = F.lower(c)
    mapped = F.regexp_extract(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    inner = ip_number(mapped)
    m4 = F.lit(False)
    for net, bits in PRIVATE_V4:
        start = 0
        for octet in net.split("."):
            start = start * 256 + int(octet)
        m4 |= inner.between(start, start + (1 << (32 - bits)) - 1)
    v6 = low.isin("::", "::1") | low.rlike(r"^f[cd]|^fe[89ab]|^ff") & F.contains(low, F.lit(":")) | low.rlike(r"^2001:db8:")
    return F.coalesce(v4, F.lit(False)) | F.coalesce(v6, F.lit(False)) | F.coalesce(m4, F.lit(False))


def url_safety(c: Column, allow_http: bool = False) -> Column:
    """``ok`` or why an address may not be fetched: no_url, scheme, credentials, host."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r"(?<=[^:]):\d*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^\[|\](?::\d*)?$", ""), r"\.$", "")
    bad_host = (host == "") | host.isin("localhost") | host.rlike(r"\.(localhost|local|internal|lan|home|corp)$") | is_private_ip(host) | ~(F.contains(host, F.lit(".")) | F.contains(host, F.lit(":")))
    good_scheme = scheme.isin("https", "http") if allow_http else scheme == "https"
    return F.when(F.coalesce(scheme, F.lit("")) == "", "no_url").when(~good_scheme, "scheme").when(F.contains(authority, F.lit("@")), "credentials").when(bad_host, "host").otherwise("ok")


def _decode(c: Column) -> Column:
    """Percent escapes resolved; text whose escapes are malformed stays as it is."""
    plain = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.lower(F.when(F.instr(c, "%") > 0, F.coalesce(F.try_url_decode(plain), c)).otherwise(c))


def address_key(c: Column) -> Column:
    """One key for all spellings of an address; null where it names no article.

    Ignored: letter case, scheme, default port, a leading ``www.`` or ``m.``, escapes, one closing
    slash of the path, fragment, order of parameters, tracking parameters. An address with neither
    path nor parameters (a front page), a null and a blank give null.
    """
    def bare(u: Column) -> Column:
        """Without default port and scheme."""
        plain = F.when(F.startswith(u, F.lit("http://")), F.regexp_replace(u, r"^http://([^/?]*?):80(?=[/?]|$)", "http://$1")).when(F.startswith(u, F.lit("https://")), F.regexp_replace(u, r"^https://([^/?]*?):443(?=[/?]|$)", "https://$1")).otherwise(u)
        return F.regexp_replace(plain, r"^([a-z][a-z0-9+.-]*:)?//", "")

    def parts(u: Column) -> Column:
        params = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_replace(p, "=.*$", "").rlike(TRACKING_PARAM))
        return F.struct(
            F.regexp_replace(F.regexp_extract(u, r"^([^/?]*)", 1), r"^(www|m)\.", "").alias("host"), let(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), lambda p: F.regexp_replace(_decode(p), "/$", "")).alias("path"),
            F.array_join(F.array_sort(F.transform(params, _decode)), "&").alias("params"),
        )

    def key(p: Column) -> Column:
        return F.when((p["host"] != "") & ((p["path"] != "") | (p["params"] != "")), F.concat(p["host"], p["path"], F.when(p["params"] != "", F.concat(F.lit("?"), p["params"])).otherwise("")))

    return let(F.regexp_replace(F.lower(c), r"^\s+|\s*(#.*)?$", ""), lambda u: let(bare(u), lambda v: let(parts(v), key)))


#: Texts put where an identifier was missing.
GUID_FILLERS = ("-", "--", "0", "null", "undefined", "none", "nil", "nan", "n/a", "na", "unknown", "guid", "id", "?", "00000000-0000-0000-0000-000000000000")


def guid_key(host: Column, guid: Column) -> Column:
    """One key for all spellings of an item identifier within its host; null where it names no article."""
    g = F.lower(guid)
    g = F.trim(F.regexp_replace(g, r"^[{\s]*(urn:uuid:)?[{\s]*|[}\s]+$", ""))
    return F.when(host.isNotNull() & (g != "") & ~g.isin(*GUID_FILLERS), F.concat(F.lower(host), F.lit(" "), g))
