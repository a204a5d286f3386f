import pytest
from pyspark.sql import functions as F

from storyflow.functions import text as T
from storyflow.functions.urls import address_key, guid_key, is_private_ip, story_url, url_host, url_safety
from storyflow.functions.vectors import cosine, dot, merge_centroid, parse_vector, unit, usable


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_clean_and_count(spark):
    assert column(spark, [" a \n b ", "", None, "﻿x"], T.clean_text) == ["a b", "", None, "x"]
    assert column(spark, ["it's a well-known fact 7 42", None, ""], T.word_count) == [4, 0, 0]
    assert column(spark, ["x" * 36, "x" * 37, None], T.token_estimate) == [10, 11, 0]
    assert column(spark, ['<a & "b">\'', None], T.escape_xml) == ["&lt;a &amp; &quot;b&quot;&gt;&apos;", ""]
    assert column(spark, ["a\u0000b"], T.strip_nul) == ["ab"]


def test_lenient_json(spark):
    got = column(spark, ['{"a": 1}', 'noise {"a": 2} tail', "none", None], lambda c: F.variant_get(T.lenient_json(c), "$.a", "int"))
    assert got == [1, 2, None, None]


def test_redaction(spark):
    lines = ["Authorization: Bearer abcdefgh1234", "api_key=s3cr3tvalue", "sk-abcdefgh12345", "https://u:pw@h.example/x", "ghp_abcdefghijklmnop1234", None]
    got = column(spark, lines, T.redact_secrets)
    assert all(x is None or "[REDACTED]" in x for x in got)
    assert not any(s in (x or "") for x in got for s in ("abcdefgh1234", "s3cr3t", "pw@"))


def test_retry(spark):
    assert column(spark, ["Retry-After: 30", "try again in 1h2m3s", "wait 750ms", "no hint", None], T.retry_seconds) == [30.0, 3723.0, 0.75, None, None]


def test_mentions(spark):
    assert column(spark, ["an ai tool", "said", "ai", None], lambda c: T.mentions(c, "ai")) == [True, False, True, None]


def test_urls(spark):
    assert column(spark, ["https://www.A.example/x", "nothing", None], url_host) == ["a.example", None, None]
    assert column(spark, ["HTTPS://a.example/x/?utm_source=r&b=2&fbclid=9#t", "https://a.example/", None], story_url) == ["https://a.example/x?b=2", "https://a.example", None]
    same = ["http://www.a.example:80/P%41th/?b=2&a=1", "https://a.example:443/path?a=1&b=2&utm_term=x#f", "//m.a.example/path?a=1&b=2", " HTTPS://A.example/path/?a=1&b=2&mc_eid=4\n"]
    assert len(set(column(spark, same, address_key))) == 1
    assert column(spark, ["https://a.example/", "https://a.example/?utm_source=x", "", None, "https://a.example:8080/x"], address_key) == [None, None, None, None, "a.example:8080/x"]
    assert column(spark, ["https://a.example/100%", "https://a.example/a+b"], address_key) == ["a.example/100%", "a.example/a+b"]


def test_guid_key(spark):
    key = lambda c: guid_key(F.lit("H.example"), c)
    a = column(spark, ["{AB-1}", "urn:uuid:ab-1", " AB-1\n", "-", "", None, "null"], key)
    assert len(set(a[:3])) == 1 and a[3:] == [None] * 4
    assert column(spark, ["x1"], lambda c: guid_key(F.lit(None).cast("string"), c)) == [None]


@pytest.mark.parametrize("ips, want", [(["10.1.2.3", "127.0.0.1", "169.254.1.1", "192.168.0.9", "::1", "fe80::1", "::ffff:10.0.0.1", "100.64.0.1"], True), (["8.8.8.8", "172.32.0.1", "2606:4700::1", "999.1.1.1", "a.example"], False)])
def test_private(spark, ips, want):
    assert column(spark, ips, is_private_ip) == [want] * len(ips)


def test_url_safety(spark):
    urls = ["https://a.example/x", "http://a.example", "https://u:p@a.example", "https://localhost/", "https://127.0.0.1:8443/x", "https://[::1]/", "ftp://a.example", "x", None, "https://db.internal"]
    assert column(spark, urls, url_safety) == ["ok", "scheme", "credentials", "host", "host", "host", "scheme", "no_url", "no_url", "host"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(dot(F.col("a"), F.col("b")).alias("d"), cosine(F.col("a"), F.col("b")).alias("c"), unit(F.col("a")).alias("u"), usable(F.col("a"), 2).alias("ok")).collect()
    assert (r[0].d, round(r[0].c, 9), r[0].u, r[0].ok) == (3.0, 0.6, [0.6, 0.8], True)
    assert r[1].c is None and r[1].u == [0.0, 0.0] and not r[1].ok and r[2].d is None and not r[2].ok
    assert spark.range(1).select(parse_vector(F.lit("[1,2.5]")), merge_centroid(F.array(F.lit(1.0), F.lit(0.0)), F.lit(1), F.array(F.lit(0.0), F.lit(1.0)))).first()[0] == [1.0, 2.5]


def test_feed_times(spark):
    from storyflow.streaming.ingest import feed_time

    texts = ["Sun, 05 Oct 2025 01:00:00 GMT", "5 Oct 25 01:00 UT", "Sun, 05 Oct 2025 03:00:00 +0200", "04 Oct 2025 21:00:00 EDT", "2025-10-05T01:00:00Z", "Sunday, 05-Oct-25 01:00:00 GMT", "soon", "32 Oct 2025 01:00:00 GMT", "05 Oct 2025 01:00:00 XYZ", None, ""]
    got = column(spark, texts, lambda c: F.unix_seconds(feed_time(c)))
    assert got == [1759626000] * 6 + [None] * 5


def test_settings(spark):
    assert column(spark, [" 4 ", "x", None, ""], lambda c: T.as_number(c, 7)) == [4.0, 7.0, 7.0, 7.0]
    assert column(spark, ["YES", "0", "?", None], lambda c: T.as_flag(c, True)) == [True, False, True, True]
    assert column(spark, ["a, ,b", "", None], T.as_list) == [["a", "b"], [], []]
    assert column(spark, ["a:1,b:x,a:3, c : 2 ,:5,d", "", None], T.as_limits) == [{"a": 3.0, "c": 2.0}, {}, {}]


def test_nul_free_json(spark):
    assert column(spark, [r'{"a\u0000":"\u0000x","b":["\\u0000","\\\u0000y"]}', None], T.strip_nul_json) == [r'{"a":"x","b":["\\u0000","\\y"]}', None]


def test_strong_tokens(spark):
    df = spark.createDataFrame([("ACME and NASA win", "3,000 US dollars, 12.5% and 5 pct; 3亿元, 40 GW."), (None, "5 %"), ("x", None)], "t string, s string")
    got = [r[0] for r in df.select(T.strong_tokens(F.col("t"), F.col("s"))).collect()]
    assert got[0] == ["ACME", "NASA", "3000 usd", "12.5 percent", "5 percent", "3 hundred million", "40 gigawatt"] and got[1:] == [None, None]


def test_call_cost(spark):
    df = spark.createDataFrame([(100, 40, 10), (100, 400, None), (None, None, 5)], "i long, c long, o long")
    assert [round(r[0] * 1e6) for r in df.select(T.call_cost(F.col("i"), F.col("c"), F.col("o"), 3.0, 0.3, 15.0)).collect()] == [342, 30, 75]


def test_expensive_columns_are_computed_once(spark):
    df = T.once(spark.range(3), "w", F.split(F.concat(F.lit("a b "), F.col("id").cast("string")), " ")).filter("size(w) > 2").select("id", F.size("w").alias("n"))
    assert [r.n for r in df.collect()] == [3, 3, 3] and df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
