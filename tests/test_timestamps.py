import pytest
from storyflow.operators.late_events import HOUR_MS, LambdaViews, arrivals
from storyflow.operators.timestamps import feed_zones, resolve_instants

FEEDS = [("b", "Europe/Berlin"), ("b", "Europe/Berlin"), ("m", " GMT−3:30 "), ("u", "UTC±0"), ("x", "see site"), ("p", "GMT+"), ("o", "+0545"), ("z", "Nowhere/Town"), ("n", None)]


def feeds(spark):
    return spark.createDataFrame(FEEDS, "feed_id string, timezone_gmt string")


def test_feed_zones(spark):
    got = {r.feed_id: (r.zone_name, r.zone_offset_min) for r in feed_zones(feeds(spark)).collect()}
    assert got == {"b": ("Europe/Berlin", None), "m": (None, -210), "u": (None, 0), "o": (None, 345)}


def test_forms(spark):
    rows = [
        (1, "b", "2025-10-26 02:30:00", 1761438600000, "resolved"),  # occurs twice: the first
        (2, "b", "2025-03-30T02:30:00", 1743298200000, "resolved"),  # skipped: offset before the change
        (3, "b", "2025-10-05T01:00:00.000Z", 1759626000000, "canonical"),
        (4, "b", "  2025-10-05t01:00:00z ", 1759626000000, "resolved"),
        (5, "m", "05.10.2025 01:00", 1759638600000, "resolved"),
        (6, "x", "05.10.2025 01:00", None, "no_zone"),
        (7, "x", "Sun, 05 Oct 2025 01:00:00 CEST", 1759618800000, "resolved"),
        (8, "x", "Oct 5, 2025 12:05 AM", None, "no_zone"),
        (9, "u", "October 5, 2025 12:05 PM", 1759665900000, "resolved"),
        (10, "x", "1759626000", 1759626000000, "resolved"),
        (11, "x", "1759626000123999", 1759626000123, "resolved"),
        (12, "x", "2025-10-05", None, "unusable"),
        (13, "x", "2025-13-05 08:00", None, "unusable"),
        (14, "u", "2025-02-30 08:00", None, "unusable"),
        (15, "u", "2025-10-05 24:00", None, "unusable"),
        (16, "u", "5 de octubre de 2025, 01:00", 1759626000000, "resolved"),
        (17, "x", None, None, "unusable"),
        (18, "x", "", None, "unusable"),
        (19, None, "20251005T010000Z", 1759626000000, "resolved"),
        (20, "u", "2025-10-05T01:00+05:45[Asia/Kathmandu]", 1759605300000, "resolved"),
        (21, "x", "2025-10-05T01:00:00.123456789Z", 1759626000123, "resolved"),
        (22, "x", "0000-00-00 00:00:00", None, "unusable"),
    ]
    df = spark.createDataFrame([(i, s, v, "clash") for i, s, v, _, _ in rows], "article_id long, source_host string, t string, fmt string")
    got = {r.article_id: (r.utc_ms, r.status) for r in resolve_instants(df, feeds(spark), ["t"], ["article_id"]).collect()}
    assert got == {i: (ms, st) for i, _, _, ms, st in rows}


def test_mixture_settles_day_and_month(spark):
    """A source whose other values fix the order settles 03/04; one without any stays ambiguous."""
    rows = [(i, "dmy", f"{13 + i}/04/2025 10:00 UTC") for i in range(12)] + [(50, "dmy", "03/04/2025 10:00 UTC"), (51, "none", "03/04/2025 10:00 UTC"), (52, "none", "05/05/2025 10:00 UTC")]
    df = spark.createDataFrame(rows, "article_id long, source_host string, t string")
    got = {r.article_id: (r.utc_ms, r.status) for r in resolve_instants(df, feeds(spark), ["t"], ["article_id"]).collect()}
    assert got[50] == (1743674400000, "resolved") and got[51] == (None, "ambiguous") and got[52][1] == "resolved"


def test_empty_table(spark):
    df = spark.createDataFrame([], "article_id long, source_host string, t string")
    assert resolve_instants(df, feeds(spark), ["t"], ["article_id"]).count() == 0


def test_lambda_views(spark):
    h = HOUR_MS
    log = [("a", 100 * h + 5, 100 * h + 10), ("a", 100 * h + 6, 104 * h), ("a", 100 * h + 7, 180 * h), ("a", 101 * h, 90 * h), ("b", 100 * h, None), (None, None, 5), ("b", 103 * h + 1, 105 * h + 1)]
    df = arrivals(spark.createDataFrame(log, "key string, event_ms long, seen_ms long"), "event_ms", "seen_ms")
    views = LambdaViews(spark)
    views.ingest(df.filter("key = 'a'"))
    views.ingest(df.filter("key = 'b'"))
    state = lambda: {(r.key, r.period): (r.provisional_n, r.n, r.frozen) for r in views.serve().collect()}
    assert state()[("a", 100)] == (1, 1, False)
    views.recompute(df, 105 * h)
    assert state()[("a", 100)] == (1, 2, False) and not [p for p in views.increments.values() if p < 105]
    # between two batches increments add to what the last batch found, and the next one absorbs them
    late = arrivals(spark.createDataFrame([("a", 104 * h, 105 * h + 2), ("c", 104 * h, 105 * h + 3)], "key string, event_ms long, seen_ms long"), "event_ms", "seen_ms")
    views.ingest(late)
    assert state()[("a", 104)] == (1, 1, False) and state()[("a", 100)] == (1, 2, False)
    more = arrivals(spark.createDataFrame([("a", 104 * h + 9, 106 * h)], "key string, event_ms long, seen_ms long"), "event_ms", "seen_ms")
    df = df.unionByName(late)
    views.recompute(df, 106 * h)
    views.ingest(more)
    assert state()[("a", 104)] == (2, 2, False) and state()[("c", 104)] == (1, 1, False)
    df = df.unionByName(more)
    with pytest.raises(ValueError):
        views.recompute(df, 100 * h)
    assert [(r.key, r.period) for r in views.corrected().collect()] == [("a", 100)]
    views.recompute(df, 200 * h)
    assert state()[("a", 100)] == (1, 2, True)  # the third came after the cut-off
    views = LambdaViews(spark, views.path)  # opened again from the shared folder
    assert state()[("a", 104)] == (2, 2, True)
    # frozen periods don't change, even when the log does
    views.recompute(df.limit(0), 201 * h)
    assert state()[("a", 100)] == (1, 2, True)
    empty = LambdaViews(spark)
    empty.ingest(df.limit(0))
    empty.recompute(df.limit(0), 0)
    assert empty.serve().count() == 0
