import struct
from datetime import datetime

from pyspark.sql import functions as F

from storyflow.operators.snapshots import SnapshotTable
from storyflow.session import scratch_path
from storyflow.sources.feeds import feed_source, feeds_due, parse_feeds, read_feed_seed, read_taxonomy, write_rss
from storyflow.sources.images import best_image, image_size, image_sizes
from storyflow.streaming.ingest import admit, deduplicated, normalise_items, run_into

RSS = """﻿ <?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><guid>1</guid><title> A  b </title><link>https://a.example/1</link><pubDate>2025-10-05T01:00:00Z</pubDate></item><item><title>no date</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>x</id><title>Hi</title><link rel="self" href="https://a.example/s"/><link href="https://a.example/2"/><updated>2025-10-06T01:00:00Z</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="r"><channel/><item><title>R</title><link>https://a.example/3</link></item></rdf:RDF>"""


def test_parse_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("d", RDF), ("n", None), ("b", "<rss><broken")], "feed_id string, body string")
    got = sorted(((r.feed_id, r.guid, r.title.strip(), r.link) for r in parse_feeds(df).collect() if r.title), key=str)
    assert got[0] == ("a", "x", "Hi", "https://a.example/2") and ("d", None, "R", "https://a.example/3") in got and ("r", "1", "A  b", "https://a.example/1") in got


def test_normalise_admit_and_stream(spark, tmp_path):
    items = [("1", "https://a.example/1", "T", "Sun, 05 Oct 2025 01:00:00 GMT"), ("1", "https://a.example/1", "T", "2025-10-05T01:00:00Z"), ("2", " ", "", "2025-10-05T01:00:00Z"), ("3", None, "late", "2025-01-01T00:00:00Z"), ("4", None, "x", "soon")]
    df = spark.createDataFrame([(g, u, t, None, None, None, p, None) for g, u, t, p in items], "guid string, link string, title string, summary string, content string, author string, published string, updated string")
    since, until = datetime(2025, 10, 1), datetime(2025, 10, 8)
    assert [r.guid for r in admit(normalise_items(df), since, until).collect()] == ["1", "1"]
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    table = SnapshotTable(spark, scratch_path(spark, "articles"))
    for _ in range(2):
        run_into(deduplicated(admit(normalise_items(stream), since, until)), table, ["content_hash"], ["published_at"], f"{tmp_path}/cp").awaitTermination()
        assert table.read().count() == 1


def test_seed_taxonomy_fetch(spark, tmp_path):
    (tmp_path / "f.csv").write_text('name,url\r\n"A ""q"", x",https://a.example\r\n"two\nlines",https://b.example\r\n')
    assert sorted(r.name for r in read_feed_seed(spark, str(tmp_path / "f.csv")).collect()) == ['A "q", x', "two\nlines"]
    (tmp_path / "t.json").write_text('[{"slug":"a","name":"A"},\n{"slug":"b","name":"B"}]')
    assert [(r.slug, r.sort_order) for r in read_taxonomy(spark, str(tmp_path / "t.json")).orderBy("sort_order").collect()] == [("a", 0), ("b", 1)]

    def fetch(url, most, timeout):
        if "bad" in url:
            raise TimeoutError("slow")
        return b"\xef\xbb\xbf <x/>"

    spark.dataSource.register(feed_source([("1", "https://ok"), ("2", "https://bad")], fetch, 2))
    got = {r.feed_id: (r.body, r.error) for r in spark.read.format("feeds").load().collect()}
    assert got["1"] == ("<x/>", None) and got["2"][0] is None and "slow" in got["2"][1]
    due = spark.createDataFrame([("a", True, 5), ("b", True, None), ("c", False, 1)], "feed_id string, enabled boolean, last_fetched_at int")
    assert [r.feed_id for r in feeds_due(due, 2).collect()] == ["b", "a"]


def test_rss_file(spark, tmp_path):
    write_rss(spark.createDataFrame([("<item>2</item>", 2), ("<item>1</item>", 1)], "item string, n int"), "T & t", f"{tmp_path}/rss", ["n"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/rss").collect()]
    assert lines[0].endswith("<title>T &amp; t</title>") and lines[1:] == ["<item>1</item>", "<item>2</item>", "</channel></rss>"]


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 3, 4)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30) + b"\0" * 4
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [image_size(x) for x in (png, gif, jpeg, webp, b"", None, b"text", b"\xff\xd8\xff")] == [("png", 640, 480), ("gif", 3, 4), ("jpeg", 30, 20), ("webp", 100, 50), None, None, None, None]
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.txt").write_bytes(b"no")
    got = image_sizes(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.format, r.width, r.height) for r in got] == [("png", 640, 480)]
    html = '<img src="https://a.example/s.png" width=10 height=10><IMG width="90" src=\'https://a.example/b.png\' height="90"><img src="data:x">'
    assert spark.range(1).select(best_image(F.lit(html)), best_image(F.lit(None).cast("string"))).first()[:] == ("https://a.example/b.png", None)


def test_schemas(spark, sf):
    from storyflow.sources.schema import conforms, rejects, schema

    for table in ("articles", "story_clusters", "cluster_articles", "article_embeddings", "cross_category_cluster_adjudications", "removed_failed_feeds"):
        assert conforms(spark.read.parquet(f"{sf}/{table}.parquet"), table) == []
    df = spark.createDataFrame([(1, 1, 0.5, "member", None), (1, None, 2.0, "chief", None), (1, 2, None, None, None)], schema("cluster_articles"))
    assert sorted(tuple(r.broken_rules) for r in rejects(df, "cluster_articles").collect()) == [("keys", "role", "similarity"), ("role", "similarity")]


def test_model_calls(spark):
    from storyflow.operators.model_calls import cached_results, embedding_text, input_hash

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, text string")
    cache = df.filter("id = 1").select(input_hash("m", F.col("text")).alias("input_hash"), F.array(F.lit(9.0)).alias("result"))
    got = {r.id: r.result for r in cached_results(df, "text", cache, "m", lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {1: [9.0], 2: [1.0], 3: [1.0], 4: [0.0]}
    assert spark.range(1).select(embedding_text(F.lit("T"), F.lit(" "), F.lit("c" * 900))).first()[0] == "T\n" + "c" * 500


def test_structured_answers(spark):
    from storyflow.operators.model_calls import ask_structured, valid_answer

    schema = {"n": int, "ok": bool}
    assert valid_answer('x {"n": 1, "ok": true, "more": 2} y', schema) == ({"n": 1, "ok": True}, None)
    assert [valid_answer(t, schema)[1] for t in (None, "none", "[1]", '{"n": 1}', '{"n": true, "ok": true}')] == ["missing", "no JSON object", "no JSON object", "ok missing", "n of another type"]
    calls = spark.createDataFrame([(1, "good"), (2, "flaky"), (3, "bad"), (4, None), (1, "good")], "id long, t string")

    def model(texts):
        if len(texts) > 1:
            return ['{"n": 1, "ok": true}' if t == "good" else None for t in texts][:2]  # leaves some out
        if texts[0] == "bad":
            raise ConnectionError("gone")
        return ['{"n": 2, "ok": false}']

    got = {r.id: (r.answer, r.attempts, r.error) for r in ask_structured(calls, "id", "t", model, schema).coalesce(1).collect()}
    assert got[3][0] is None and got[3][1] == 3 and "gone" in got[3][2] and got[2][0] == '{"n": 2, "ok": false}' and got[4][0] is not None
    rescued = ask_structured(calls, "id", "t", model, schema, fallback=lambda texts: ['{"n": 9, "ok": true}'])
    assert {r.id for r in rescued.filter("answer is null").collect()} == set()
    assert ask_structured(calls.limit(0), "id", "t", model, schema).count() == 0


def test_deliver(spark):
    from storyflow.sources.feeds import deliver

    seen = spark.createDataFrame([(1, "ok"), (2, "busy"), (3, "boom"), (4, "no")], "id long, body string")

    def send(text):
        if text == "boom":
            raise TimeoutError("slow")
        return {"ok": 200, "busy": 503, "no": 404}[text]

    got = {r.id: (r.status, r.attempts, r.error) for r in deliver(seen, "id", "body", send).collect()}
    assert got == {1: (200, 1, None), 2: (503, 3, None), 3: (None, 3, "TimeoutError: slow"), 4: (404, 1, None)}


def test_rows_that_break_rules_are_told(spark, tmp_path):
    from storyflow.plans.rollups import rejected_rows
    from storyflow.sources.schema import schema

    spark.createDataFrame([(1, 1, 0.5, "member", None), (1, 2, 2.0, "member", None), (1, 3, 0.5, "chief", None), (1, 4, None, None, None)], schema("cluster_articles")).write.parquet(f"{tmp_path}/cluster_articles.parquet")
    x = schema("cross_category_cluster_adjudications")
    row = {f.name: None for f in x} | {"adjudication_id": 9, "decision": "distinct", "confidence": 1.5}
    spark.createDataFrame([tuple(row[f.name] for f in x)], x).write.parquet(f"{tmp_path}/cross_category_cluster_adjudications.parquet")
    assert sorted((r.article_id, r.broken) for r in rejected_rows(spark, str(tmp_path)).collect()) == [(2, "similarity"), (3, "role"), (4, "role,similarity"), (9, "confidence")]
