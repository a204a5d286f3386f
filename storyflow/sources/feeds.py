"""Feed documents: fetched by a Python data source, parsed inside the JVM, normalised to articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_RSS_ITEM = "struct<guid:string,link:string,title:string,description:string,`content:encoded`:string,author:string,`dc:creator`:string,pubDate:string,`dc:date`:string,isoDate:string>"
_ATOM_ENTRY = "struct<id:string,link:array<struct<_href:string,_rel:string>>,title:string,summary:string,content:string,author:struct<name:string>,published:string,updated:string>"
#: Bytes of a feed that are read at most, and seconds a fetch may take.
MAX_BYTES, TIMEOUT_S = 10 * 1024 * 1024, 60


def parse_feeds(bodies: DataFrame, body: str = "body") -> DataFrame:
    """RSS 2.0, RDF and Atom documents as one row per item, with all other columns of ``bodies``.

    Adds guid, link, title, summary, content, author, published, updated (strings as received). A byte order mark and
    blanks before the document are dropped; a broken or null document gives no item.
    """
    keep = [c for c in bodies.columns if c != body]
    x = F.regexp_replace(F.col(body), "^[\\uFEFF\\s]+", "")
    df = bodies.withColumn("_x", x)
    empty = {"mode": "PERMISSIVE", "ignoreNamespace": "false"}
    rss = df.filter(F.col("_x").rlike(r"(?is)<rss[\s>]")).select(*keep, F.explode(F.from_xml("_x", f"channel struct<item:array<{_RSS_ITEM}>>", empty)["channel"]["item"]).alias("i"))
    rdf = df.filter(F.col("_x").rlike(r"(?is)<rdf:RDF[\s>]")).select(*keep, F.explode(F.from_xml("_x", f"item array<{_RSS_ITEM}>", empty)["item"]).alias("i"))
    atom = df.filter(F.col("_x").rlike(r"(?is)<feed[\s>]")).select(*keep, F.explode(F.from_xml("_x", f"entry array<{_ATOM_ENTRY}>", empty)["entry"]).alias("e"))
    i = F.col("i")
    items = rss.unionByName(rdf).select(
        *keep, i["guid"].alias("guid"), i["link"].alias("link"), i["title"].alias("title"), i["description"].alias("summary"), i["content:encoded"].alias("content"),
        F.coalesce(i["dc:creator"], i["author"]).alias("author"), F.coalesce(i["isoDate"], i["pubDate"], i["dc:date"]).alias("published"), F.lit(None).cast("string").alias("updated"))
    e = F.col("e")
    link = F.coalesce(F.try_element_at(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(1)), F.try_element_at(e["link"], F.lit(1)))["_href"]
    entries = atom.select(*keep, e["id"].alias("guid"), link.alias("link"), e["title"].alias("title"), e["summary"].alias("summary"), e["content"].alias("content"), e["author"]["name"].alias("author"), e["published"].alias("published"), e["updated"].alias("updated"))
    return items.unionByName(entries)


def feeds_due(feeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Enabled feeds, the one fetched longest ago (or never) first."""
    due = feeds.filter("enabled").orderBy(F.asc_nulls_first("last_fetched_at"), "feed_id")
    return due.limit(limit) if limit is not None else due


class _Slice(InputPartition):
    def __init__(self, urls: list[tuple[str, str]]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[tuple[str, str]], parallel: int, fetch: Callable[[str, int, int], bytes]):
        self.urls, self.parallel, self.fetch = urls, max(1, parallel), fetch

    def partitions(self) -> list[InputPartition]:
        return [_Slice(self.urls[i :: self.parallel]) for i in range(min(self.parallel, max(1, len(self.urls))))]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for feed_id, url in partition.urls:
            try:
                yield feed_id, url, self.fetch(url, MAX_BYTES, TIMEOUT_S)[:MAX_BYTES].decode("utf-8", "replace").lstrip("﻿ \t\r\n"), None
            except Exception as e:  # a failed fetch is a row, not a failed job
                yield feed_id, url, None, f"{type(e).__name__}: {e}"[:500]


def feed_source(urls: list[tuple[str, str]], fetch: Callable[[str, int, int], bytes], parallel: int = 8) -> type[DataSource]:
    """A data source that fetches feeds with an injected function, ``parallel`` at a time; register and ``load`` it."""

    class FeedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "feeds"

        def schema(self) -> str:
            return "feed_id string, url string, body string, error string"

        def reader(self, schema):
            return _Reader(urls, parallel, fetch)

    return FeedSource


def read_feed_seed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV seed list with quoted fields, doubled quotes and line breaks inside fields."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of categories; its order becomes ``sort_order``."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<slug:string,name:string,description:string>>").alias("a"))
    return rows.select(F.posexplode("a").alias("sort_order", "c")).select("c.slug", "c.name", "c.description", "sort_order", F.lit(True).alias("active"))


def write_json_sink(df: DataFrame, path: str) -> None:
    """Outgoing messages as JSON lines, where a webhook would be called."""
    df.write.mode("append").json(path)


def deliver(messages: DataFrame, key: str, body: str, send: Callable[[str], int], attempts: int = 3) -> DataFrame:
    """(key, status, attempts, error) of sending every message by an injected function that returns an HTTP status.

    Statuses of 500 and more and failed calls are tried again; the last outcome is reported, never raised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[body]):
                n, status, error = 0, None, None
                while n < attempts and (status is None or status >= 500):
                    n += 1
                    try:
                        status, error = send(text), None
                    except Exception as e:
                        status, error = None, f"{type(e).__name__}: {e}"[:200]
                rows.append((k, status, n, error))
            yield pd.DataFrame(rows, columns=[key, "status", "attempts", "error"]).astype({"status": "Int64"})

    return messages.select(key, body).mapInPandas(run, f"{key} {messages.schema[key].dataType.simpleString()}, status long, attempts long, error string")


def write_rss(items: DataFrame, title: str, path: str, order: list, most: int = 200) -> None:
    """The first ``most`` items (column item) by ``order`` as one RSS 2.0 file, written by one partition."""
    from ..functions.text import escape_xml

    spark = items.sparkSession
    head = spark.range(1).select(F.lit(0).alias("pos"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), escape_xml(F.lit(title)), F.lit("</title>")).alias("value"))
    tail = spark.range(1).select(F.lit(2**31 - 1).alias("pos"), F.lit("</channel></rss>").alias("value"))
    body = items.orderBy(*order).limit(most).select(F.row_number().over(Window.orderBy(*order)).alias("pos"), F.col("item").alias("value"))
    head.unionByName(body).unionByName(tail).repartition(1).sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)
