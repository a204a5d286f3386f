"""Queries over addresses, hashes, tokens and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import story_url, url_host, url_safety
from .common import AS_OF, Catalogue, ago, read, ts

C = Catalogue()

_STORY_URL = """CASE WHEN canonical_url IS NULL THEN NULL ELSE regexp_replace(split_part(u, '?', 1), '/$', '') || CASE WHEN p = '' THEN '' ELSE '?' || p END END"""
_URLS = f"""WITH n AS (SELECT *, regexp_replace(lower(trim(canonical_url)), '#.*$', '') AS u FROM articles),
q AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$')), '&') AS p FROM n),
s AS (SELECT *, {_STORY_URL} AS story_url FROM q) """


@C.add(_URLS + "SELECT article_id, story_url, NULLIF(regexp_replace(lower(regexp_extract(canonical_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', ''), '') AS host FROM s")
def article_urls(spark: SparkSession, d: str) -> DataFrame:
    """Canonical story address and host of every article."""
    return read(spark, d, "articles").select("article_id", story_url(F.col("canonical_url")).alias("story_url"), url_host(F.col("canonical_url")).alias("host"))


@C.add(_URLS + "SELECT source_host, COUNT(DISTINCT story_url) AS n_stories, COUNT(*) FILTER (story_url <> lower(canonical_url)) AS n_respelled FROM s GROUP BY 1")
def story_urls_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Distinct story addresses per host and how many were spelled otherwise."""
    a = read(spark, d, "articles").select("source_host", "canonical_url", story_url(F.col("canonical_url")).alias("s"))
    return a.groupBy("source_host").agg(F.countDistinct("s").alias("n_stories"), F.count_if(F.col("s") != F.lower("canonical_url")).alias("n_respelled"))


@C.add(_URLS + """, m AS (SELECT DISTINCT cluster_id, article_id FROM cluster_articles), g AS (SELECT m.cluster_id, STRING_AGG(DISTINCT NULLIF(story_url, ''), chr(10) ORDER BY NULLIF(story_url, '')) AS urls FROM m JOIN s USING (article_id) GROUP BY 1)
SELECT c.cluster_id, md5(COALESCE(NULLIF(urls, ''), lower(trim(regexp_replace(c.title, '\\s+', ' ', 'g'))))) AS story_hash FROM story_clusters c LEFT JOIN g USING (cluster_id)""")
def story_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash per story from its sorted distinct addresses, else from its title."""
    urls = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct().join(read(spark, d, "articles").select("article_id", story_url(F.col("canonical_url")).alias("u")), "article_id").filter("u <> ''")
    g = urls.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("u")), "\n").alias("urls"))
    return read(spark, d, "story_clusters").select("cluster_id", "title").join(g, "cluster_id", "left").select("cluster_id", F.md5(F.coalesce("urls", F.lower(T.clean_text(F.col("title"))))).alias("story_hash"))


@C.add("SELECT article_id, sha256(COALESCE(guid, '') || '|' || COALESCE(canonical_url, '') || '|' || COALESCE(title, '') || '|' || COALESCE(published_at, '')) AS item_hash FROM articles")
def item_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash over identifier, address, title and stated time; missing parts count as empty."""
    return read(spark, d, "articles").select("article_id", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("guid", "canonical_url", "title", "published_at")]), 256).alias("item_hash"))


@C.add("""SELECT article_id, trim(regexp_replace(content, '[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS content,
len(regexp_extract_all(COALESCE(content, ''), '[\\p{L}\\p{N}][\\p{L}\\p{N}''-]+')) AS n_words, CAST(CEIL(length(COALESCE(content, '')) / 3.6) AS BIGINT) AS est_tokens FROM articles""")
def clean_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents with collapsed white space, their substantive words and estimated tokens."""
    c = F.col("content")
    return read(spark, d, "articles").select("article_id", T.clean_text(c).alias("content"), T.word_count(c).cast("long").alias("n_words"), T.token_estimate(c).alias("est_tokens"))


@C.add("""WITH t AS (SELECT lang, source, CAST(CEIL(length(COALESCE(text, '')) / 3.6) AS BIGINT) + 4 AS n FROM documents), g AS (SELECT COALESCE(source, '-') AS source, CAST(SUM(n) + 3 AS BIGINT) AS prompt_tokens FROM t GROUP BY 1)
SELECT source, prompt_tokens, CAST(GREATEST(0, LEAST(2048, 8192 - 256 - prompt_tokens)) AS BIGINT) AS max_tokens, prompt_tokens > 8192 - 256 - 2048 AS was_reduced FROM g""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens left for an answer after a prompt of all documents of a source: 3 plus 4 a message overhead, window 8,192."""
    g = read(spark, d, "documents").groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg((F.sum(T.token_estimate(F.col("text")) + 4) + 3).alias("prompt_tokens"))
    room = F.lit(8192 - 256) - F.col("prompt_tokens")
    return g.select("source", "prompt_tokens", F.greatest(F.lit(0).cast("long"), F.least(F.lit(2048).cast("long"), room)).alias("max_tokens"), (room < 2048).alias("was_reduced"))


def _xml_sql(c: str) -> str:
    return f"replace(replace(replace(replace(replace(COALESCE({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@C.add(f"""SELECT cluster_id, '<item><title>' || {_xml_sql("title")} || '</title><guid isPermaLink="false">' || CAST(cluster_id AS VARCHAR) || '</guid><category>' || {_xml_sql("category_slug")} || '</category><pubDate>' || strftime(latest_published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate></item>' AS item
FROM story_clusters WHERE latest_published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}' ORDER BY latest_published_at DESC, cluster_id LIMIT 200""")
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 stories of a week as RSS items."""
    c = read(spark, d, "story_clusters").filter(F.col("latest_published_at").between(ago(AS_OF, "7 DAY"), ts(AS_OF))).orderBy(F.desc("latest_published_at"), "cluster_id").limit(200)
    stamp = F.concat(F.date_format("latest_published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    item = F.concat(F.lit("<item><title>"), T.escape_xml(F.col("title")), F.lit('</title><guid isPermaLink="false">'), F.col("cluster_id").cast("string"), F.lit("</guid><category>"), T.escape_xml(F.col("category_slug")), F.lit("</category><pubDate>"), stamp, F.lit("</pubDate></item>"))
    return c.select("cluster_id", item.alias("item"))


@C.add(f"""WITH m AS (SELECT DISTINCT cluster_id, article_id FROM cluster_articles), g AS (SELECT m.cluster_id, STRING_AGG('<li>' || {_xml_sql("a.title")} || '</li>', '' ORDER BY a.article_id) AS body, COUNT(*) AS n FROM m JOIN articles a USING (article_id) GROUP BY 1)
SELECT c.cluster_id, '<item><title>' || {_xml_sql("c.title")} || ' (' || CAST(n AS VARCHAR) || ')</title><description><ul>' || body || '</ul></description></item>' AS item FROM story_clusters c JOIN g USING (cluster_id) WHERE n >= 3""")
def rss_groups(spark: SparkSession, d: str) -> DataFrame:
    """Stories of three and more articles as RSS items that list them in order."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct().join(read(spark, d, "articles").select("article_id", F.col("title").alias("t")), "article_id")
    li = F.transform(F.array_sort(F.collect_list(F.struct("article_id", "t"))), lambda x: F.concat(F.lit("<li>"), T.escape_xml(x["t"]), F.lit("</li>")))
    g = m.groupBy("cluster_id").agg(F.array_join(li, "").alias("body"), F.count("*").alias("n")).filter("n >= 3")
    c = read(spark, d, "story_clusters").select("cluster_id", "title").join(g, "cluster_id")
    return c.select("cluster_id", F.concat(F.lit("<item><title>"), T.escape_xml(F.col("title")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</title><description><ul>"), F.col("body"), F.lit("</ul></description></item>")).alias("item"))


#: Guard rules of the topics in these texts, parameters of ``guard``.
GUARDS = {
    "energy": {"required": (("mill", "plant", "strom", "hydroelectric", "photovoltaic"), ("price", "shortage", "concessions", "audit")), "excluded": ("bakery",), "excluded_unless": ()},
    "transport": {"required": (("tram", "bike", "car", "ferry", "bus"),), "excluded": ("fin",), "excluded_unless": ((("school",), ("tram", "ferry")),)},
}


def _guard_sql(term: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')" if len(term) <= 4 and term.isalnum() else f"contains(t, '{term}')"


def _topic_sql(rule: dict) -> str:
    either = lambda terms: "(" + " OR ".join(map(_guard_sql, terms)) + ")"
    tests = [either(g) for g in rule["required"]] + ["NOT " + either(rule["excluded"])] + [f"(NOT {either(t)} OR {either(r)})" for t, r in rule["excluded_unless"]]
    return " AND ".join(tests)


@C.add("WITH x AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS topic FROM x WHERE {_topic_sql(r)}" for k, r in GUARDS.items()))
def guard_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents a topic's lexical guard lets pass: every required group hit, no excluded term, none excluded unless rescued; short terms stand alone."""
    x = read(spark, d, "documents").filter("text is not null").select("doc_id", F.lower("text").alias("t"))
    topics = F.filter(F.array(*[F.when(T.guard(F.col("t"), **r), F.lit(k)) for k, r in GUARDS.items()]), lambda k: k.isNotNull())
    return x.select("doc_id", F.explode(topics).alias("topic"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@C.add(f"""WITH t AS (SELECT DISTINCT cluster_id, UNNEST(list_filter(string_split_regex(lower(title), '[^a-z0-9+.-]+'), lambda x: length(x) >= 4 AND x NOT IN ({_STOP}))) AS token FROM story_clusters),
k AS (SELECT token FROM t GROUP BY token HAVING COUNT(*) BETWEEN 2 AND 120), f AS (SELECT t.* FROM t JOIN k USING (token))
SELECT a.cluster_id AS left_id, b.cluster_id AS right_id, COUNT(*) AS shared FROM f a JOIN f b ON a.token = b.token AND a.cluster_id < b.cluster_id GROUP BY 1, 2 HAVING COUNT(*) >= 2""")
def token_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate stories by an inverted token index: tokens in at most 120 stories, pairs that share at least two of them."""
    t = read(spark, d, "story_clusters").select("cluster_id", F.explode(T.story_tokens(F.col("title"))).alias("token"))
    useful = t.groupBy("token").agg(F.count("*").alias("n")).filter("n between 2 and 120").select("token")
    f = t.join(useful, "token")
    a, b = f.withColumnRenamed("cluster_id", "left_id"), f.withColumnRenamed("cluster_id", "right_id")
    return a.join(b, "token").filter("left_id < right_id").groupBy("left_id", "right_id").agg(F.count("*").alias("shared")).filter("shared >= 2")


def _redact_sql(c: str) -> str:
    for p in T.SECRET_PATTERNS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '\\1[REDACTED]{'@' if p.endswith('@') else ''}', 'g')"
    return c


@C.add(f"SELECT article_id, {_redact_sql(chr(39) + 'token=' + chr(39) + ' || content_hash || ' + chr(39) + ' for Bearer abcdefgh12345 at https://u:pass@' + chr(39) + ' || source_host')} AS line FROM articles")
def redacted_log(spark: SparkSession, d: str) -> DataFrame:
    """Log lines with secrets, redacted."""
    line = F.concat(F.lit("token="), "content_hash", F.lit(" for Bearer abcdefgh12345 at https://u:pass@"), "source_host")
    return read(spark, d, "articles").select("article_id", T.redact_secrets(line).alias("line"))


@C.add("SELECT feed_id, CASE WHEN url LIKE 'https://%' THEN 'ok' WHEN url LIKE 'http://%' THEN 'scheme' ELSE 'no_url' END AS safety FROM removed_failed_feeds")
def feed_url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Whether a feed's address may be fetched."""
    return read(spark, d, "removed_failed_feeds").select("feed_id", url_safety(F.coalesce("url", F.lit(""))).alias("safety"))


QUERIES, ORACLE = C.queries, C.oracle
