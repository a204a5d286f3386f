"""Queries with optional and list parameters, staleness, sweeps, and candidates composed of several tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text_rules, vectors
from .common import AS_OF, Catalogue, ago, read, ts

C = Catalogue()

#: Shape of an identifier as services accept it.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def select_stories(stories: DataFrame, category: str | None = None, least_articles: int | None = None, published_from: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, limit: int = 50, most: int = 200) -> DataFrame:
    """Newest stories by optional filters; a null parameter filters nothing, the limit is clamped to 1 .. ``most``.

    ``include`` keeps the categories of a list, ``exclude`` leaves those of another out; a story without category is in neither.
    """
    for wanted, test in ((category, lambda v: F.col("category_slug") == v), (least_articles, lambda v: F.col("article_count") >= v), (published_from, lambda v: F.col("latest_published_at") >= ts(v)),
                         (include, lambda v: F.col("category_slug").isin(v)), (exclude, lambda v: ~F.coalesce(F.col("category_slug").isin(v), F.lit(False)))):
        if wanted is not None:
            stories = stories.filter(test(wanted))
    return stories.orderBy(F.desc_nulls_last("latest_published_at"), "cluster_id").limit(min(max(1, limit), most))


_VIEWS = {
    "all": ({"limit": 500}, "true", 200),
    "category": ({"category": "grid-power"}, "category_slug = 'grid-power'", 50),
    "sizes": ({"least_articles": 5, "limit": 0}, "article_count >= 5", 1),
    "recent": ({"published_from": "2025-11-01 00:00:00", "category": "sea-cables"}, "latest_published_at >= TIMESTAMP '2025-11-01 00:00:00' AND category_slug = 'sea-cables'", 50),
    "listed": ({"include": ["grid-power", "chip-plants"], "exclude": ["chip-plants"]}, "category_slug IN ('grid-power', 'chip-plants') AND category_slug <> 'chip-plants'", 50),
    "others": ({"exclude": ["grid-power", "sea-cables"], "limit": 100}, "COALESCE(category_slug NOT IN ('grid-power', 'sea-cables'), true)", 100),
}


@C.add(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS view, cluster_id, category_slug, latest_published_at FROM story_clusters WHERE {where} ORDER BY latest_published_at DESC NULLS LAST, cluster_id LIMIT {n})" for name, (_, where, n) in _VIEWS.items()))
def filtered_stories(spark: SparkSession, d: str) -> DataFrame:
    """Story lists under optional filters: category, size, date, included and excluded categories, clamped limits."""
    c, out = read(spark, d, "story_clusters").select("cluster_id", "category_slug", "article_count", "latest_published_at"), None
    for name, (args, _, _) in _VIEWS.items():
        part = select_stories(c, **args).select(F.lit(name).alias("view"), "cluster_id", "category_slug", "latest_published_at")
        out = part if out is None else out.unionByName(part)
    return out


@C.add(f"""WITH j AS (SELECT cluster_id, MAX(created_at) AS judged_at FROM (SELECT left_cluster_id AS cluster_id, created_at FROM cross_category_cluster_adjudications UNION ALL SELECT right_cluster_id, created_at FROM cross_category_cluster_adjudications) GROUP BY 1)
SELECT c.cluster_id, judged_at IS NULL AS never, judged_at FROM story_clusters c LEFT JOIN j USING (cluster_id) WHERE (judged_at IS NULL OR judged_at < c.updated_at) AND c.updated_at <= TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE""")
def stale_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories never judged or changed since, once they have been stable for half an hour."""
    x = read(spark, d, "cross_category_cluster_adjudications")
    j = x.select(F.explode(F.array("left_cluster_id", "right_cluster_id")).alias("cluster_id"), "created_at").groupBy("cluster_id").agg(F.max("created_at").alias("judged_at"))
    c = read(spark, d, "story_clusters").filter(F.col("updated_at") <= ago(AS_OF, "30 MINUTE")).select("cluster_id", "updated_at").join(j, "cluster_id", "left")
    return c.filter("judged_at is null or judged_at < updated_at").select("cluster_id", F.col("judged_at").isNull().alias("never"), "judged_at")


@C.add("""WITH m AS (SELECT DISTINCT cluster_id, article_id, similarity, role FROM cluster_articles), b AS (SELECT cluster_id, MAX(similarity) AS best FROM m GROUP BY 1)
SELECT m.cluster_id, COUNT(DISTINCT article_id) AS n_before, COUNT(DISTINCT article_id) FILTER (NOT COALESCE(similarity < 0.85, false)) AS n_after, COUNT(DISTINCT article_id) FILTER (similarity < 0.85) AS n_rejected,
 COUNT(*) FILTER (NOT COALESCE(similarity < 0.85, false)) = 0 AS dissolved, COUNT(*) FILTER (role = 'representative' AND similarity < 0.85) > 0 AS lost_lead FROM m GROUP BY 1 HAVING COUNT(*) FILTER (similarity < 0.85) > 0""")
def low_confidence_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Stories that lose members below a similarity: sizes before and after, those that dissolve or lose their lead."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id", "similarity", "role").distinct()
    low = F.coalesce(F.col("similarity") < 0.85, F.lit(False))
    g = m.groupBy("cluster_id").agg(
        F.countDistinct("article_id").alias("n_before"), F.countDistinct(F.when(~low, F.col("article_id"))).alias("n_after"), F.countDistinct(F.when(low, F.col("article_id"))).alias("n_rejected"),
        (F.count_if(~low) == 0).alias("dissolved"), (F.count_if((F.col("role") == "representative") & low) > 0).alias("lost_lead"), F.count_if(low).alias("k"))
    return g.filter("k > 0").drop("k")


@C.add(f"""WITH w AS (SELECT cluster_id FROM story_clusters WHERE category_slug = 'grid-power' AND latest_published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY)
SELECT 'members' AS what, COUNT(*) AS n FROM (SELECT DISTINCT cluster_id, article_id FROM cluster_articles) m WHERE EXISTS (SELECT 1 FROM w WHERE w.cluster_id = m.cluster_id)
UNION ALL SELECT 'verdicts', COUNT(*) FROM cross_category_cluster_adjudications x WHERE EXISTS (SELECT 1 FROM w WHERE w.cluster_id = x.left_cluster_id OR w.cluster_id = x.right_cluster_id)
UNION ALL SELECT 'stories', COUNT(*) FROM w""")
def recluster_scope(spark: SparkSession, d: str) -> DataFrame:
    """What clustering one category anew drops: its stories of a window, their members and all verdicts on them."""
    w = read(spark, d, "story_clusters").filter((F.col("category_slug") == "grid-power") & (F.col("latest_published_at") >= ago(AS_OF, "60 DAY"))).select("cluster_id")
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct().join(w, "cluster_id", "left_semi")
    ends = read(spark, d, "cross_category_cluster_adjudications").select("adjudication_id", F.explode(F.array("left_cluster_id", "right_cluster_id")).alias("cluster_id"))
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(m, "members").unionByName(one(ends.join(w, "cluster_id", "left_semi").select("adjudication_id").distinct(), "verdicts")).unionByName(one(w, "stories"))


_OPEN = "decision = 'same_story' AND confidence >= 0.7 AND left_cluster_id <> right_cluster_id"


@C.add(f"""WITH s AS (SELECT cluster_id, COALESCE(article_count, 0) AS n FROM story_clusters),
v AS (SELECT x.adjudication_id, x.confidence, CASE WHEN l.n > r.n OR (l.n = r.n AND l.cluster_id < r.cluster_id) THEN l.cluster_id ELSE r.cluster_id END AS target_id, CASE WHEN l.n > r.n OR (l.n = r.n AND l.cluster_id < r.cluster_id) THEN r.cluster_id ELSE l.cluster_id END AS source_id
 FROM cross_category_cluster_adjudications x JOIN s l ON l.cluster_id = left_cluster_id JOIN s r ON r.cluster_id = right_cluster_id WHERE {_OPEN} AND NOT isnan(confidence)),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY confidence DESC, adjudication_id) AS k FROM v)
SELECT source_id, target_id, confidence, EXISTS (SELECT 1 FROM b o WHERE o.k = 1 AND o.source_id = b.target_id) AS deferred FROM b WHERE k = 1""")
def applied_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Merges that verdicts order: both stories alive, confident enough, the best verdict per source; deferred while the target is a source itself."""
    s = read(spark, d, "story_clusters").select("cluster_id", F.coalesce("article_count", F.lit(0)).alias("n"))
    side = lambda x: s.select(F.col("cluster_id").alias(x), F.col("n").alias(f"{x}_n"))
    x = read(spark, d, "cross_category_cluster_adjudications").filter(_OPEN + " and not isnan(confidence)").select("adjudication_id", "confidence", F.col("left_cluster_id").alias("l"), F.col("right_cluster_id").alias("r"))
    v = x.join(side("l"), "l").join(side("r"), "r")
    left = (F.col("l_n") > F.col("r_n")) | ((F.col("l_n") == F.col("r_n")) & (F.col("l") < F.col("r")))
    v = v.select("adjudication_id", "confidence", F.when(left, F.col("l")).otherwise(F.col("r")).alias("target_id"), F.when(left, F.col("r")).otherwise(F.col("l")).alias("source_id"))
    w = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "adjudication_id")
    b = v.withColumn("k", F.row_number().over(w)).filter("k = 1").select("source_id", "target_id", "confidence")
    sources = b.select(F.col("source_id").alias("target_id"), F.lit(True).alias("deferred"))
    return b.join(sources, "target_id", "left").select("source_id", "target_id", "confidence", F.coalesce("deferred", F.lit(False)).alias("deferred"))


def _overlap(k_nn: str) -> str:
    return f"""SELECT k.query_id, k.id, k.similarity, t.shared FROM ({vectors.ORACLE[k_nn]}) k JOIN ({text_rules.ORACLE["token_overlap_pairs"]}) t ON t.left_id = least(k.query_id, k.id) AND t.right_id = greatest(k.query_id, k.id)"""


def _candidates(spark: SparkSession, d: str, near: DataFrame, band: tuple[float, float, float]) -> DataFrame:
    """Neighbours that share at least two tokens and are alike: by centroid alone, or less so with a pair of articles alike."""
    high, low, article = band
    shared = text_rules.QUERIES["token_overlap_pairs"](spark, d)
    j = near.join(shared, (F.least("query_id", "id") == F.col("left_id")) & (F.greatest("query_id", "id") == F.col("right_id"))).select("query_id", "id", "similarity", "shared").filter(F.col("similarity") >= low)
    best = vectors.best_article_pairs(spark, d, j.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct())
    best = best.withColumnsRenamed({"a": "_a", "b": "_b"})
    out = j.join(best, (F.least("query_id", "id") == F.col("_a")) & (F.greatest("query_id", "id") == F.col("_b")), "left")
    return out.filter((F.col("similarity") >= high) | (F.col("max_article_similarity") >= article)).select("query_id", "id", "similarity", "shared", "max_article_similarity")


def _candidates_sql(k_nn: str, band: tuple[float, float, float]) -> str:
    high, low, article = band
    return f"""WITH o AS ({_overlap(k_nn)}), e AS (SELECT article_id, {vectors._unit_sql("embedding_vector")} AS u FROM article_embeddings WHERE {vectors._OK.format(v="embedding_vector")}),
m AS (SELECT DISTINCT cluster_id, article_id, u FROM cluster_articles JOIN e USING (article_id)),
b AS (SELECT o.query_id, o.id, MAX(ROUND(list_inner_product(x.u, y.u), 6)) AS best FROM o JOIN m x ON x.cluster_id = o.query_id JOIN m y ON y.cluster_id = o.id WHERE o.similarity >= {low} GROUP BY 1, 2)
SELECT o.query_id, o.id, o.similarity, o.shared, b.best AS max_article_similarity FROM o LEFT JOIN b USING (query_id, id) WHERE o.similarity >= {low} AND (o.similarity >= {high} OR b.best >= {article})"""


#: Similarity of centroids that suffices, that is needed at least, and of articles that is needed then.
CROSS_BAND, SAME_BAND = (0.25, 0.1, 0.15), (0.4, 0.3, 0.3)


@C.add(_candidates_sql("knn_cross_category", CROSS_BAND))
def cross_category_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stories of other categories to judge against the stated queries: near, sharing tokens, alike by centroid or by articles."""
    return _candidates(spark, d, vectors.QUERIES["knn_cross_category"](spark, d), CROSS_BAND)


@C.add(_candidates_sql("knn_same_category", SAME_BAND))
def same_category_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stories of the same category to judge against the stated queries, by the same tests within a narrower band."""
    return _candidates(spark, d, vectors.QUERIES["knn_same_category"](spark, d), SAME_BAND)


@C.add("SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'uuid' ELSE 'bad' END AS shape FROM articles WHERE content_hash IS NOT NULL")
def identifier_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Whether an identifier has the shape of a UUID."""
    h = F.md5(F.col("article_id").cast("string"))
    good = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    text = F.when(F.col("article_id") % 3 == 0, good).when(F.col("article_id") % 3 == 1, F.concat(good, F.lit("0"))).otherwise(F.replace(good, F.lit("-4"), F.lit("-9")))
    return read(spark, d, "articles").filter("content_hash is not null").select("article_id", F.when(text.rlike(UUID), "uuid").otherwise("bad").alias("shape"))


@C.add("WITH m AS (SELECT DISTINCT cluster_id, article_id FROM cluster_articles), g AS (SELECT cluster_id, STRING_AGG(canonical_url, chr(10) ORDER BY canonical_url) AS urls FROM m JOIN articles USING (article_id) WHERE canonical_url <> '' GROUP BY 1) SELECT cluster_id, md5(urls) AS story_hash FROM g")
def story_hash_as_stored(spark: SparkSession, d: str) -> DataFrame:
    """The hash of a story from its addresses as stored, repeats included."""
    j = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct().join(read(spark, d, "articles").filter("canonical_url <> ''").select("article_id", "canonical_url"), "article_id")
    return j.groupBy("cluster_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("canonical_url")), "\n")).alias("story_hash"))


QUERIES, ORACLE = C.queries, C.oracle
