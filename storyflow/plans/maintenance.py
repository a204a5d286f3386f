"""Queries that rewrite keyed tables: caches, repointing, merging, parameters per group, ordered and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.model_calls import embedding_text, input_hash
from .common import Catalogue, read

C = Catalogue()

_TEXT = "substr(concat_ws(chr(10), NULLIF(trim(title), ''), substr(NULLIF(trim(summary), ''), 1, 1000), substr(NULLIF(trim(content), ''), 1, 500)), 1, 3000)"


@C.add(f"""WITH h AS (SELECT article_id, batch_no, sha256('vec-a|' || {_TEXT}) AS input_hash FROM articles)
SELECT n.article_id, n.input_hash, EXISTS (SELECT 1 FROM h o WHERE o.batch_no = 0 AND o.input_hash = n.input_hash) AS cached FROM h n WHERE n.batch_no > 0""")
def embedding_cache_split(spark: SparkSession, d: str) -> DataFrame:
    """New articles by whether their embedding input was seen in the history."""
    a = read(spark, d, "articles").select("article_id", "batch_no", input_hash("vec-a", embedding_text(F.col("title"), F.col("summary"), F.col("content"))).alias("input_hash"))
    old = a.filter("batch_no = 0").select("input_hash").distinct().withColumn("cached", F.lit(True))
    return a.filter("batch_no > 0").join(old, "input_hash", "left").select("article_id", "input_hash", F.coalesce("cached", F.lit(False)).alias("cached"))


@C.add("""WITH k AS (SELECT content_hash, MIN(article_id) AS keeper FROM articles GROUP BY 1), m AS (SELECT a.article_id, k.keeper FROM articles a JOIN k USING (content_hash))
SELECT cluster_id, keeper AS article_id, MAX(similarity) AS similarity, COUNT(*) AS n_rows FROM cluster_articles c JOIN m USING (article_id) GROUP BY 1, 2""")
def repointed_members(spark: SparkSession, d: str) -> DataFrame:
    """Membership after duplicates were replaced by the article kept; rows that then collide become one."""
    a = read(spark, d, "articles").select("article_id", "content_hash")
    keeper = a.groupBy("content_hash").agg(F.min("article_id").alias("keeper"))
    m = a.join(keeper, "content_hash").select("article_id", "keeper")
    return read(spark, d, "cluster_articles").join(m, "article_id").groupBy("cluster_id", F.col("keeper").alias("article_id")).agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_rows"))


_MERGE_MAP = """WITH p AS (SELECT source_cluster_id AS old_id, MIN(target_cluster_id) AS new_id FROM cross_category_cluster_adjudications WHERE merged AND decision = 'same_story' AND source_cluster_id IS NOT NULL AND target_cluster_id IS NOT NULL AND source_cluster_id <> target_cluster_id GROUP BY 1)"""


@C.add(_MERGE_MAP + """, m AS (SELECT DISTINCT COALESCE(new_id, cluster_id) AS cluster_id, article_id, CASE WHEN new_id IS NOT NULL THEN 'member' ELSE role END AS role FROM cluster_articles LEFT JOIN p ON old_id = cluster_id)
SELECT cluster_id, COUNT(DISTINCT article_id) AS n_articles, COUNT(*) FILTER (role = 'representative') AS n_leads FROM m GROUP BY 1""")
def merged_stories(spark: SparkSession, d: str) -> DataFrame:
    """Story sizes after merges were applied: members move to the target and moved leads become members."""
    x = read(spark, d, "cross_category_cluster_adjudications").filter("merged and decision = 'same_story' and source_cluster_id is not null and target_cluster_id is not null and source_cluster_id <> target_cluster_id")
    p = x.groupBy(F.col("source_cluster_id").alias("cluster_id")).agg(F.min("target_cluster_id").alias("new_id"))
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id", "role").join(p, "cluster_id", "left")
    m = m.select(F.coalesce("new_id", "cluster_id").alias("cluster_id"), "article_id", F.when(F.col("new_id").isNotNull(), "member").otherwise(F.col("role")).alias("role")).distinct()
    return m.groupBy("cluster_id").agg(F.countDistinct("article_id").alias("n_articles"), F.count_if(F.col("role") == "representative").alias("n_leads"))


@C.add("""WITH h AS (SELECT adjudication_id, decision, created_at, md5(CAST(least(left_cluster_id, right_cluster_id) AS VARCHAR) || '|' || CAST(greatest(left_cluster_id, right_cluster_id) AS VARCHAR) || '|' || pair_type) AS input_hash FROM cross_category_cluster_adjudications WHERE left_cluster_id IS NOT NULL AND right_cluster_id IS NOT NULL AND pair_type IS NOT NULL)
SELECT input_hash, COUNT(*) AS n_asked, COUNT(*) - 1 AS n_saved, COUNT(DISTINCT decision) AS n_decisions FROM h GROUP BY 1""")
def memoised_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How often each pair was asked, and what memoising by the hash of its input would save."""
    x = read(spark, d, "cross_category_cluster_adjudications").filter("left_cluster_id is not null and right_cluster_id is not null and pair_type is not null")
    h = F.md5(F.concat_ws("|", F.least("left_cluster_id", "right_cluster_id").cast("string"), F.greatest("left_cluster_id", "right_cluster_id").cast("string"), "pair_type"))
    return x.groupBy(h.alias("input_hash")).agg(F.count("*").alias("n_asked"), (F.count("*") - 1).alias("n_saved"), F.countDistinct("decision").alias("n_decisions"))


#: Rules (category or *, role or *) that leave members out.
EXCLUSIONS = (("sea-cables", "*"), ("*", "representative"), ("grid-power", "member"))


@C.add("""SELECT m.cluster_id, m.article_id, m.role FROM (SELECT DISTINCT cluster_id, article_id, role FROM cluster_articles) m JOIN story_clusters c USING (cluster_id)
WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('sea-cables', '*'), ('*', 'representative'), ('grid-power', 'member')) r(cat, role) WHERE (r.cat = '*' OR r.cat = c.category_slug) AND (r.role = '*' OR r.role = m.role))""")
def wildcard_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Members no exclusion rule matches; a rule may leave either side open."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id", "role").distinct().join(read(spark, d, "story_clusters").select("cluster_id", "category_slug"), "cluster_id")
    hit = F.lit(False)
    for cat, role in EXCLUSIONS:  # a fixed list: a predicate, no join
        hit |= (F.lit(cat == "*") | F.coalesce(F.col("category_slug") == cat, F.lit(False))) & (F.lit(role == "*") | F.coalesce(F.col("role") == role, F.lit(False)))
    return m.filter(~hit).select("cluster_id", "article_id", "role")


#: Similarity a member must reach, by category; others use the default.
THRESHOLDS, DEFAULT_THRESHOLD = {"grid-power": 0.9, "sea-cables": 0.85}, 0.8


@C.add("SELECT COALESCE(c.category_slug, '-') AS category_slug, COUNT(*) AS n, COUNT(*) FILTER (m.similarity >= CASE c.category_slug WHEN 'grid-power' THEN 0.9 WHEN 'sea-cables' THEN 0.85 ELSE 0.8 END) AS n_kept FROM (SELECT DISTINCT cluster_id, article_id, similarity FROM cluster_articles) m JOIN story_clusters c USING (cluster_id) GROUP BY 1")
def threshold_by_category(spark: SparkSession, d: str) -> DataFrame:
    """A parameter per category with a default, looked up in a literal map."""
    limits = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id", "similarity").distinct().join(read(spark, d, "story_clusters").select("cluster_id", "category_slug"), "cluster_id")
    return m.groupBy(F.coalesce("category_slug", F.lit("-")).alias("category_slug")).agg(F.count("*").alias("n"), F.count_if(F.col("similarity") >= F.coalesce(F.try_element_at(limits, "category_slug"), F.lit(DEFAULT_THRESHOLD))).alias("n_kept"))


@C.add("""SELECT a.article_id, (SELECT COUNT(*) FROM cluster_articles m WHERE m.article_id = a.article_id) AS n_memberships, (SELECT COUNT(*) FROM article_embeddings e WHERE e.article_id = a.article_id) AS n_vectors,
 (SELECT COUNT(*) FROM story_clusters c WHERE c.representative_article_id = a.article_id) AS n_led FROM articles a""")
def article_usage(spark: SparkSession, d: str) -> DataFrame:
    """Lateral counts per article, each aggregated before it is joined."""
    out = read(spark, d, "articles").select("article_id")
    for table, key, name in (("cluster_articles", "article_id", "n_memberships"), ("article_embeddings", "article_id", "n_vectors"), ("story_clusters", "representative_article_id", "n_led")):
        out = out.join(read(spark, d, table).groupBy(F.col(key).alias("article_id")).agg(F.count("*").alias(name)), "article_id", "left")
    return out.fillna(0)


@C.add("""WITH m AS (SELECT DISTINCT cluster_id, article_id, added_at FROM cluster_articles), g AS (SELECT cluster_id, MIN(added_at) AS first_added, MAX(added_at) AS last_added, COUNT(DISTINCT article_id) AS n FROM m GROUP BY 1)
SELECT c.cluster_id, COALESCE(g.n, 0) AS article_count, c.article_count IS DISTINCT FROM COALESCE(g.n, 0) AS was_wrong, GREATEST(c.updated_at, g.last_added) AS updated_at, LEAST(c.created_at, g.first_added) AS created_at FROM story_clusters c LEFT JOIN g USING (cluster_id)""")
def refreshed_stories(spark: SparkSession, d: str) -> DataFrame:
    """Update-from-join: counts recomputed and dates widened monotonically from the members."""
    m = read(spark, d, "cluster_articles").groupBy("cluster_id").agg(F.min("added_at").alias("first_added"), F.max("added_at").alias("last_added"), F.countDistinct("article_id").alias("n"))
    c = read(spark, d, "story_clusters").select("cluster_id", F.col("article_count").alias("old"), "updated_at", "created_at").join(m, "cluster_id", "left")
    n = F.coalesce("n", F.lit(0))
    return c.select("cluster_id", n.alias("article_count"), (~F.col("old").cast("long").eqNullSafe(n)).alias("was_wrong"), F.greatest("updated_at", "last_added").alias("updated_at"), F.least("created_at", "first_added").alias("created_at"))


@C.add("""WITH m AS (SELECT DISTINCT cluster_id, article_id, role, similarity FROM cluster_articles)
SELECT c.cluster_id, COALESCE((SELECT LIST(article_id ORDER BY similarity DESC NULLS LAST, article_id) FROM m WHERE m.cluster_id = c.cluster_id AND role <> 'representative'), []) AS member_ids, (SELECT STRING_AGG(DISTINCT a.source_host, ',' ORDER BY a.source_host) FROM m JOIN articles a USING (article_id) WHERE m.cluster_id = c.cluster_id) AS hosts FROM story_clusters c""")
def ordered_collections(spark: SparkSession, d: str) -> DataFrame:
    """Filtered ordered array and ordered string per story; a story without members gets an empty array."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id", "role", "similarity").distinct().join(read(spark, d, "articles").select("article_id", "source_host"), "article_id", "left")
    pick = F.when(F.col("role") != "representative", F.struct(F.coalesce(-F.col("similarity"), F.lit(9.0)).alias("s"), F.col("article_id").alias("id")))
    g = m.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(pick)), lambda x: x["id"]).alias("member_ids"), F.array_join(F.array_sort(F.collect_set("source_host")), ",").alias("hosts"))
    return read(spark, d, "story_clusters").select("cluster_id").join(g, "cluster_id", "left").select("cluster_id", F.coalesce("member_ids", F.array().cast("array<bigint>")).alias("member_ids"), F.nullif("hosts", F.lit("")).alias("hosts"))


@C.add("""WITH r AS (SELECT cluster_id, article_id, similarity, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY similarity DESC NULLS LAST, article_id) AS k FROM (SELECT DISTINCT cluster_id, article_id, similarity FROM cluster_articles))
SELECT a.cluster_id, a.article_id AS first_id, b.article_id AS second_id, ROUND(a.similarity - b.similarity, 6) AS margin FROM r a LEFT JOIN r b ON b.cluster_id = a.cluster_id AND b.k = 2 WHERE a.k = 1""")
def first_and_second(spark: SparkSession, d: str) -> DataFrame:
    """The best and second member of each story with their margin, by one window instead of a self join."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id", "similarity").distinct()
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("similarity"), "article_id")
    r = m.select("cluster_id", "article_id", F.row_number().over(w).alias("k"), F.lead("article_id").over(w).alias("second_id"), F.round(F.col("similarity") - F.lead("similarity").over(w), 6).alias("margin"))
    return r.filter("k = 1").select("cluster_id", F.col("article_id").alias("first_id"), "second_id", "margin")


@C.add("SELECT event_id, json_object('id', event_id, 'kind', upper(event_type), 'k', CAST(json_extract_string(props, '$.k') AS BIGINT))::VARCHAR AS payload FROM events WHERE event_type <> 'view'")
def rebuilt_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects built anew from columns and parsed properties."""
    e = read(spark, d, "events").filter("event_type <> 'view'")
    payload = F.struct(F.col("event_id").alias("id"), F.upper("event_type").alias("kind"), F.from_json("props", "k bigint")["k"].alias("k"))
    return e.select("event_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


@C.add("SELECT adjudication_id, CASE WHEN decision IN ('same_story', 'related_but_distinct', 'distinct') THEN decision ELSE 'insufficient_evidence' END AS decision, ROUND(GREATEST(0, LEAST(1, COALESCE(confidence, 0))), 3) AS confidence FROM cross_category_cluster_adjudications WHERE confidence IS NULL OR NOT isnan(confidence)")
def normalised_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts with a known decision and a confidence within 0 and 1."""
    x = read(spark, d, "cross_category_cluster_adjudications").filter("confidence is null or not isnan(confidence)")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return x.select("adjudication_id", F.when(F.col("decision").isin("same_story", "related_but_distinct", "distinct"), F.col("decision")).otherwise("insufficient_evidence").alias("decision"), F.round(conf, 3).alias("confidence"))


@C.add("SELECT event_id, user_id, (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4 AS slot, ROUND(value * 0.002 + CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.0005, 6) AS cost FROM events WHERE event_type = 'purchase'")
def round_robin_slots(spark: SparkSession, d: str) -> DataFrame:
    """Work items dealt to four slots in order, with their cost from two rates."""
    e = read(spark, d, "events").filter("event_type = 'purchase'")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "user_id", F.pmod(F.row_number().over(w) - 1, F.lit(4)).cast("long").alias("slot"), F.round(F.col("value") * 0.002 + F.get_json_object("props", "$.k").cast("long") * 0.0005, 6).alias("cost"))


@C.add("WITH r AS (SELECT unnest(from_json('[{\"slug\":\"grid-power\",\"w\":2},{\"slug\":\"sea-cables\",\"w\":3},{\"slug\":\"none\",\"w\":5}]', '[{\"slug\":\"VARCHAR\",\"w\":\"INTEGER\"}]'), recursive := true)) SELECT r.slug, r.w AS weight, COUNT(c.cluster_id) AS n, COUNT(c.cluster_id) * r.w AS weighted FROM r LEFT JOIN story_clusters c ON c.category_slug = r.slug GROUP BY 1, 2")
def recordset_join(spark: SparkSession, d: str) -> DataFrame:
    """A JSON record set as the left side of a join."""
    text = '[{"slug":"grid-power","w":2},{"slug":"sea-cables","w":3},{"slug":"none","w":5}]'
    r = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<slug:string,w:int>>")))
    n = read(spark, d, "story_clusters").groupBy(F.col("category_slug").alias("slug")).agg(F.count("*").alias("n"))
    return r.join(n, "slug", "left").fillna(0, ["n"]).select("slug", F.col("w").alias("weight"), "n", (F.col("n") * F.col("w")).alias("weighted"))


QUERIES, ORACLE = C.queries, C.oracle
