"""Search and similarity."""

from pyspark.sql import functions as F


from gavel.operators import search as sr
from gavel.operators import vector_index as vi
from gavel.plans.registry import query
from gavel.plans.roles import TX, transactions
from gavel.sources.tables import load_table

# User input: part names as people type them, from cut to misspelt.
_QUERIES = """qs AS (SELECT DISTINCT CASE p_type WHEN 'STANDARD' THEN p_name WHEN 'ECONOMY' THEN ' ' || upper(split_part(p_name, ' ', 1)) WHEN 'PROMO' THEN right(p_name, 5) WHEN 'LARGE' THEN left(p_name, 4) || '!' || substr(p_name, 5)
  WHEN 'SMALL' THEN replace(p_name, ' ', ' the ') ELSE 'zzqx' END AS q FROM part),
q AS (SELECT q AS qid, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(q)), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_ \\-()]', ' ', 'g'), '\\s+', ' ', 'g')) AS qn FROM qs),
nm AS (SELECT p_name AS name, p_brand AS area, count(*) AS deals, lower(p_name) AS low FROM part GROUP BY ALL)"""


def user_queries(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    q = (
        F.when(t == "STANDARD", n).when(t == "ECONOMY", F.concat(F.lit(" "), F.upper(F.split_part(n, F.lit(" "), F.lit(1))))).when(t == "PROMO", F.right(n, F.lit(5)))
        .when(t == "LARGE", F.concat(F.substring(n, 1, 4), F.lit("!"), F.substring(n, 5, 1000))).when(t == "SMALL", F.regexp_replace(n, " ", " the ")).otherwise("zzqx"))
    return load_table(spark, d, "part").select(q.alias("q")).distinct().withColumn("qid", F.col("q"))


def part_names(spark, d):
    return load_table(spark, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("area")).agg(F.count(F.lit(1)).alias("deals"))


_TRG = """tq AS (SELECT qn, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(qn, '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM (SELECT DISTINCT qn FROM q)),
tn AS (SELECT low, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(low, '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM (SELECT DISTINCT low FROM nm)),
sim AS (SELECT qn, low, len(list_intersect(tq.g, tn.g)) / (len(tq.g) + len(tn.g) - len(list_intersect(tq.g, tn.g))) AS s FROM tq, tn)"""


@query("trigram_similarity", f"""WITH {_QUERIES}, {_TRG} SELECT qn, low, round(s, 6) AS similarity FROM sim WHERE s >= 0.3""")
def q_trigram(spark, d):
    from gavel.functions.similarity import trigram_pairs

    q = user_queries(spark, d).select(sr.search_text("q").alias("qn"))
    n = part_names(spark, d).select(F.lower("name").alias("low"))
    return trigram_pairs(q, "qn", n, "low", 0.3).select(F.col("a").alias("qn"), F.col("b").alias("low"), F.round("similarity", 6).alias("similarity"))


@query("entity_search_cascade", f"""WITH {_QUERIES}, {_TRG}, h AS (SELECT q.qn, nm.*, CASE WHEN trim(nm.low) = q.qn THEN 1 WHEN starts_with(nm.low, q.qn) THEN 2 WHEN contains(nm.low, q.qn) THEN 3 WHEN length(q.qn) >= 3 AND s >= 0.3 THEN 4 END AS stage, s
  FROM (SELECT DISTINCT qn FROM q) q, nm, sim WHERE sim.qn = q.qn AND sim.low = nm.low),
r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY stage, CASE WHEN stage = 4 THEN s END DESC NULLS LAST, deals DESC, name, area) AS position FROM h WHERE stage IS NOT NULL),
dr AS (SELECT qid, position, ['exact', 'prefix', 'substring', 'fuzzy'][stage] AS kind, name, area, deals FROM q JOIN r ON q.qn = r.qn WHERE position <= 6)
SELECT qid, CAST(position AS INT) AS position, kind, name, area, deals FROM dr UNION ALL
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY deals DESC, name, area) AS INT), 'popular', name, area, deals FROM q, (SELECT * FROM nm ORDER BY deals DESC, name, area LIMIT 6) WHERE qid NOT IN (SELECT qid FROM dr)""")
def q_entity_search(spark, d):
    return sr.entity_search(user_queries(spark, d), part_names(spark, d), 6)


@query("area_search_cascade", """
WITH z AS (SELECT r_name AS zone, list(n_name) AS members, count(*) AS deals FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 GROUP BY 1), ar AS (SELECT n_name AS area, n_nationkey::BIGINT AS deals FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 7 FROM customer),
qs AS (SELECT r_name AS q FROM region UNION ALL SELECT 'nation 1' FROM region WHERE r_regionkey = 0 UNION ALL SELECT left(r_name, 3) FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT DISTINCT left(c_mktsegment, 5) FROM customer), q AS (SELECT DISTINCT q AS qid, lower(q) AS qn FROM qs),
m AS (SELECT zone, deals, lower(unnest(members)) AS low FROM z),
h AS (SELECT qn, zone AS hit, deals, 1 AS stage FROM q, z WHERE lower(zone) = qn UNION ALL SELECT qn, zone, deals, 2 FROM q, m WHERE contains(low, qn) UNION ALL SELECT qn, zone, deals, 3 FROM q, z WHERE contains(lower(zone), qn) AND lower(zone) <> qn
  UNION ALL SELECT qn, area, deals, 4 FROM q, ar WHERE contains(lower(area), qn) AND lower(area) NOT IN (SELECT low FROM m) AND lower(area) NOT IN (SELECT lower(zone) FROM z)),
b AS (SELECT qn, hit, min(stage) AS stage, max(deals) AS deals FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY stage, deals DESC, hit) AS position FROM b)
SELECT qid, CAST(position AS INT) AS position, ['zone_exact', 'member', 'zone_fuzzy', 'area'][stage] AS kind, hit, deals FROM q JOIN r ON q.qn = r.qn WHERE position <= 5""")
def q_area_search(spark, d):
    n, r, c = (load_table(spark, d, t) for t in ("nation", "region", "customer"))
    zones = n.filter(F.col("n_nationkey") != 3).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("zone")).agg(F.collect_list("n_name").alias("members"), F.count(F.lit(1)).alias("deals"))
    areas = n.select(F.col("n_name").alias("area"), F.col("n_nationkey").cast("bigint").alias("deals")).unionByName(c.select(F.col("c_mktsegment").alias("area")).distinct().withColumn("deals", F.lit(7).cast("bigint")))
    q = (
        r.select(F.col("r_name").alias("q")).unionByName(r.filter(F.col("r_regionkey") == 0).select(F.lit("nation 1").alias("q"))).unionByName(r.select(F.substring("r_name", 1, 3).alias("q")))
        .unionByName(n.select(F.col("n_name").alias("q"))).unionByName(c.select(F.substring("c_mktsegment", 1, 5).alias("q")).distinct()).distinct().withColumn("qid", F.col("q")))
    return sr.area_search(q, zones, areas)


@query("alias_expand", f"""WITH {_QUERIES}, g AS (SELECT DISTINCT p_brand AS group_id, CASE WHEN p_size < 10 THEN p_name ELSE split_part(p_name, ' ', 2) || ' ' || p_brand END AS name FROM part), k AS (SELECT DISTINCT q AS qid, q, lower(trim(q)) AS k FROM qs),
c AS (SELECT k, group_id, lower(trim(name)) AS n, CASE WHEN k = lower(trim(name)) THEN 0 ELSE 1 END AS stage FROM (SELECT DISTINCT k FROM k), g WHERE contains(k, lower(trim(name))) OR contains(lower(trim(name)), k)),
p AS (SELECT k, group_id FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY stage, length(n) DESC, n, group_id) = 1)
SELECT DISTINCT qid, coalesce(name, q) AS variant FROM k LEFT JOIN p ON k.k = p.k LEFT JOIN g ON p.group_id = g.group_id""")
def q_alias_expand(spark, d):
    name = F.when(F.col("p_size") < 10, F.col("p_name")).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), "p_brand"))
    groups = load_table(spark, d, "part").select(F.col("p_brand").alias("group_id"), name.alias("name")).distinct()
    return sr.alias_expand(user_queries(spark, d), groups)


_VEC = """c AS (SELECT label AS qid, list(m ORDER BY i) AS qvec FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def label_means(spark, d):
    e = load_table(spark, d, "embeddings").select(F.col("label").alias("qid"), F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("qvec"))


@query("vector_topk_cosine", f"""WITH {_VEC}, s AS (SELECT qid, vec_id AS id, list_dot_product(embedding::DOUBLE[], qvec) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qvec, qvec)) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM s) SELECT qid, id, round(score, 6) AS score, CAST(position AS INT) AS position FROM r WHERE position <= 10""")
def q_vec_cos(spark, d):
    items = load_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return sr.vector_topk(label_means(spark, d), items, 10).withColumn("score", F.round("score", 6))


@query("vector_topk_l2", f"""WITH {_VEC}, s AS (SELECT qid, vec_id AS id, sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], qvec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS position FROM s) SELECT qid, id, round(score, 6) AS score, CAST(position AS INT) AS position FROM r WHERE position <= 10""")
def q_vec_l2(spark, d):
    items = load_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return sr.vector_topk(label_means(spark, d), items, 10, "l2").withColumn("score", F.round("score", 6))


# Every 20th vector against all, by learnt cells; the exact search goes on until no cell can hold a nearer one.
@query("vector_index_cosine", """WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM s) SELECT qid, id, round(score, 6) AS score, CAST(position AS INT) AS position FROM r WHERE position <= 5""")
def q_index_cosine(spark, d):
    items = load_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = items.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return vi.search(vi.build_index(items), asked, 5, exact=True).withColumn("score", F.round("score", 6))


@query("vector_index_l2", """WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS position FROM s) SELECT qid, id, round(score, 6) AS score, CAST(position AS INT) AS position FROM r WHERE position <= 5""")
def q_index_l2(spark, d):
    items = load_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = items.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return vi.search(vi.build_index(items, "l2"), asked, 5, exact=True).withColumn("score", F.round("score", 6))


@query("hash_embedding", """WITH g AS (SELECT item_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM benchmark), h AS (SELECT item_id, ('0x' || left(md5(substr(t, i, 3)), 8))::BIGINT % 256 AS dim FROM g),
c AS (SELECT item_id, dim, count(*) AS c FROM h GROUP BY ALL) SELECT item_id, CAST(dim AS INT) AS dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY item_id)), 6) AS weight FROM c""")
def q_hash_embedding(spark, d):
    return sr.hash_embedding(load_table(spark, d, "benchmark"), "text", "item_id").withColumn("weight", F.round("weight", 6))


@query("text_cluster")
def q_text_cluster(spark, d):
    return sr.text_cluster(load_table(spark, d, "documents"), "text", "doc_id")


@query("centroid", """WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings), x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM r WHERE rn <= 10),
m AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY ALL) SELECT label, CAST(dim AS INT) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""")
def q_centroid(spark, d):
    return sr.centroid(load_table(spark, d, "embeddings"), ["label"], "embedding", [F.col("vec_id").desc()]).withColumn("value", F.round("value", 6))


@query("ranked_facts", """WITH f AS (SELECT page_id AS id, split_part(url, '/', 4) AS user_id, length(url) % 10 / 10.0::DOUBLE AS confidence, page_id % 13 AS refs, page_id * 3600 AS age, page_id % 11 = 0 AS gone FROM pages),
s AS (SELECT *, confidence * 0.4::DOUBLE + least(refs, 10) / 10.0::DOUBLE * 0.3::DOUBLE AS score FROM f WHERE NOT gone AND confidence >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, age DESC, id) AS position FROM s)
SELECT user_id, id, CAST(position AS INT) AS position FROM r WHERE position <= 10""")
def q_ranked_facts(spark, d):
    p = load_table(spark, d, "pages")
    f = p.select(
        F.col("page_id").alias("id"), F.split_part("url", F.lit("/"), F.lit(4)).alias("user_id"), (F.length("url") % 10 / 10.0).alias("confidence"), (F.col("page_id") % 13).alias("reference_count"),
        F.timestamp_seconds(F.col("page_id") * 3600).alias("last_referenced"), F.when(F.col("page_id") % 11 == 0, F.lit(1)).alias("superseded_by"))
    return sr.ranked_facts(f, 10).select("user_id", "id", "position")


# The dictionary: all nations, and all words of five letters and more of the benchmark's passages.
@query("uncovered_names", f"""WITH {TX}, b AS (SELECT building, count(*) AS deals FROM tx GROUP BY 1 HAVING count(*) >= 20), a AS (SELECT lower(n_name) AS k FROM nation UNION SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) FROM benchmark), l AS (SELECT k FROM a WHERE length(k) >= 5)
SELECT building, deals FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE contains(lower(building), k) OR contains(k, lower(building)))""")
def q_uncovered(spark, d):
    words = load_table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("k"))
    names = load_table(spark, d, "nation").select(F.lower("n_name").alias("k")).unionByName(words).filter(F.length("k") >= 5).distinct()
    return sr.uncovered_names(transactions(spark, d), "building", names, "k", 20)


@query("fuzzy_canonical_name")
def q_fuzzy(spark, d):
    return sr.fuzzy_canonical(user_queries(spark, d), "q", load_table(spark, d, "part").select("p_name").distinct(), "p_name", 75).withColumn("score", F.round("score", 4))
