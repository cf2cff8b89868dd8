"""Entity search, aliases, vector similarity and text clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.exprs import bind
from gavel.functions.scale import best_per_key, spread, top_n
from gavel.functions.similarity import containment_pairs, fuzzy_pairs, trigram_pairs
from gavel.session import cut_lineage



def search_text(col: Column | str) -> Column:
    """Query spelling: lower, blanks collapsed, letters (Latin, Cyrillic, Arabic), digits, dash."""
    c = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\p{L}\p{N}_ \-()]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def entity_search(queries: DataFrame, names: DataFrame, limit: int = 10, min_similarity: float = 0.3) -> DataFrame:
    """Cascade per query: exact → prefix → substring → trigram → popular.

    ``queries``: qid, q. ``names``: name, area, deals (one row per entity). Distinct query texts
    are matched once; substring and trigram candidates come from rare n-grams. Queries without
    any hit get the most popular entities (a list of ``limit`` rows).
    """
    q = queries.select("qid", search_text("q").alias("qn")).filter(F.col("qn") != "")
    n = names.withColumn("low", F.lower("name"))
    inside = containment_pairs(q, "qn", n, "low").select(F.col("needle").alias("qn"), F.col("text").alias("low"))
    stage = F.when(F.trim("low") == F.col("qn"), 1).when(F.startswith("low", "qn"), 2).otherwise(3)
    found = inside.withColumn("stage", stage).withColumn("similarity", F.lit(None).cast("double"))
    fuzzy = trigram_pairs(q.filter(F.length("qn") >= 3), "qn", n, "low", min_similarity).select(F.col("a").alias("qn"), F.col("b").alias("low"), F.lit(4).alias("stage"), "similarity")
    pairs = found.unionByName(fuzzy.join(inside, ["qn", "low"], "left_anti"))
    hits = pairs.join(n, "low")
    order = [F.col("stage"), F.col("similarity").desc_nulls_last(), F.col("deals").desc_nulls_last(), F.col("name"), F.col("area")]
    ranked = top_n(hits, ["qn"], order, limit, "position")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("exact", "prefix", "substring", "fuzzy")]), F.col("stage"))
    direct = q.join(ranked, "qn").select("qid", "position", kind.alias("kind"), "name", "area", "deals")
    popular_rank = Window.orderBy(F.col("deals").desc_nulls_last(), "name", "area")
    popular = names.orderBy(F.col("deals").desc_nulls_last(), "name", "area").limit(limit).withColumn("position", F.row_number().over(popular_rank))
    shelf = popular.agg(F.collect_list(F.struct("position", "name", "area", "deals"))).scalar()
    lost = queries.select("qid").join(direct.select("qid").distinct(), "qid", "left_anti").select("qid", F.explode(shelf).alias("p"))
    return direct.unionByName(lost.select("qid", "p.position", F.lit("popular").alias("kind"), "p.name", "p.area", "p.deals"))


def area_search(queries: DataFrame, zones: DataFrame, areas: DataFrame, limit: int = 5) -> DataFrame:
    """Cascade per query: zone exact → member name (equal or containing) → zone containing →
    areas that belong to no zone. ``zones``: zone, members, deals; ``areas``: area, deals."""
    q = queries.select("qid", search_text("q").alias("qn")).filter(F.col("qn") != "")
    z = zones.withColumn("low", F.lower("zone"))
    members = zones.select("zone", "deals", F.explode("members").alias("m")).withColumn("low", F.lower("m"))
    free = areas.withColumn("low", F.lower("area")).join(members.select("low").unionByName(z.select("low")).distinct(), "low", "left_anti")

    def hits(df: DataFrame, name: str, stage: int, exact: bool | None) -> DataFrame:
        p = containment_pairs(q, "qn", df, "low").select(F.col("needle").alias("qn"), F.col("text").alias("low"))
        if exact is not None:
            p = p.filter((F.col("low") == F.col("qn")) == F.lit(exact))
        return p.join(df, "low").select("qn", F.col(name).alias("hit"), "deals", F.lit(stage).alias("stage"))

    every = hits(z, "zone", 1, True).unionByName(hits(members, "zone", 2, None)).unionByName(hits(z, "zone", 3, False)).unionByName(hits(free, "area", 4, None))
    best = every.groupBy("qn", "hit").agg(F.min("stage").alias("stage"), F.max("deals").alias("deals"))
    ranked = top_n(best, ["qn"], [F.col("stage"), F.col("deals").desc_nulls_last(), F.col("hit")], limit, "position")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("zone_exact", "member", "zone_fuzzy", "area")]), F.col("stage"))
    return q.join(ranked, "qn").select("qid", "position", kind.alias("kind"), "hit", "deals")


def alias_expand(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """All spellings of a query's synonym group: the name itself, else the longest group name
    that contains it or is contained in it, else the query alone. ``groups``: group_id, name."""
    q = queries.select("qid", "q", F.lower(F.trim("q")).alias("k"))
    g = groups.select("group_id", "name", F.lower(F.trim("name")).alias("n"))
    exact = q.select("k").distinct().join(g, F.col("k") == F.col("n")).select("k", "group_id", F.lit(0).alias("stage"), "n")
    a = containment_pairs(g, "n", q, "k").select(F.col("text").alias("k"), F.col("needle").alias("n"))
    b = containment_pairs(q, "k", g, "n").select(F.col("needle").alias("k"), F.col("text").alias("n"))
    near = a.unionByName(b).distinct().join(g, "n").select("k", "group_id", F.lit(1).alias("stage"), "n")
    pick = best_per_key(exact.unionByName(near), ["k"], [F.col("stage"), F.length("n").desc(), F.col("n"), F.col("group_id")]).select("k", "group_id")
    out = q.join(pick, "k", "left").join(g.select("group_id", "name"), "group_id", "left")
    return out.select("qid", F.coalesce("name", "q").alias("variant")).distinct()


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a) * _dot(b, b)), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def vector_topk(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """Nearest items per query vector. ``queries``: qid, qvec; ``items``: id, vec.

    Queries go through in blocks of about ``block`` (dealt by hash): a block travels as one array value to every
    scan task; items never move. Each task scores its rows and keeps k per query before the shuffle
    (window group limit).
    """
    blocks = max(1, -(-queries.count() // block))
    wanted = items.filter(F.col("vec").isNotNull())
    scored = None
    for number in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == number) if blocks > 1 else queries
        batch = own.agg(F.collect_list(F.struct("qid", "qvec")).alias("b")).scalar()
        pairs = wanted.select("id", "vec", F.explode(batch).alias("q")).select("id", "vec", "q.qid", "q.qvec")
        measure = cosine(F.col("vec"), F.col("qvec")) if metric == "cosine" else l2_distance(F.col("vec"), F.col("qvec"))
        part = pairs.select("qid", "id", measure.alias("score"))
        scored = part if scored is None else scored.unionByName(part)
    order = F.col("score").desc_nulls_last() if metric == "cosine" else F.col("score").asc_nulls_last()
    return top_n(scored, ["qid"], [order, F.col("id")], k, "position")


def hash_embedding(docs: DataFrame, text: str, doc_id: str, dim: int = 256, n: int = 3) -> DataFrame:
    """L2-normalised counts of hashed character n-grams of the whole lower-cased text, long form
    (id, dim, weight). The hash is taken from MD5, so vectors are the same on every engine."""

    def grams(low: Column) -> Column:
        last = F.length(low) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))

    cut = bind(F.lower(F.coalesce(F.col(text), F.lit(""))), grams)
    each = docs.select(doc_id, F.explode(cut).alias("g")).groupBy(doc_id, "g").agg(F.count("*").alias("c"))
    bucket = F.pmod(F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    counts = each.groupBy(doc_id, bucket.alias("dim")).agg(F.sum("c").cast("double").alias("c"))
    norms = counts.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, doc_id).select(doc_id, "dim", (F.col("c") / F.col("norm")).alias("weight"))


def text_cluster(docs: DataFrame, text: str, doc_id: str, k: int = 10, features: int = 512, seed: int = 42) -> DataFrame:
    """Cluster id per text: TF-IDF of words and word pairs, k-means|| with ``k`` clusters; fewer texts than that are an error.
    Texts are cut into words once: fitting and the result read their term counts from the shared folder."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.try_element_at("w", i + 2)))
    rows = spread(docs.select(doc_id, text), doc_id).select(doc_id, words.alias("w")).withColumn("terms", F.concat("w", pairs))
    tf = cut_lineage(HashingTF(inputCol="terms", outputCol="tf", numFeatures=features).transform(rows).select(doc_id, "tf"), "terms")
    weighted = IDF(inputCol="tf", outputCol="features").fit(tf).transform(tf)
    if tf.limit(k).count() < k:
        raise ValueError(f"fewer than {k} texts cannot make {k} clusters")
    model = KMeans(k=k, seed=seed, maxIter=25, featuresCol="features", predictionCol="cluster_id").fit(weighted)
    return model.transform(weighted).select(doc_id, "cluster_id")


def centroid(vectors: DataFrame, keys: Sequence[str], vec: str, order: Sequence[Column], top: int = 10) -> DataFrame:
    """L2-normalised mean of the ``top`` vectors per key, long form (key, dim, value)."""
    best = top_n(vectors.filter(F.col(vec).isNotNull()), keys, order, top)
    mean = best.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy(*keys).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, list(keys)).select(*keys, "dim", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("value"))


def ranked_facts(facts: DataFrame, limit: int, min_confidence: float = 0.3, blended: bool = True) -> DataFrame:
    """Active facts per user by .4·confidence + .3·capped references (or confidence), newest first."""
    live = facts.filter(F.col("superseded_by").isNull() & (F.col("confidence") >= min_confidence))
    score = F.col("confidence") * 0.4 + F.least(F.col("reference_count"), F.lit(10)) / 10.0 * 0.3 if blended else F.col("confidence")
    return top_n(live.withColumn("score", score), ["user_id"], [F.col("score").desc(), F.col("last_referenced").desc(), F.col("id")], limit, "position")


def uncovered_names(deals: DataFrame, name: str, aliases: DataFrame, alias: str, min_deals: int) -> DataFrame:
    """Frequent names that no alias equals, contains or is contained in."""
    busy = deals.filter(F.trim(name) != "").groupBy(name).agg(F.count("*").alias("deals")).filter(F.col("deals") >= min_deals).withColumn("low", F.lower(F.trim(name)))
    keys = aliases.select(F.lower(F.trim(alias)).alias("k"))
    inside = containment_pairs(keys, "k", busy, "low").select(F.col("text").alias("low"))
    around = containment_pairs(busy, "low", keys, "k").select(F.col("needle").alias("low"))
    return busy.join(inside.unionByName(around).distinct(), "low", "left_anti").select(name, "deals")


def fuzzy_canonical(values: DataFrame, col: str, names: DataFrame, name: str, cutoff: float = 75) -> DataFrame:
    """Canonical name per distinct value: equal (case-blind), else the best token-sorted
    similarity at or above ``cutoff``; ties to the alphabetically first name."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(col))), r"[*#@]+", ""), r"\s+", " "))
    v = values.select(clean.alias("value")).filter(F.col("value") != "").distinct()
    d = names.select(F.col(name).alias("hit"), F.lower(F.trim(F.col(name))).alias("low")).distinct()
    exact = v.join(d, F.col("value") == F.col("low")).select("value", "hit", F.lit(101.0).alias("score"))
    rest = v.join(exact.select("value"), "value", "left_anti")
    fuzzy = fuzzy_pairs(rest, "value", d, "low", cutoff).join(d, F.col("b") == F.col("low")).select(F.col("a").alias("value"), "hit", "score")
    best = best_per_key(exact.unionByName(fuzzy), ["value"], [F.col("score").desc(), F.col("hit")])
    return best.withColumn("score", F.least(F.col("score"), F.lit(100.0)))


def fuzzy_area(values: DataFrame, col: str, areas: DataFrame, name: str, aliases: DataFrame, cutoff: float = 80) -> DataFrame:
    """Area per distinct value: by alias (``alias``, ``name``), by equal name (case-blind), else the name with the best token-sorted
    similarity at or above ``cutoff``; ties to the alphabetically first. Only names, not aliases, are tried for similarity."""
    v = values.select(F.lower(F.trim(F.col(col))).alias("value")).filter(F.col("value") != "").distinct()
    known = aliases.select(F.lower(F.trim("alias")).alias("value"), F.col("name").alias("hit")).groupBy("value").agg(F.min("hit").alias("hit"))
    own = areas.select(F.lower(F.col(name)).alias("value"), F.col(name).alias("hit")).groupBy("value").agg(F.min("hit").alias("hit"))
    by_alias = v.join(known, "value").select("value", "hit", F.lit(0).alias("stage"), F.lit(100.0).alias("score"))
    by_name = v.join(own, "value").select("value", "hit", F.lit(1).alias("stage"), F.lit(100.0).alias("score"))
    rest = v.join(by_alias.select("value").unionByName(by_name.select("value")), "value", "left_anti")
    near = fuzzy_pairs(rest, "value", own.select(F.col("value").alias("low")), "low", cutoff).join(own.withColumnRenamed("value", "b"), "b")
    near = near.select(F.col("a").alias("value"), "hit", F.lit(2).alias("stage"), "score")
    best = best_per_key(by_alias.unionByName(by_name).unionByName(near), ["value"], [F.col("stage"), F.col("score").desc(), F.col("hit")])
    return best.select("value", "hit", "score")
