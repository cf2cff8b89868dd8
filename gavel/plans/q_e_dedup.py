"""Duplicates, merging and ordered operators."""

from pyspark.sql import functions as F

from gavel.operators import dedup as dd
from gavel.operators.aggregates import latest_per_key
from gavel.plans.registry import query
from gavel.plans.roles import INTERACTIONS, LISTINGS, MESSAGES, TX, interactions, listings, messages, transactions
from gavel.sources.tables import load_table, ts

# Adverts at a coarser price grain, so that reposts exist: price in steps of 25k.
_COARSE = """coarse AS (SELECT id, CASE WHEN seller LIKE '%7' THEN NULL ELSE building END AS broker, building, area, deal_type, property_type, bedrooms,
  CAST(floor(price / 25000) AS BIGINT) * 25000 AS price, created_at FROM listings)"""


def _coarse(spark, d):
    l = listings(spark, d)
    return l.select(
        "id", F.when(~F.col("seller").endswith("7"), F.col("building")).alias("broker"), "building", "area", "deal_type", "property_type", "bedrooms",
        (F.floor(F.col("price") / 25000) * 25000).cast("bigint").alias("price"), "created_at")


@query("dedup_exact_broker", f"""WITH {LISTINGS}, {_COARSE}, r AS (SELECT id, row_number() OVER (PARTITION BY broker, deal_type, property_type, area, bedrooms, price ORDER BY id DESC) AS rn,
  max(id) OVER (PARTITION BY broker, deal_type, property_type, area, bedrooms, price) AS keep_id FROM coarse WHERE broker IS NOT NULL)
SELECT id, keep_id, rn > 1 AS is_dup FROM r""")
def q_dedup_broker(spark, d):
    rows = _coarse(spark, d).filter(F.col("broker").isNotNull())
    return dd.flag_repeats(rows, ["broker", "deal_type", "property_type", "area", "bedrooms", "price"], "id").select("id", "keep_id", "is_dup")


@query("dedup_exact_contact", f"""WITH {LISTINGS}, {_COARSE}, c AS (SELECT coarse.*, seller AS phone FROM coarse JOIN listings USING (id) WHERE seller IS NOT NULL AND coarse.building IS NOT NULL),
r AS (SELECT id, row_number() OVER (PARTITION BY phone, building, price ORDER BY id DESC) AS rn, max(id) OVER (PARTITION BY phone, building, price) AS keep_id FROM c)
SELECT id, keep_id, rn > 1 AS is_dup FROM r""")
def q_dedup_contact(spark, d):
    rows = listings(spark, d).filter(F.col("seller").isNotNull() & F.col("building").isNotNull())
    keyed = rows.select("id", F.col("seller").alias("phone"), "building", (F.floor(F.col("price") / 25000) * 25000).cast("bigint").alias("price"))
    return dd.flag_repeats(keyed, ["phone", "building", "price"], "id").select("id", "keep_id", "is_dup")


@query("dedup_exact_text", """
WITH r AS (SELECT doc_id AS id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS rn, max(doc_id) OVER (PARTITION BY md5(text)) AS keep_id FROM documents WHERE length(text) > 100)
SELECT id, keep_id, rn > 1 AS is_dup FROM r""")
def q_dedup_text(spark, d):
    docs = load_table(spark, d, "documents").filter(F.length("text") > 100).select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    return dd.flag_repeats(docs, ["h"], "id").select("id", "keep_id", "is_dup")


@query("spam_pattern_groups", f"""WITH {LISTINGS}, {_COARSE}
SELECT lower(building) AS building, price, count(*) AS copies, count(DISTINCT deal_type) AS brokers, round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 8.64e10::DOUBLE, 4) AS span_days
FROM coarse WHERE building IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT deal_type) <= 2 AND (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 8.64e10 <= 2100""")
def q_spam_patterns(spark, d):
    out = dd.spam_pattern_groups(_coarse(spark, d), F.col("deal_type"), 3, 2, 2100)
    return out.withColumn("span_days", F.round("span_days", 4))


@query("autobot_groups", f"""WITH {LISTINGS}, {_COARSE}
SELECT lower(property_type) AS broker, count(*) AS total, count(DISTINCT bedrooms || price) AS unique_objects FROM
 (SELECT property_type, CASE WHEN bedrooms < 5 THEN bedrooms || 'br' END AS bedrooms, CAST(price AS VARCHAR) AS price FROM coarse
  WHERE lower(property_type) NOT IN (SELECT lower(min(c_mktsegment)) FROM customer))
GROUP BY 1 HAVING count(*) > 150 AND 100.0 * count(DISTINCT bedrooms || price) / count(*) < 60""")
def q_autobots(spark, d):
    rows = _coarse(spark, d).withColumn("building", F.when(F.col("bedrooms") < 5, F.concat(F.col("bedrooms").cast("string"), F.lit("br"))))
    white = load_table(spark, d, "customer").agg(F.min("c_mktsegment").alias("broker"))
    return dd.autobot_groups(rows, F.col("property_type"), white, 150, True, 60)


@query("fingerprint_dedup", """
WITH f AS (SELECT page_id AS id, left(sha1(url), 16) AS fp FROM pages),
k AS (SELECT fp, min(id) AS keep_id FROM f GROUP BY fp)
SELECT id, f.fp AS fingerprint, keep_id, id <> keep_id AS is_dup FROM f JOIN k ON f.fp = k.fp""")
def q_fingerprint(spark, d):
    pages = load_table(spark, d, "pages").select(F.col("page_id").alias("id"), dd.fingerprint(F.col("url")).alias("fingerprint"))
    return dd.flag_repeats(pages, ["fingerprint"], "id", "oldest").select("id", "fingerprint", "keep_id", "is_dup")


@query("content_hash", """
WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) >= 30 THEN sha256(s) END AS content_hash FROM k""")
def q_content_hash(spark, d):
    return load_table(spark, d, "documents").select("doc_id", dd.content_hash("text").alias("content_hash"))


@query("listing_key", f"""WITH {LISTINGS}
SELECT id, CASE WHEN id % 7 > 0 THEN concat_ws('|', nullif(lower(replace(area, ' ', '')), ''), CASE WHEN deal_type = 'sale' THEN lower(replace(building, ' ', '')) END,
  CASE WHEN bedrooms <> 0 THEN CAST(bedrooms AS VARCHAR) END, CAST(CAST(trunc(coalesce(size_sqft, 0)) AS BIGINT) AS VARCHAR), CAST(CAST(trunc(price / 1000) AS BIGINT) AS VARCHAR)) END AS listing_key FROM listings""")
def q_listing_key(spark, d):
    l = listings(spark, d)
    known = F.pmod("id", F.lit(7)) > 0
    key = dd.listing_key(
        {"area": F.when(known, F.col("area")), "building": F.when(known & (F.col("deal_type") == "sale"), F.col("building"))},
        F.col("bedrooms"), F.col("size_sqft"), F.col("price"), F.lit(None).cast("int"))
    return l.select("id", key.alias("listing_key"))


_SOURCES = """src AS (SELECT id, confidence_score, area, CASE WHEN deal_quality IS NOT NULL THEN building END AS building, bedrooms, size_sqft, price, deal_quality, created_at,
  CASE WHEN status = 'F' THEN building || created_at::DATE END AS photo_phash FROM listings),
scored AS (SELECT *, coalesce(confidence_score, 0) * 10.0::DOUBLE + ((area <> '')::INT + coalesce((building <> '')::INT, 0) + (bedrooms <> 0)::INT + coalesce((size_sqft <> 0)::INT, 0)
  + coalesce((deal_quality <> '')::INT, 0)) * 2.0::DOUBLE + epoch(created_at) / 86400.0::DOUBLE / 365.0::DOUBLE AS score FROM src),
pg AS (SELECT photo_phash FROM scored WHERE photo_phash IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT 'photo:' || photo_phash AS k, * FROM scored WHERE photo_phash IN (SELECT photo_phash FROM pg)
  UNION ALL SELECT lower(area) || '|' || lower(building) || '|' || bedrooms || '|' || CAST(round(price / 100000.0::DOUBLE) AS BIGINT), * FROM scored
  WHERE (photo_phash IS NULL OR photo_phash NOT IN (SELECT photo_phash FROM pg)) AND building IS NOT NULL AND price > 0),
s AS (SELECT * FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) >= 2)),
w AS (SELECT k, arg_max(id, (score, -id)) AS winner_id, count(*) AS group_size,
  arg_max(building, (score, -id)) FILTER (WHERE building <> '') AS building, arg_max(bedrooms, (score, -id)) FILTER (WHERE bedrooms <> 0) AS bedrooms,
  arg_max(size_sqft, (score, -id)) FILTER (WHERE size_sqft <> 0) AS size_sqft, arg_max(deal_quality, (score, -id)) FILTER (WHERE deal_quality <> '') AS deal_quality FROM s GROUP BY k)"""

_MERGE_FIELDS = ["area", "building", "bedrooms", "size_sqft", "deal_quality"]


def _resolved(spark, d):
    l = listings(spark, d)
    src = l.select(
        "id", "confidence_score", "area", F.when(F.col("deal_quality").isNotNull(), F.col("building")).alias("building"), "bedrooms", "size_sqft", "price", "deal_quality", "created_at",
        F.when(F.col("status") == "F", F.concat("building", F.to_date("created_at").cast("string"))).alias("photo_phash"))
    leads = load_table(spark, d, "events").filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("listing_id"))
    return dd.cross_source_resolve(src, _MERGE_FIELDS, leads)


@query("cross_source_winners", f"""WITH {LISTINGS}, {_SOURCES} SELECT winner_id, group_size, building, bedrooms, size_sqft, deal_quality FROM w""")
def q_cross_source_winners(spark, d):
    return _resolved(spark, d)[0].select("winner_id", "group_size", "building", "bedrooms", "size_sqft", "deal_quality")


@query("cross_source_losers", f"""WITH {LISTINGS}, {_SOURCES}
SELECT s.id, 'dup_of:' || winner_id AS review_reason FROM s JOIN w ON s.k = w.k WHERE s.id <> winner_id AND s.id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def q_cross_source_losers(spark, d):
    return _resolved(spark, d)[1].select("id", "review_reason")


_CASCADE = """m AS (SELECT doc_id AS id, source, lang, n_chars, CASE WHEN n_chars > 60 THEN md5(text) END AS s1, source || '/' || n_chars AS s2,
  CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 50 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS s3,
  CASE WHEN lang <> 'en' THEN lang || '/' || CAST(n_chars // 3 AS VARCHAR) END AS s4 FROM documents),
batch AS (SELECT * FROM m WHERE source LIKE '%1%'), store AS (SELECT * FROM m WHERE source NOT LIKE '%1%')"""


@query("ingest_dedup_cascade", f"""WITH {_CASCADE},
h AS (SELECT b.id, """ + ", ".join(
    f"coalesce((SELECT min(s.id) FROM store s WHERE s.s{i} = b.s{i}), (SELECT min(x.id) FROM batch x WHERE x.s{i} = b.s{i} AND x.id < b.id)) AS m{i}" for i in (1, 2, 3, 4)) + """ FROM batch b)
SELECT id, CASE WHEN m1 IS NOT NULL THEN 'content' WHEN m2 IS NOT NULL THEN 'message' WHEN m3 IS NOT NULL THEN 'signature' WHEN m4 IS NOT NULL THEN 'fields' END AS signal,
  coalesce(m1, m2, m3, m4) AS duplicate_of FROM h""")
def q_ingest_cascade(spark, d):
    docs = load_table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    batch, store = docs.filter(F.col("source").contains("1")), docs.filter(~F.col("source").contains("1"))
    third = F.floor(F.col("n_chars") / 3).cast("string")
    signals = {
        "content": F.when(F.col("n_chars") > 60, F.md5("text")),
        "message": F.concat_ws("/", "source", F.col("n_chars").cast("string")),
        "signature": dd.text_signature("text"),
        "fields": F.when(F.col("lang") != "en", F.concat_ws("/", "lang", third)),
    }
    return dd.ingest_cascade(batch, store, signals).select("id", "signal", "duplicate_of")


_REPOST = """r AS (SELECT id, building AS seller, area AS building, property_type AS area, round(size_sqft / 400) * 400 AS size_sqft, CASE WHEN is_off_plan THEN round(price / 80000) * 400 END AS bua_sqft, price, created_at, status <> 'O' AS is_active FROM listings),
fresh AS (SELECT * FROM r WHERE created_at >= TIMESTAMP '2000-06-01'), old AS (SELECT * FROM r WHERE created_at < TIMESTAMP '2000-06-01' AND is_active)"""


@query("semantic_repost", f"""WITH {LISTINGS}, {_REPOST},
j AS (SELECT f.id, f.price, o.id AS oid, o.price AS oprice, row_number() OVER (PARTITION BY f.id ORDER BY o.created_at DESC, o.id DESC) AS rn FROM fresh f JOIN old o ON f.seller = o.seller AND f.building = o.building AND f.area = o.area
  AND (o.size_sqft = coalesce(nullif(f.size_sqft, 0), nullif(f.bua_sqft, 0)) OR o.bua_sqft = coalesce(nullif(f.size_sqft, 0), nullif(f.bua_sqft, 0))))
SELECT id, oid AS repost_of FROM j WHERE rn = 1 AND price >= oprice""")
def q_semantic_repost(spark, d):
    l = listings(spark, d).select(
        "id", F.col("building").alias("seller"), F.col("area").alias("building"), F.col("property_type").alias("area"), (F.round(F.col("size_sqft") / 400) * 400).alias("size_sqft"),
        F.when(F.col("is_off_plan"), F.round(F.col("price") / 80000) * 400).alias("bua_sqft"), "price", "created_at", (F.col("status") != "O").alias("is_active"))
    cut = ts("2000-06-01 00:00:00")
    return dd.semantic_repost(l.filter(F.col("created_at") >= cut), l.filter(F.col("created_at") < cut))


_PARTS = """p AS (SELECT id, lang AS chat, chat AS author, CASE WHEN length(text) % 5 = 0 THEN id - 1 ELSE id END AS message_id, ts,
  CASE WHEN length(text) % 2 = 0 THEN text ELSE '' END AS text, CASE WHEN length(text) % 5 <= 1 THEN 2 ELSE 1 END AS blocks_in_message,
  CASE WHEN length(text) % 3 = 0 THEN 1000 + length(text) % 2 END AS price, CASE WHEN length(text) % 2 = 0 THEN 'Area ' || lang END AS area,
  CASE WHEN length(text) % 4 = 1 THEN 'Tower' END AS building, CASE WHEN length(text) % 7 < 3 THEN length(text) % 2 END AS bedrooms,
  CASE WHEN length(text) % 6 = 2 THEN 500.0::DOUBLE END AS size_sqft, id % 3 = 0 AS has_images FROM messages)"""


def message_parts(spark, d):
    """Documents as fragments of adverts with partly filled fields."""
    m, n = messages(spark, d), F.length("text")
    return m.select(
        "id", F.col("lang").alias("chat"), F.col("chat").alias("author"), F.when(n % 5 == 0, F.col("id") - 1).otherwise(F.col("id")).alias("message_id"), "ts",
        F.when(n % 2 == 0, F.col("text")).otherwise("").alias("text"), F.when(n % 5 <= 1, 2).otherwise(1).alias("blocks_in_message"),
        F.when(n % 3 == 0, 1000 + n % 2).alias("price"), F.when(n % 2 == 0, F.concat(F.lit("Area "), "lang")).alias("area"),
        F.when(n % 4 == 1, "Tower").alias("building"), F.when(n % 7 < 3, n % 2).alias("bedrooms"), F.when(n % 6 == 2, 500.0).alias("size_sqft"),
        F.lit(None).cast("int").alias("floor"), F.lit(None).cast("string").alias("unit"), (F.col("id") % 3 == 0).alias("has_images"))


def pair_ok(a: str, b: str) -> str:
    """Compatibility of two fragments, spelled out pair by pair for the oracle."""
    fields = {"price": ("nullif({0}.price, 0)",), "area": ("nullif(lower(trim({0}.area)), '')",), "building": ("nullif(lower(trim({0}.building)), '')",), "bedrooms": ("{0}.bedrooms",)}
    agree = " AND ".join(f"({e[0].format(a)} IS NULL OR {e[0].format(b)} IS NULL OR {e[0].format(a)} = {e[0].format(b)})" for e in fields.values())
    share = " OR ".join(f"({e[0].format(a)} IS NOT NULL AND {e[0].format(b)} IS NOT NULL)" for e in fields.values())
    return f"({agree} AND ({share} OR trim({a}.text) <> '' OR trim({b}.text) <> ''))"


_GROUPS = """lagged AS (SELECT *, lag(ts) OVER w AS pts, lag(message_id) OVER w AS pm FROM p WINDOW w AS (PARTITION BY chat, author ORDER BY ts, id)),
opened AS (SELECT *, CASE WHEN pts IS NULL OR epoch(ts) - epoch(pts) > 3600 OR pm = message_id THEN id END AS o FROM lagged),
sess AS (SELECT *, max(o) OVER (PARTITION BY chat, author ORDER BY ts, id) AS s FROM opened),
grp AS (SELECT 'msg|' || chat || '|' || message_id AS g, * EXCLUDE (pts, pm, o, s) FROM sess UNION ALL SELECT 'time|' || chat || '|' || author || '|' || s, * EXCLUDE (pts, pm, o, s) FROM sess)"""

_COMPONENTS = _GROUPS + f""",
e AS (SELECT a.g, a.id AS x, b.id AS y FROM grp a JOIN grp b ON a.g = b.g AND a.id <> b.id AND {pair_ok('a', 'b')}),
nb AS (SELECT g, x, list(y ORDER BY y) AS ys FROM (SELECT g, x, y FROM e UNION SELECT g, x, x FROM e) GROUP BY g, x),
comp AS (SELECT n.g, n.x, n.ys FROM nb n WHERE NOT EXISTS (SELECT 1 FROM nb m WHERE m.g = n.g AND list_contains(n.ys, m.x) AND m.ys <> n.ys)),
f AS (SELECT c.g || '/' || c.ys[1] AS c, r.* FROM comp c JOIN grp r ON r.g = c.g AND r.id = c.x)"""


@query("session_chains", f"""WITH {MESSAGES}, {_PARTS}, {_GROUPS} SELECT id, s AS session_first FROM sess""")
def q_session_chains(spark, d):
    from gavel.functions.scale import gap_sessions

    return gap_sessions(message_parts(spark, d), ["chat", "author"], "ts", "id", 3600, same_breaks="message_id").select("id", "session_first")


_MERGED = _COMPONENTS + """,
k AS (SELECT c, count(*) AS parts, arg_max(id, (length(text), CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END, -id)) AS primary_id, bool_or(has_images) AS has_images,
  bool_and(coalesce(area, '') <> '' AND price IS NOT NULL AND bedrooms IS NOT NULL AND coalesce(building, '') <> '') AS allc, bool_or(coalesce(area, '') <> '' AND price IS NOT NULL AND bedrooms IS NOT NULL AND coalesce(building, '') <> '') AS anyc,
  count(DISTINCT nullif(size_sqft, 0)) AS sizes, bool_or(length(trim(text)) >= 50) AND bool_or(length(trim(text)) < 20) AS rp,
  count(DISTINCT message_id) = 1 AND count(*) = 2 AND bool_and(blocks_in_message = 2) AND bool_or(area <> '' AND coalesce(building, '') = '' AND coalesce(price, 0) = 0) AND bool_or(coalesce(building, '') <> '' AND coalesce(price, 0) <> 0) AS hd,
  (count(nullif(area, '')) BETWEEN 1 AND count(*) - 1) OR (count(nullif(price, 0)) BETWEEN 1 AND count(*) - 1) OR (count(nullif(building, '')) BETWEEN 1 AND count(*) - 1)
   OR (count(nullif(bedrooms, 0)) BETWEEN 1 AND count(*) - 1) OR (count(nullif(size_sqft, 0)) BETWEEN 1 AND count(*) - 1) OR (count(nullif(text, '')) BETWEEN 1 AND count(*) - 1) AS useful,
  arg_min(price, (ts, id)) FILTER (WHERE price <> 0) AS fp, arg_min(area, (ts, id)) FILTER (WHERE area <> '') AS fa, arg_min(building, (ts, id)) FILTER (WHERE building <> '') AS fb,
  arg_min(bedrooms, (ts, id)) FILTER (WHERE bedrooms <> 0) AS fbr, arg_min(size_sqft, (ts, id)) FILTER (WHERE size_sqft <> 0) AS fs FROM f GROUP BY c),
pick AS (SELECT * FROM k WHERE NOT allc AND sizes <= 1 AND (anyc OR useful) AND (rp OR coalesce(hd, FALSE)) QUALIFY row_number() OVER (PARTITION BY primary_id ORDER BY c) = 1)"""


@query("message_merge", f"""WITH {MESSAGES}, {_PARTS}, {_MERGED}
SELECT k.primary_id, k.parts, k.has_images, coalesce(nullif(o.price, 0), fp) AS price, coalesce(nullif(o.area, ''), fa) AS area, coalesce(nullif(o.building, ''), fb) AS building,
  coalesce(o.bedrooms, fbr) AS bedrooms, coalesce(nullif(o.size_sqft, 0), fs) AS size_sqft FROM pick k JOIN p o ON o.id = k.primary_id""")
def q_message_merge(spark, d):
    merged, _ = dd.message_merge(message_parts(spark, d), ["price", "area", "building", "bedrooms", "size_sqft"], 3600)
    return merged.drop("component")


@query("message_merge_texts", f"""WITH {MESSAGES}, {_PARTS}, {_MERGED}
SELECT k.primary_id, min(f.id) AS first_id, md5(trim(f.text)) AS text_md5 FROM pick k JOIN f ON f.c = k.c WHERE trim(f.text) <> '' GROUP BY k.primary_id, trim(f.text)""")
def q_message_merge_texts(spark, d):
    _, texts = dd.message_merge(message_parts(spark, d), ["price", "area", "building", "bedrooms", "size_sqft"], 3600)
    return texts.select("primary_id", "first_id", F.md5("text").alias("text_md5"))


@query("lag_gap", f"""WITH {TX}, o AS (SELECT building, deal_date AS dd, lag(deal_date) OVER (PARTITION BY building ORDER BY deal_date) AS p FROM tx WHERE deal_date >= DATE '1999-08-01')
SELECT building, count(*) AS deals, round(avg(dd - p), 6) AS avg_days_between FROM o GROUP BY building""")
def q_lag_gap(spark, d):
    tx = transactions(spark, d).filter(F.col("deal_date") >= F.lit("1999-08-01").cast("date"))
    return dd.deal_gaps(tx, ["building"], "deal_date").withColumn("avg_days_between", F.round("avg_days_between", 6))


@query("pct_change_flags", f"""WITH {TX}, m AS (SELECT area, date_trunc('month', deal_date) AS p, avg(price) AS v FROM tx GROUP BY ALL),
l AS (SELECT area, p, v, lag(v) OVER w AS prev, coalesce(lag(v, 11) OVER w, first_value(v) OVER w) AS base FROM m WINDOW w AS (PARTITION BY area ORDER BY p))
SELECT area, strftime(p, '%Y-%m') AS period, round((v - prev) / prev, 6) AS change, coalesce(abs((v - prev) / prev) >= 0.1, FALSE) AS is_jump,
  CASE WHEN prev IS NOT NULL THEN round((v - base) / base * 100, 6) END AS yoy_pct FROM l""")
def q_pct_change(spark, d):
    m = transactions(spark, d).groupBy("area", F.date_trunc("month", "deal_date").alias("p")).agg(F.avg("price").alias("v"))
    return dd.pct_change_flags(m, ["area"], "p", "v").select("area", F.date_format("p", "yyyy-MM").alias("period"), F.round("change", 6).alias("change"), "is_jump", F.round("yoy_pct", 6).alias("yoy_pct"))


@query("streak", f"""WITH {INTERACTIONS}, r AS (SELECT bot_name, sum(CASE WHEN outcome <> 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY bot_name ORDER BY id DESC) AS breaks FROM interactions)
SELECT bot_name, count(*) FILTER (WHERE breaks = 0) AS streak FROM r GROUP BY bot_name""")
def q_streak(spark, d):
    return dd.streak(interactions(spark, d), ["bot_name"], "id", F.col("outcome") == "success")


@query("latest_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def q_latest_per_key(spark, d):
    return latest_per_key(load_table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("diversified_topn", f"""WITH RECURSIVE {MESSAGES},
pool AS (SELECT id, lower(chat) AS b, CASE WHEN length(text) * 3000 < 1000000 THEN 0 WHEN length(text) * 3000 < 3000000 THEN 1 WHEN length(text) * 3000 < 10000000 THEN 2 ELSE 3 END AS p,
  row_number() OVER (ORDER BY abs(length(text) - 330), ts DESC, id DESC) AS rn FROM messages WHERE lang = 'en' QUALIFY rn <= 30),
pick AS (SELECT 0 AS rn, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS bs, CAST([] AS INT[]) AS ps
  UNION ALL SELECT q.rn::INT, CASE WHEN ok THEN list_append(ids, q.id) ELSE ids END, CASE WHEN ok THEN list_append(bs, q.b) ELSE bs END, CASE WHEN ok AND NOT list_contains(ps, q.p) THEN list_append(ps, q.p) ELSE ps END
  FROM (SELECT o.*, pick.ids, pick.bs, pick.ps, NOT (list_contains(pick.bs, o.b) OR (list_contains(pick.ps, o.p) AND len(pick.ps) >= 2)) AND len(pick.ids) < 5 AS ok FROM pick JOIN pool o ON o.rn = pick.rn + 1) q)
SELECT CAST(generate_subscripts(ids, 1) AS INT) AS rank, unnest(ids) AS id FROM (SELECT ids FROM pick ORDER BY rn DESC LIMIT 1)""")
def q_diversified(spark, d):
    ex = messages(spark, d).select("id", "text", F.col("lang").alias("kind"), F.col("chat").alias("building"), (F.length("text") * 3000).alias("price"), F.col("ts").alias("created_at"))
    return dd.diversified_topn(ex, 330, "en", 5)


def _facts(spark, d):
    """The two parts of a page address as remembered facts of the language's readers."""
    p = load_table(spark, d, "pages")
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return p.select(
        F.col("page_id").alias("id"), F.split_part("url", F.lit("/"), F.lit(4)).alias("user_id"), F.split_part(F.col("url"), F.lit(":"), F.lit(1)).alias("fact_type"),
        host.alias("fact_text"), (F.pmod(F.length("url"), F.lit(10)) / 10.0).alias("confidence"), F.lit(1).alias("reference_count"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600).cast("timestamp_ntz").alias("last_referenced"),
        F.timestamp_seconds(F.lit(1699067200) + F.col("page_id") * 3600).cast("timestamp_ntz").alias("created_at"))


# Facts in id order; each looks for kept ones among its earlier neighbours. The recursion goes through all facts with one list of those kept.
@query("near_dup_merge", """WITH RECURSIVE f AS (SELECT page_id AS id, split_part(url, '/', 4) || '|' || split_part(url, ':', 1) AS k, split_part(url, '/', 3) AS t FROM pages),
g AS (SELECT id, k, t, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM f),
u AS (SELECT k, t, any_value(g) AS g, min(id) AS id FROM g GROUP BY k, t), e AS (SELECT y.id AS y, list(x.id) AS before FROM u x JOIN u y ON x.k = y.k AND x.id < y.id AND len(list_intersect(x.g, y.g)) >= 0.6 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) GROUP BY y.id),
o AS (SELECT u.id, coalesce(before, []) AS before, row_number() OVER (ORDER BY u.id) AS i FROM u LEFT JOIN e ON e.y = u.id),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN len(list_intersect(r.kept, o.before)) > 0 THEN r.kept ELSE list_append(r.kept, o.id) END FROM r JOIN o ON o.i = r.i + 1),
z AS (SELECT kept FROM r ORDER BY i DESC LIMIT 1), s AS (SELECT o.id, list_min(list_intersect(o.before, z.kept)) AS into_id FROM o, z)
SELECT f.id, CASE WHEN s.into_id IS NOT NULL THEN s.into_id WHEN f.id <> u.id THEN u.id END AS superseded_by FROM f JOIN u ON u.k = f.k AND u.t = f.t JOIN s ON s.id = u.id WHERE s.into_id IS NOT NULL OR f.id <> u.id""")
def q_near_dup_merge(spark, d):
    return dd.near_dup_merge(_facts(spark, d))[1].select("id", "superseded_by")


@query("decay_and_prune", """
WITH f AS (SELECT page_id AS id, length(url) % 10 / 10.0::DOUBLE AS c, TIMESTAMP '2024-01-01' + to_seconds(page_id * 3600) AS lr, to_timestamp(1699067200 + page_id * 3600)::TIMESTAMP AS ca FROM pages),
x AS (SELECT id, ca, CASE WHEN lr < TIMESTAMP '2024-02-05' - INTERVAL 30 DAYS THEN greatest(0.05::DOUBLE, c - 0.05::DOUBLE) ELSE c END AS confidence FROM f)
SELECT id, round(confidence, 4) AS confidence FROM x WHERE NOT (confidence < 0.1 AND ca < TIMESTAMP '2024-02-05' - INTERVAL 60 DAYS)""")
def q_decay(spark, d):
    return dd.decay_and_prune(_facts(spark, d), ts("2024-02-05 00:00:00")).select("id", F.round("confidence", 4).alias("confidence"))


@query("stratified_sample", f"""WITH {LISTINGS}, t AS (SELECT id, price, CASE WHEN price <= 100000 THEN 1 WHEN price <= 250000 THEN 2 WHEN price <= 400000 THEN 3 ELSE 4 END AS tier FROM listings),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('s42' || id), id) AS rn FROM t)
SELECT id, tier FROM r WHERE rn <= 8""")
def q_stratified(spark, d):
    p = F.col("price")
    return dd.stratified_sample(listings(spark, d), F.when(p <= 100000, 1).when(p <= 250000, 2).when(p <= 400000, 3).otherwise(4), "id", 8, "s42").select("id", "tier")


@query("price_history_diff", f"""WITH {LISTINGS}, h AS (SELECT building, id, price, lag(price) OVER (PARTITION BY building ORDER BY created_at, id) AS old_price FROM listings)
SELECT id, building, round(abs(old_price - price), 2) AS discount_amount, abs(round_even((old_price - price) / old_price * 100.0::DOUBLE, 1)) AS discount_percent, old_price - price > 0 AS price_drop_detected
FROM h WHERE price <> old_price""")
def q_price_history(spark, d):
    out = dd.price_history_diff(listings(spark, d), "building", "created_at", "id")
    return out.select("id", "building", F.round("discount_amount", 2).alias("discount_amount"), "discount_percent", "price_drop_detected")
