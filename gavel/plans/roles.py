"""The given tables in the roles the operators expect, as DataFrames and as oracle CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.exprs import half_up
from gavel.functions.scale import spread
from gavel.sources.tables import load_table

AS_OF = "2001-08-01"  # the reference date of all trailing windows over orders and lineitem


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """lineitem ⋈ part ⋈ supplier ⋈ nation as sale and rent transactions."""
    li, p = load_table(spark, d, "lineitem"), load_table(spark, d, "part")
    s, n = load_table(spark, d, "supplier"), load_table(spark, d, "nation")
    return (
        li.join(p, li.l_partkey == p.p_partkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .join(n, s.s_nationkey == n.n_nationkey)
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("n_name").alias("area"),
            F.col("p_name").alias("building"),
            F.col("p_brand").alias("developer"),
            F.lower("p_type").alias("property_type"),
            F.floor(F.col("p_size") / 10).cast("int").alias("bedrooms"),
            F.when(F.col("l_linestatus") == "O", "sale").otherwise("rent").alias("deal_type"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("size_sqft"),
            F.to_date("l_shipdate").alias("deal_date"),
        )
    )


TX = """tx AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, n_name AS area, p_name AS building, p_brand AS developer,
         lower(p_type) AS property_type, CAST(floor(p_size / 10) AS INT) AS bedrooms,
         CASE WHEN l_linestatus = 'O' THEN 'sale' ELSE 'rent' END AS deal_type,
         l_extendedprice AS price, l_quantity AS size_sqft, CAST(l_shipdate AS DATE) AS deal_date
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


def listings(spark: SparkSession, d: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation as adverts: seller, area, building, price, quality."""
    o, c = load_table(spark, d, "orders"), load_table(spark, d, "customer")
    n = load_table(spark, d, "nation")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("c_name").alias("seller"),
            F.col("n_name").alias("area"),
            F.concat(F.lit("TOWER "), F.pmod(F.col("c_custkey"), F.lit(40)).cast("string")).alias("building"),
            F.lower("c_mktsegment").alias("property_type"),
            F.when(F.col("o_orderstatus") == "F", "rent").otherwise("sale").alias("deal_type"),
            F.pmod(F.floor(F.col("o_totalprice") / 10000), F.lit(6)).cast("int").alias("bedrooms"),
            F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 200, 0)).alias("size_sqft"),
            F.col("o_totalprice").alias("price"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "very_good")
            .when(F.col("o_orderpriority") == "2-HIGH", "good")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "interesting")
            .when(F.col("o_orderpriority") == "5-LOW", "normal")
            .alias("deal_quality"),
            F.col("o_orderstatus").alias("status"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_hot_deal"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority") == "5-LOW").alias("is_off_plan"),
            half_up(F.col("c_acctbal") / 10000, 4).alias("confidence_score"),
            F.col("o_orderdate").alias("created_at"),
        )
    )


LISTINGS = """listings AS (
  SELECT o_orderkey AS id, c_name AS seller, n_name AS area, 'TOWER ' || CAST(c_custkey % 40 AS VARCHAR) AS building,
         lower(c_mktsegment) AS property_type, CASE WHEN o_orderstatus = 'F' THEN 'rent' ELSE 'sale' END AS deal_type,
         CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) % 6 AS INT) AS bedrooms,
         CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 200, 0) END AS size_sqft, o_totalprice AS price,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'very_good' WHEN '2-HIGH' THEN 'good'
              WHEN '3-MEDIUM' THEN 'interesting' WHEN '5-LOW' THEN 'normal' END AS deal_quality,
         o_orderstatus AS status, o_orderpriority = '1-URGENT' AS is_hot_deal,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority = '5-LOW' END AS is_off_plan,
         round(c_acctbal / 10000, 4) AS confidence_score, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """events as assistant interactions; the JSON key picks the bot."""
    e = load_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.element_at(F.array(*[F.lit(b) for b in BOTS]), F.pmod(k, F.lit(len(BOTS))) + 1).alias("bot_name"),
        "user_id",
        "ts",
        "event_type",
        k.alias("k"),
        (F.col("value") * 100).cast("int").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").when(k < 10, "empty").otherwise("success").alias("outcome"),
        F.concat_ws(" ", F.lit("Find"), "event_type", (k - F.pmod(k, F.lit(5))).cast("string")).alias("user_message"),
    )


BOTS = ["resale", "analytics", "roi", "hub"]

INTERACTIONS = """interactions AS (
  SELECT event_id AS id, ['resale', 'analytics', 'roi', 'hub'][k % 4 + 1] AS bot_name, user_id, ts, event_type, k,
         CAST(trunc(value * 100) AS INT) AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' WHEN k < 10 THEN 'empty' ELSE 'success' END AS outcome,
         'Find ' || event_type || ' ' || CAST(k - k % 5 AS VARCHAR) AS user_message
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """documents as channel messages in time order, one every 45 seconds."""
    return load_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("chat"),
        "lang",
        "text",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 45).cast("timestamp_ntz").alias("ts"),
    )


MESSAGES = """messages AS (
  SELECT doc_id AS id, source AS chat, lang, text, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 45) AS ts FROM documents)"""


def adverts(spark: SparkSession, d: str) -> DataFrame:
    """Listings written out as advert texts in five styles, one per quality label."""
    l = spread(listings(spark, d), "id")
    br, q = F.col("bedrooms"), F.col("deal_quality")
    n = lambda c: c.cast("string")
    sale, rent = (F.col("price") * 10).cast("bigint"), (F.col("price") / 4).cast("bigint") + 20000
    sqft = F.coalesce(F.format_number(F.col("size_sqft"), 0), F.lit("n/a"))
    rooms = F.when(br == 0, "Studio").otherwise(F.concat(n(br), F.lit("BR")))
    quarter = F.lower(F.replace("area", F.lit("NATION"), F.lit("Quarter")))
    spaced = F.regexp_replace(F.format_number(sale, 0), ",", " ")
    text = (
        F.when(q == "very_good", F.concat(F.lit("🔥 FOR SALE 🔥\n"), rooms, F.lit(" apartment in "), "building", F.lit(", "), "area", F.lit("\nSize: "), sqft, F.lit(" sqft\nSelling price: AED "),
               F.format_number(sale, 0), F.lit("\nRented at 75k\nHandover Q"), n(br % 4 + 1), F.lit(" 2026\nCall +971 50 123 4567")))
        .when(q == "good", F.concat(F.lit("For rent: studio in "), quarter, F.lit("\nFully furnished, sea view, "), n(br + 3), F.lit("th floor\nRent: "), F.format_number(rent, 0), F.lit(" AED yearly\nagent John Smith 050 123 4567")))
        .when(q == "interesting", F.concat(F.lit("Villa for sale - "), "area", F.lit("\n"), n(br + 2), F.lit(" bedrooms, "), n(br + 1), F.lit(" bathrooms\nBUA: "), sqft, F.lit(" sqft, Plot: 5,000 sqft\nPrice: "),
              F.replace(F.format_number(sale / 1000000.0, 2), F.lit(","), F.lit("")), F.lit("M\nOP: 9,9M\nTenanted\nnear "), "building"))
        .when(q == "normal", F.concat(F.lit("Продажа: квартира, "), "area", F.lit("\nЦена: "), spaced, F.lit("\nвид на море, высокий этаж\nготово к заселению")))
        .otherwise(F.concat(F.lit("1. 2BR at "), "area", F.lit(" AED 1.5M\n2. 3BR at "), "building", F.lit(" price "), n(sale), F.lit(" AED\n3. 3BR at "), "building", F.lit(" price "), n(sale), F.lit(" AED unfurnished")))
    )
    return l.select("id", "area", "building", "bedrooms", "size_sqft", "deal_quality", "status", sale.alias("sale"), rent.alias("rent"), text.alias("text"))


ADVERTS = """ad0 AS (SELECT id, area, building, bedrooms, size_sqft, deal_quality, status, CAST(trunc(price * 10) AS BIGINT) AS sale, CAST(trunc(price / 4) AS BIGINT) + 20000 AS rent FROM listings),
ads AS (SELECT *, CASE deal_quality
  WHEN 'very_good' THEN '🔥 FOR SALE 🔥' || chr(10) || CASE WHEN bedrooms = 0 THEN 'Studio' ELSE bedrooms || 'BR' END || ' apartment in ' || building || ', ' || area || chr(10) || 'Size: ' || coalesce(format('{:,}', CAST(size_sqft AS BIGINT)), 'n/a')
    || ' sqft' || chr(10) || 'Selling price: AED ' || format('{:,}', sale) || chr(10) || 'Rented at 75k' || chr(10) || 'Handover Q' || (bedrooms % 4 + 1) || ' 2026' || chr(10) || 'Call +971 50 123 4567'
  WHEN 'good' THEN 'For rent: studio in ' || lower(replace(area, 'NATION', 'Quarter')) || chr(10) || 'Fully furnished, sea view, ' || (bedrooms + 3) || 'th floor' || chr(10) || 'Rent: ' || format('{:,}', rent) || ' AED yearly' || chr(10) || 'agent John Smith 050 123 4567'
  WHEN 'interesting' THEN 'Villa for sale - ' || area || chr(10) || (bedrooms + 2) || ' bedrooms, ' || (bedrooms + 1) || ' bathrooms' || chr(10) || 'BUA: ' || coalesce(format('{:,}', CAST(size_sqft AS BIGINT)), 'n/a') || ' sqft, Plot: 5,000 sqft' || chr(10) || 'Price: '
    || printf('%.2f', sale / 1000000.0::DOUBLE) || 'M' || chr(10) || 'OP: 9,9M' || chr(10) || 'Tenanted' || chr(10) || 'near ' || building
  WHEN 'normal' THEN 'Продажа: квартира, ' || area || chr(10) || 'Цена: ' || replace(format('{:,}', sale), ',', ' ') || chr(10) || 'вид на море, высокий этаж' || chr(10) || 'готово к заселению'
  ELSE '1. 2BR at ' || area || ' AED 1.5M' || chr(10) || '2. 3BR at ' || building || ' price ' || sale || ' AED' || chr(10) || '3. 3BR at ' || building || ' price ' || sale || ' AED unfurnished' END AS text FROM ad0)"""
