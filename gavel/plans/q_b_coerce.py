"""Coercion and normalisation over text columns derived from the given tables."""

from pyspark.sql import functions as F

from gavel.functions import coerce as co
from gavel.operators.filters import listing_filter, saved_search_matches
from gavel.plans.registry import query
from gavel.plans.roles import LISTINGS, TX, listings, transactions
from gavel.sources.tables import load_table

# Registry text dates: the format changes with the ship mode flags, as between source systems.
_RAW_DATES = """raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag || l_linestatus WHEN 'AO' THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') WHEN 'AF' THEN strftime(l_shipdate, '%d-%m-%Y')
    WHEN 'NO' THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 'NF' THEN CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR)
    WHEN 'RO' THEN ' ' WHEN 'RF' THEN strftime(l_shipdate, '%b %Y') END AS d FROM lineitem)"""


def _raw_dates(spark, d):
    k = F.concat("l_returnflag", "l_linestatus")
    s = F.col("l_shipdate")
    epoch_day = F.datediff(F.to_date(s), F.lit("1970-01-01").cast("date")).cast("bigint")
    text = (
        F.when(k == "AO", F.date_format(s, "yyyy-MM-dd HH:mm:ss"))
        .when(k == "AF", F.date_format(s, "dd-MM-yyyy"))
        .when(k == "NO", F.date_format(s, "dd/MM/yyyy"))
        .when(k == "NF", (epoch_day * 86400).cast("string"))
        .when(k == "RO", F.lit(" "))
        .when(k == "RF", F.date_format(s, "MMM yyyy"))
    )
    return load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("d"))


@query("safe_date", f"""WITH {_RAW_DATES}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(CASE
  WHEN regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(substr(d, 1, 10) AS DATE)
  WHEN regexp_matches(d, '^\\d{{2}}-\\d{{2}}-\\d{{4}}$') THEN CAST(strptime(d, '%d-%m-%Y') AS DATE)
  WHEN regexp_matches(d, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN CAST(strptime(d, '%d/%m/%Y') AS DATE)
  WHEN regexp_matches(d, '^\\d{{10}}$') THEN CAST(epoch_ms(CAST(d AS BIGINT) * 1000) AS DATE) END, '%Y-%m-%d') AS safe_date FROM raw""")
def q_safe_date(spark, d):
    return _raw_dates(spark, d).withColumn("safe_date", F.date_format(co.safe_date("d"), "yyyy-MM-dd")).drop("d")


@query("safe_num", """SELECT c_custkey, TRY_CAST(NULLIF(regexp_replace('AED ' || CAST(c_acctbal AS VARCHAR) ||
  CASE c_mktsegment WHEN 'BUILDING' THEN ' net' ELSE '' END, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS safe_num,
  TRY_CAST(NULLIF(regexp_replace(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_mktsegment ELSE '+' || c_custkey || '.5.1' END, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS junk FROM customer""")
def q_safe_num(spark, d):
    bal = F.format_string("AED %s%s", F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.when(F.col("c_mktsegment") == "BUILDING", " net").otherwise(""))
    junk = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_mktsegment")).otherwise(F.concat(F.lit("+"), F.col("c_custkey").cast("string"), F.lit(".5.1")))
    return load_table(spark, d, "customer").select("c_custkey", co.safe_num(bal).alias("safe_num"), co.safe_num(junk).alias("junk"))


@query("safe_int", """SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS safe_int FROM customer""")
def q_safe_int(spark, d):
    text = F.concat(F.lit("AED "), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    return load_table(spark, d, "customer").select("c_custkey", co.safe_int(text).alias("safe_int"))


@query("safe_bool", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN TRUE WHEN '2-HIGH' THEN TRUE WHEN '3-MEDIUM' THEN FALSE
  WHEN '4-NOT SPECIFIED' THEN FALSE END AS safe_bool FROM orders""")
def q_safe_bool(spark, d):
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").when(F.col("o_orderpriority") == "2-HIGH", "1")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "N").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "FALSE").otherwise("maybe")
    )
    return load_table(spark, d, "orders").select("o_orderkey", co.safe_bool(text).alias("safe_bool"))


@query("safe_text", """SELECT page_id, coalesce(nullif(trim(CASE WHEN url LIKE 'https%' THEN '  ' ELSE ' ' || url || ' ' END), ''), 'n/a') AS safe_text FROM pages""")
def q_safe_text(spark, d):
    text = F.when(F.col("url").startswith("https"), "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    return load_table(spark, d, "pages").select("page_id", co.safe_text(text, "n/a").alias("safe_text"))


_TYPES = """t AS (SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Unit' WHEN 'LARGE' THEN 'Villa' WHEN 'PROMO' THEN 'Land' WHEN 'MEDIUM' THEN 'Building' ELSE 'Unit ' END AS pt,
  CASE WHEN p_size < 10 THEN 'Flat' WHEN p_size < 20 THEN 'Hotel Apartment' WHEN p_size < 25 THEN 'Stacked Townhouses' WHEN p_size < 30 THEN 'Residential Flats'
       WHEN p_size < 35 THEN 'Office' WHEN p_size < 40 THEN 'Penthouse' WHEN p_size < 45 THEN 'Studio flat' END AS st FROM part)"""


def _types(spark, d):
    size = F.col("p_size")
    pt = F.when(F.col("p_type") == "STANDARD", "Unit").when(F.col("p_type") == "LARGE", "Villa").when(F.col("p_type") == "PROMO", "Land").when(F.col("p_type") == "MEDIUM", "Building").otherwise("Unit ")
    st = (
        F.when(size < 10, "Flat").when(size < 20, "Hotel Apartment").when(size < 25, "Stacked Townhouses").when(size < 30, "Residential Flats")
        .when(size < 35, "Office").when(size < 40, "Penthouse").when(size < 45, "Studio flat")
    )
    return load_table(spark, d, "part").select("p_partkey", pt.alias("pt"), st.alias("st"))


@query("norm_property_type", f"""WITH {_TYPES}, l AS (SELECT p_partkey, trim(lower(pt)) AS pt, lower(coalesce(st, '')) AS st FROM t)
SELECT p_partkey, CASE WHEN pt LIKE '%villa%' OR st LIKE '%villa%' THEN 'villa' WHEN st LIKE '%townhouse%' OR st LIKE '%town house%' THEN 'townhouse'
  WHEN st LIKE '%penthouse%' THEN 'penthouse' WHEN st = 'flat' OR (pt = 'unit' AND st LIKE '%flat%') THEN 'apartment'
  WHEN st LIKE '%hotel apartment%' THEN 'apartment' END AS market_type,
  CASE WHEN pt LIKE '%villa%' OR st LIKE '%villa%' THEN 'villa' WHEN list_contains(string_split(st, ' '), 'flat') OR st LIKE '%hotel apartment%' THEN 'apartment'
  WHEN pt = 'land' THEN 'plot' WHEN pt = 'building' THEN 'commercial' WHEN st IN ('office', 'shop', 'commercial', 'warehouse', 'industrial') THEN 'commercial' END AS profile_type FROM l""")
def q_norm_property_type(spark, d):
    return _types(spark, d).select("p_partkey", co.norm_property_type("pt", "st").alias("market_type"), co.norm_profile_type("pt", "st").alias("profile_type"))


_ROOMS = """r AS (SELECT p_partkey, p_size // 4 AS n, CASE WHEN p_type = 'SMALL' THEN 'Studio' WHEN p_type = 'PROMO' THEN NULL
  WHEN p_type = 'LARGE' THEN 'about ' || CAST(p_size // 3 AS VARCHAR) || ' rooms' WHEN p_type = 'MEDIUM' THEN 'PENTHOUSE'
  ELSE CAST(p_size // 4 AS VARCHAR) || ' B/R' END AS rooms, CASE WHEN p_size > 25 THEN 'Studio unit' ELSE 'Flat' END AS st FROM part)"""


def _rooms(spark, d):
    n = F.floor(F.col("p_size") / 4).cast("int")
    rooms = (
        F.when(F.col("p_type") == "SMALL", "Studio").when(F.col("p_type") == "PROMO", F.lit(None).cast("string"))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("about "), F.floor(F.col("p_size") / 3).cast("string"), F.lit(" rooms")))
        .when(F.col("p_type") == "MEDIUM", "PENTHOUSE").otherwise(F.concat(n.cast("string"), F.lit(" B/R")))
    )
    return load_table(spark, d, "part").select("p_partkey", n.alias("n"), rooms.alias("rooms"), F.when(F.col("p_size") > 25, "Studio unit").otherwise("Flat").alias("st"))


@query("norm_bedrooms", f"""WITH {_ROOMS}
SELECT p_partkey, CASE WHEN rooms IS NULL THEN CASE WHEN st LIKE 'Studio%' THEN 0 END WHEN rooms = 'Studio' THEN 0
  WHEN rooms LIKE '% B/R' THEN CAST(split_part(rooms, ' ', 1) AS INT)
  WHEN rooms LIKE 'about%' AND CAST(split_part(rooms, ' ', 2) AS INT) <= 12 THEN CAST(split_part(rooms, ' ', 2) AS INT) END AS bedrooms FROM r""")
def q_norm_bedrooms(spark, d):
    return _rooms(spark, d).select("p_partkey", co.norm_bedrooms("rooms", "st").alias("bedrooms"))


@query("rooms_bucket", f"""WITH {_ROOMS}
SELECT p_partkey, CASE WHEN n <= 0 THEN 'studio' WHEN n >= 5 THEN '5br+' ELSE n || 'br' END AS score_bucket,
  CASE WHEN rooms IS NULL THEN 'all' WHEN rooms = 'Studio' THEN 'studio'
    WHEN rooms LIKE '% B/R' AND left(rooms, 1) IN ('1', '2', '3', '4') THEN left(rooms, 1) || 'br'
    WHEN rooms LIKE '% B/R' AND left(rooms, 1) IN ('5', '6', '7') THEN '4br+'
    ELSE 'all' END AS stats_bucket, CASE WHEN n = 0 THEN 'Studio' WHEN n BETWEEN 1 AND 10 THEN n || ' B/R' END AS label FROM r""")
def q_rooms_bucket(spark, d):
    return _rooms(spark, d).select(
        "p_partkey", co.rooms_bucket("n").alias("score_bucket"), co.rooms_bucket_from_text("rooms").alias("stats_bucket"), co.rooms_label("n").alias("label"))


@query("norm_area_name", """
WITH raw AS (SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN ' ' WHEN c_acctbal > 4000 THEN ' ' || r_name || '  ' ELSE lower(r_name) || ' ' || lower(c_mktsegment) END AS a
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT c_custkey, nullif(array_to_string(list_transform(string_split(trim(a), ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' '), '') AS a FROM raw)
SELECT c_custkey, CASE a WHEN 'Africa' THEN 'Afr' WHEN 'Asia' THEN 'Asi' WHEN 'Europe' THEN 'Eur' ELSE a END AS area_norm FROM t""")
def q_norm_area_name(spark, d):
    c, n, r = (load_table(spark, d, t) for t in ("customer", "nation", "region"))
    raw = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 9000, " ").when(F.col("c_acctbal") > 4000, F.concat(F.lit(" "), "r_name", F.lit("  ")))
        .otherwise(F.concat(F.lower("r_name"), F.lit(" "), F.lower("c_mktsegment"))).alias("a"))
    aliases = r.filter(F.col("r_name").isin("AFRICA", "ASIA", "EUROPE")).select(
        F.initcap("r_name").alias("alias"), F.initcap(F.substring("r_name", 1, 3)).alias("canonical"))
    return co.norm_area_name(raw, "a", aliases).select("c_custkey", "area_norm")


@query("norm_text_key", """
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^0-9a-z_ \\-Ѐ-ӿ؀-ۿ()]', ' ', 'g'), '\\s+', ' ', 'g'))) AS key_md5 FROM documents""")
def q_norm_text_key(spark, d):
    return load_table(spark, d, "documents").select("doc_id", F.md5(co.norm_text_key("text")).alias("key_md5"))


@query("norm_phone", """
SELECT c_custkey, right(regexp_replace('+971 ' || right(c_name, 9), '[^0-9]', '', 'g'), 9) AS phone,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 8 THEN CAST(c_custkey AS VARCHAR) END AS short FROM customer""")
def q_norm_phone(spark, d):
    return load_table(spark, d, "customer").select(
        "c_custkey", co.norm_phone(F.concat(F.lit("+971 "), F.right("c_name", F.lit(9)))).alias("phone"), co.norm_phone(F.col("c_custkey").cast("string")).alias("short"))


_FILTERS = {"deal_type": "sale", "area": "NATION_1", "property_type_not_in": ["machinery"], "bedrooms": 99, "min_price": 50000,
            "max_price": 450000, "is_off_plan": False, "confidence_min": 0.1}


@query("listing_filter", f"""WITH {LISTINGS}
SELECT id, area, price FROM listings WHERE deal_type = 'sale' AND (lower(area) LIKE '%nation\\_1%' ESCAPE '\\' OR lower(area) LIKE '%nation\\_7%' ESCAPE '\\')
  AND (property_type IS NULL OR property_type NOT IN ('machinery')) AND bedrooms >= 4 AND price BETWEEN 50000 AND 450000
  AND (is_off_plan IS NULL OR NOT is_off_plan) AND confidence_score >= 0.1""")
def q_listing_filter(spark, d):
    return listing_filter(listings(spark, d), _FILTERS, ["Nation_1", "Nation_7"]).select("id", "area", "price")


@query("saved_search_predicate", f"""WITH {LISTINGS}
SELECT id, area, price FROM listings WHERE id > 200 AND deal_type = 'sale' AND lower(property_type) = 'building' AND bedrooms >= 1 AND bedrooms <= 3
  AND price >= 20000 AND price <= 480000""")
def q_saved_search(spark, d):
    f = {"deal_type": "sale", "property_type": "BUILDING", "br_min": 1, "br_max": 3, "price_min": 20000, "max_price": 480000}
    return saved_search_matches(listings(spark, d), f, 200).select("id", "area", "price")


@query("parse_utm", """
WITH p AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'from_OffPlan_x_utm_tg_may' || event_id || '_a_b' WHEN 'click' THEN 'proj-' || user_id || '_utm_fb'
  WHEN 'signup' THEN 'bld_' || user_id WHEN 'purchase' THEN 'from_' || user_id ELSE '' END AS p FROM events)
SELECT event_id,
  CASE WHEN p LIKE 'from\\_OffPlan%' ESCAPE '\\' THEN 'channel' WHEN p LIKE 'proj%' THEN 'channel' WHEN p LIKE 'bld%' THEN 'analytics'
       WHEN p LIKE 'from%' THEN substr(p, 6) ELSE 'unknown' END AS from_bot,
  CASE WHEN p LIKE 'from\\_Off%' ESCAPE '\\' THEN 'tg' WHEN p LIKE 'proj%' THEN 'fb' END AS utm_source,
  CASE WHEN p LIKE 'from\\_Off%' ESCAPE '\\' THEN 'may' || event_id END AS utm_campaign,
  CASE WHEN p LIKE 'from\\_Off%' ESCAPE '\\' THEN 'a_b' END AS utm_content FROM p""")
def q_parse_utm(spark, d):
    e = load_table(spark, d, "events")
    p = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("from_OffPlan_x_utm_tg_may"), F.col("event_id").cast("string"), F.lit("_a_b")))
        .when(F.col("event_type") == "click", F.concat(F.lit("proj-"), F.col("user_id").cast("string"), F.lit("_utm_fb")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("bld_"), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("from_"), F.col("user_id").cast("string"))).otherwise("")
    )
    return e.select("event_id", co.parse_utm(p).alias("u")).select("event_id", "u.*")


@query("to_aed", """
SELECT o_orderkey, CAST(trunc(CAST(round(o_totalprice) AS BIGINT) * CASE o_orderpriority WHEN '1-URGENT' THEN 3.67::DOUBLE WHEN '2-HIGH' THEN 4.00::DOUBLE
  WHEN '3-MEDIUM' THEN 0.040::DOUBLE WHEN '5-LOW' THEN 1.0::DOUBLE END) AS BIGINT) AS aed FROM orders""")
def q_to_aed(spark, d):
    cur = F.when(F.col("o_orderpriority") == "1-URGENT", "usd").when(F.col("o_orderpriority") == "2-HIGH", "EUR").when(F.col("o_orderpriority") == "3-MEDIUM", "RUB").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "XYZ")
    return load_table(spark, d, "orders").select("o_orderkey", co.to_aed(F.round("o_totalprice").cast("bigint"), cur).alias("aed"))


@query("area_unit_convert", """
WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity * 40 END AS f, CASE WHEN l_returnflag <> 'A' THEN l_quantity * 3 END AS m FROM lineitem),
v AS (SELECT *, coalesce(f, round(m * 10.7639::DOUBLE, 1)) AS sf, coalesce(m, round(f / 10.7639::DOUBLE, 1)) AS sm FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN sf BETWEEN 100 AND 50000 THEN sf END AS sqft, CASE WHEN sf BETWEEN 100 AND 50000 THEN sm END AS sqm FROM v""")
def q_area_units(spark, d):
    f = F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 40)
    m = F.when(F.col("l_returnflag") != "A", F.col("l_quantity") * 3)
    sqft, sqm = co.area_units(f, m)
    return load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sqft.alias("sqft"), sqm.alias("sqm"))
