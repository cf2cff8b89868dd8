"""Data quality."""

from pyspark.sql import functions as F

from gavel.operators import benchmarks as bm
from gavel.operators import quality as ql
from gavel.plans.q_b_coerce import _RAW_DATES, _raw_dates
from gavel.plans.q_f_benchmarks import _MEDIANS, medians
from gavel.plans.registry import query
from gavel.plans.roles import LISTINGS, TX, listings
from gavel.sources.tables import load_table, ts


@query("contract_check", f"""WITH {LISTINGS}, {_RAW_DATES}, n AS (SELECT count(size_sqft) * 100.0::DOUBLE / count(*) AS s, count(deal_quality) * 100.0::DOUBLE / count(*) AS q FROM listings),
f AS (SELECT count(*) FILTER (WHERE NOT regexp_matches(d, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}( .*)?|\\d{{2}}[-/]\\d{{2}}[-/]\\d{{4}}|\\d{{10}})$')) / greatest(count(d), 1) AS o, count(d) * 100.0::DOUBLE / count(*) AS nn FROM raw)
SELECT 'listings' AS "table", 'size_sqft' AS "column", 'null_pct' AS kind, 'HIGH' AS criticality, CAST(round(s, 4) AS VARCHAR) AS actual FROM n WHERE s + 0.01 < 90
UNION ALL SELECT 'listings', 'deal_quality', 'null_pct', 'LOW', CAST(round(q, 4) AS VARCHAR) FROM n WHERE q + 0.01 < 10 UNION ALL SELECT 'listings', 'phone', 'missing_column', 'CRITICAL', '' UNION ALL SELECT 'listings', 'price', 'type_mismatch', 'HIGH', 'double'
UNION ALL SELECT 'registry', 'd', 'format_drift', 'CRITICAL', CAST(round(o, 4) AS VARCHAR) FROM f WHERE o >= 0.1 UNION ALL SELECT 'registry', 'd', 'null_pct', 'CRITICAL', CAST(round(nn, 4) AS VARCHAR) FROM f WHERE nn + 0.01 < 99.5""")
def q_contract(spark, d):
    rules = {
        "size_sqft": ql.ColumnRule(("double",), min_non_null_pct=90), "deal_quality": ql.ColumnRule(("string",), "LOW", 10), "phone": ql.ColumnRule(("string",), "CRITICAL"),
        "price": ql.ColumnRule(("bigint", "int")), "area": ql.ColumnRule(("string",), "CRITICAL", 99)}
    a = ql.contract_check(listings(spark, d), "listings", rules)
    return a.unionByName(ql.contract_check(_raw_dates(spark, d), "registry", {"d": ql.ColumnRule(("string",), "CRITICAL", 99.5, True)}))


@query("date_format_profile", f"""WITH {_RAW_DATES} SELECT CASE WHEN d IS NULL THEN NULL WHEN regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'ISO_DATE' WHEN regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[ T]\\d{{2}}:\\d{{2}}') THEN 'ISO_DATETIME' WHEN regexp_matches(d, '^\\d{{2}}-\\d{{2}}-\\d{{4}}$') THEN 'DD-MM-YYYY'
  WHEN regexp_matches(d, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN 'DD/MM/YYYY' WHEN regexp_matches(d, '^\\d{{10}}$') THEN 'EPOCH' ELSE 'OTHER' END AS format, count(*) AS n FROM raw GROUP BY 1""")
def q_format_profile(spark, d):
    return ql.date_format_profile(_raw_dates(spark, d), "d")


@query("expectations", """SELECT 'urgent_orders' AS "check", count(*) AS n, 100 AS expect_min, count(*) >= 100 AS ok FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'big_lines', count(*), 100000000, count(*) >= 100000000 FROM lineitem WHERE l_quantity > 40""")
def q_expectations(spark, d):
    return ql.expectations({
        "urgent_orders": (load_table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT"), 100),
        "big_lines": (load_table(spark, d, "lineitem").filter(F.col("l_quantity") > 40), 100_000_000)})


_PARSED = """pd AS (SELECT doc_id AS id, text, (n_chars % 100) / 100.0::DOUBLE AS confidence, CASE WHEN n_chars % 3 > 0 THEN lang END AS area, CASE WHEN n_chars % 5 = 0 THEN 'null' ELSE source END AS building, CASE WHEN n_chars % 2 = 0 THEN n_chars END AS price FROM documents)"""


def parsed(spark, d):
    n = F.col("n_chars")
    return load_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "text", ((n % 100) / 100.0).alias("confidence"), F.when(n % 3 > 0, F.col("lang")).alias("area"), F.when(n % 5 == 0, "null").otherwise(F.col("source")).alias("building"), F.when(n % 2 == 0, n).alias("price"))


@query("low_confidence_log", f"""WITH {_PARSED}, b AS (SELECT id, sha256(text) AS text_hash, concat_ws(',', CASE WHEN area IS NULL THEN 'area' END, CASE WHEN building = 'null' THEN 'building' END, CASE WHEN price IS NULL THEN 'price' END) AS missing_fields, confidence FROM pd WHERE text <> '')
SELECT id, text_hash, missing_fields FROM b WHERE confidence < 0.7 OR missing_fields <> '' QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY id) = 1""")
def q_low_conf(spark, d):
    return ql.low_confidence_log(parsed(spark, d), ["area", "building", "price"]).select("id", "text_hash", "missing_fields")


@query("drift_guarded_lift", f"""WITH {_PARSED}, n AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'moved' ELSE area END AS area, CASE WHEN price IS NULL THEN 0 ELSE price END AS price, confidence + 0.2::DOUBLE AS nc FROM pd),
j AS (SELECT pd.id, confidence, nc, concat_ws(',', CASE WHEN pd.area IS DISTINCT FROM n.area THEN 'area' END) AS dr FROM pd JOIN n ON pd.id = n.id)
SELECT id, round(confidence, 4) AS confidence, round(nc, 4) AS new_confidence, dr AS drifted_fields, CASE WHEN dr <> '' THEN 'drifted' WHEN nc >= 0.85::DOUBLE THEN 'accepted' ELSE 'no_lift' END AS verdict FROM j""")
def q_drift(spark, d):
    p = parsed(spark, d)
    new = p.select("id", F.when(F.col("id") % 7 == 0, "moved").otherwise(F.col("area")).alias("area"), F.coalesce("price", F.lit(0)).alias("price"), (F.col("confidence") + 0.2).alias("confidence"))
    out = ql.drift_guarded_lift(p, new, ["area", "price"], 0.85)
    return out.withColumns({c: F.round(c, 4) for c in ("confidence", "new_confidence")})


_STAGE = """st AS (SELECT id, CASE WHEN deal_quality IS NOT NULL THEN building END AS building, area, CASE WHEN bedrooms <> 4 THEN price * 10 ELSE 0 END AS price, deal_type, bedrooms, size_sqft, is_hot_deal AS needs_review, status = 'P' AS is_audit, created_at FROM listings)"""


def staged(spark, d):
    l = listings(spark, d)
    return l.select(
        "id", F.when(F.col("deal_quality").isNotNull(), F.col("building")).alias("building"), "area", F.when(F.col("bedrooms") != 4, F.col("price") * 10).otherwise(0.0).alias("price"), "deal_type", "bedrooms", "size_sqft",
        F.col("is_hot_deal").alias("needs_review"), (F.col("status") == "P").alias("is_audit"), "created_at")


@query("completeness_gate", f"""WITH {LISTINGS}, {_STAGE} SELECT id, CASE WHEN building IS NOT NULL AND price > 0 AND NOT needs_review AND NOT is_audit THEN 'listings' ELSE 'staging' END AS target FROM st""")
def q_completeness(spark, d):
    full, rest = ql.completeness_gate(staged(spark, d))
    return full.select("id", F.lit("listings").alias("target")).unionByName(rest.select("id", F.lit("staging").alias("target")))


@query("promotable", f"""WITH {LISTINGS}, {_STAGE} SELECT id FROM st WHERE NOT (building IS NOT NULL AND price > 0 AND NOT needs_review AND NOT is_audit) AND building IS NOT NULL AND price > 0
  AND NOT (deal_type = 'rent' AND price < 15000) AND NOT (deal_type = 'sale' AND price < 350000) AND NOT (bedrooms > 0 AND deal_type = 'rent' AND price < 0.5 * CASE bedrooms WHEN 1 THEN 40000 WHEN 2 THEN 60000 WHEN 3 THEN 90000 WHEN 4 THEN 120000 ELSE 30000 END)
  AND NOT (bedrooms > 0 AND deal_type = 'sale' AND price < 0.55 * CASE bedrooms WHEN 1 THEN 500000 WHEN 2 THEN 900000 WHEN 3 THEN 1500000 WHEN 4 THEN 2500000 ELSE 350000 END)
  AND NOT coalesce(size_sqft > 200 AND deal_type = 'rent' AND price / size_sqft < 8, FALSE) AND NOT coalesce(size_sqft > 200 AND deal_type = 'sale' AND price / size_sqft < 150, FALSE) AND NOT coalesce(size_sqft > 0 AND bedrooms > 0 AND size_sqft < bedrooms * 200, FALSE)""")
def q_promotable(spark, d):
    _, rest = ql.completeness_gate(staged(spark, d))
    rows = rest.withColumn("property_type", F.lit("apartment"))
    return ql.promotable(rows, bm.listing_rules(rows)).select("id")


@query("retry_queue", f"""WITH {LISTINGS}, {_STAGE} SELECT id, bedrooms AS attempts FROM st WHERE bedrooms < 3 AND (deal_type = 'rent' OR created_at < TIMESTAMP '2001-01-01' - INTERVAL 30 MINUTES) ORDER BY bedrooms, created_at, id LIMIT 60""")
def q_retry(spark, d):
    rows = staged(spark, d).withColumn("attempts", F.col("bedrooms")).withColumn("last_try", F.when(F.col("deal_type") != "rent", F.col("created_at")))
    return ql.retry_queue(rows, ts("2001-01-01 00:00:00"), 60).select("id", "attempts")


@query("log_signature_dedup", """WITH l AS (SELECT sha256('bot_' || user_id % 5 || '.py:' || CAST(json_extract_string(props, '$.k') AS INT) % 4 || ':' || event_type) AS signature, ts FROM events)
SELECT signature, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM l GROUP BY 1""")
def q_signatures(spark, d):
    log = load_table(spark, d, "events").select(
        F.concat(F.lit("bot_"), F.pmod("user_id", F.lit(5)).cast("string"), F.lit(".py")).alias("file_path"), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(4)).alias("line_no"), F.col("event_type").alias("exc_class"), "ts")
    return ql.log_signature_dedup(log).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


_AUDIT = """al AS (SELECT order_id AS id, line_no, CASE WHEN line_no = 1 THEN NULL WHEN line_no = 2 THEN upper(building) ELSE 'the ' || building END AS building, CASE WHEN line_no > 1 THEN area END AS area,
  CASE WHEN line_no = 1 AND bedrooms = 5 THEN NULL WHEN line_no = 3 AND bedrooms = 0 THEN price * 30000 WHEN bedrooms = 1 THEN price / 2 WHEN deal_type = 'rent' THEN price * (bedrooms + 1) / 3 ELSE price * 20 END AS price, CASE WHEN property_type = 'large' THEN 'villa' WHEN property_type = 'small' THEN 'plot' ELSE 'apartment' END AS property_type,
  deal_type, CASE WHEN line_no > 1 THEN size_sqft END AS size_sqft FROM tx WHERE deal_date >= DATE '2001-06-01')"""


_AUDIT_FLAGS = f"""WITH {TX}, {_MEDIANS}, {_AUDIT}, nm AS (SELECT *, CASE WHEN line_no = 2 THEN lower(building) ELSE substr(building, 5) END AS name FROM al),
j AS (SELECT nm.*, CASE WHEN sale_count >= 5 THEN nullif(sale_median, 0) END AS sm, nullif(rent_median, 0) AS rm FROM nm LEFT JOIN med ON med.building = nm.name)
SELECT id, line_no, CAST(trunc(price) AS BIGINT) AS price, nullif(concat_ws('; ', CASE WHEN building IS NULL AND price IS NULL AND area IS NULL THEN 'no_building_price_area' END,
  CASE WHEN deal_type = 'sale' AND property_type IN ('apartment', 'villa') AND building IS NULL AND area IS NULL AND size_sqft IS NULL THEN 'residential_no_basic_info' END,
  CASE WHEN price > 500000000 AND property_type <> 'plot' THEN 'price_too_high_' || CAST(trunc(price) AS BIGINT) END, CASE WHEN deal_type = 'sale' AND price > 0 AND price < 50000 AND property_type <> 'plot' THEN 'sale_price_too_low_' || CAST(trunc(price) AS BIGINT) END,
  CASE WHEN deal_type = 'rent' AND price > 5000000 THEN 'rent_too_high_' || CAST(trunc(price) AS BIGINT) END,
  CASE WHEN deal_type = 'sale' AND price > 100000 AND abs(price - sm) / sm * 100 > 50 THEN 'bench_diff_' || CAST(trunc(abs(price - sm) / sm * 100) AS BIGINT) || '%_' || CASE WHEN price > sm THEN 'above' ELSE 'below' END || '_median_' || CAST(trunc(sm) AS BIGINT) END,
  CASE WHEN deal_type = 'rent' AND price > 5000 AND abs(price - rm) / rm * 100 > 50 THEN 'bench_rent_diff_' || CAST(trunc(abs(price - rm) / rm * 100) AS BIGINT) || '%_' || CASE WHEN price > rm THEN 'above' ELSE 'below' END || '_median_' || CAST(trunc(rm) AS BIGINT) END), '') AS audit_reason FROM j"""


@query("audit_flags", _AUDIT_FLAGS)
def q_audit_flags(spark, d):
    return _audit(spark, d).select("id", "line_no", F.col("price").cast("bigint").alias("price"), "audit_reason")


def _audit(spark, d):
    from gavel.plans.roles import transactions

    t = transactions(spark, d).filter(F.col("deal_date") >= F.lit("2001-06-01").cast("date"))
    ln, br, p = F.col("line_no"), F.col("bedrooms"), F.col("price")
    rows = t.select(
        F.col("order_id").alias("id"), "line_no", F.when(ln == 2, F.upper("building")).when(ln > 2, F.concat(F.lit("the "), "building")).alias("building"), F.when(ln > 1, F.col("area")).alias("area"),
        F.when((ln == 1) & (br == 5), F.lit(None).cast("double")).when((ln == 3) & (br == 0), p * 30000).when(br == 1, p / 2).when(F.col("deal_type") == "rent", p * (br + 1) / 3).otherwise(p * 20).alias("price"),
        F.when(F.col("property_type") == "large", "villa").when(F.col("property_type") == "small", "plot").otherwise("apartment").alias("property_type"), "deal_type", F.when(ln > 1, F.col("size_sqft")).alias("size_sqft"))
    return ql.audit_flags(rows, medians(spark, d).withColumnRenamed("building", "name"))


@query("audit_reason_counts", f"""SELECT split_part(r, '_', 1) || '_' || split_part(r, '_', 2) AS reason, count(*) AS n FROM (SELECT unnest(string_split(audit_reason, '; ')) AS r FROM ({_AUDIT_FLAGS}) WHERE audit_reason IS NOT NULL) GROUP BY 1""")
def q_audit_counts(spark, d):
    return ql.audit_reason_counts(_audit(spark, d))


@query("repair_sweeps", f"""WITH {LISTINGS}, r AS (SELECT id, bedrooms, CASE status WHEN 'F' THEN 'apartment' WHEN 'O' THEN 'villa' ELSE 'plot' END AS pt, building AS b, area FROM listings)
SELECT id, CASE WHEN pt = 'apartment' AND bedrooms = 1 THEN 'office' WHEN pt = 'apartment' AND bedrooms = 2 THEN 'retail' ELSE pt END AS property_type,
  CASE WHEN pt = 'plot' OR (pt = 'apartment' AND bedrooms IN (1, 2)) THEN NULL WHEN bedrooms = 5 THEN 2 WHEN bedrooms = 3 THEN 3 ELSE bedrooms END AS bedrooms,
  CASE bedrooms WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN b WHEN 3 THEN NULL WHEN 4 THEN b ELSE b END AS building, CASE WHEN bedrooms <> 3 AND lower(b) LIKE '%tower 7%' THEN 'Seven Hills' ELSE area END AS area FROM r""")
def q_repair(spark, d):
    l = listings(spark, d)
    br, b = F.col("bedrooms"), F.col("building")
    pt = F.when(F.col("status") == "F", "apartment").when(F.col("status") == "O", "villa").otherwise("plot")
    dirty = (
        F.when(br == 0, F.concat(F.lit("Studio | "), b)).when(br == 1, F.concat(F.lit("** "), b, F.lit(" - "), "area")).when(br == 2, F.concat(b, F.lit(" Plot")))
        .when(br == 3, "3 bedroom").when(br == 4, F.concat(F.lit("Urgent "), b, F.lit(" (Old Town)"))).otherwise(F.concat(b, F.lit("\nsecond line"))))
    text = F.when(br == 1, "Office: 1,200 sqft").when(br == 2, "Prime retail corner").when(br == 3, "Lovely 3-bed home").when(br == 5, "2,5 bedroom flat").otherwise("Home")
    rows = l.select("id", pt.alias("property_type"), F.when(br != 3, br).alias("bedrooms"), dirty.alias("building"), "area", text.alias("text"))
    return ql.repair_sweeps(rows, {"Seven Hills": ["tower 7"]}).drop("text")
