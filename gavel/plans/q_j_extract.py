"""Structured fields from texts. Adverts are listings written out in five styles, so the oracle
knows from the source columns what each extractor must find."""

from pyspark.sql import functions as F

from gavel.operators import extract as ex
from gavel.operators import messages as ms
from gavel.operators.names import find_names, name_key
from gavel.plans.registry import query
from gavel.plans.roles import ADVERTS, LISTINGS, TX, adverts, listings, transactions
from gavel.sources.tables import load_table

AD = f"WITH {LISTINGS}, {ADVERTS}"


@query("advert_texts", f"{AD} SELECT id, md5(text) AS h FROM ads")
def q_texts(spark, d):
    return adverts(spark, d).select("id", F.md5("text").alias("h"))


@query("clean_text", f"""{AD} SELECT id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]+', ' ', 'g'), '[=_\\-*•·|]{{3,}}', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM ads""")
def q_clean(spark, d):
    return adverts(spark, d).select("id", F.md5(ex.clean_text("text")).alias("h"))


@query("split_blocks", f"""{AD} SELECT id, 0 AS block_index, CASE WHEN deal_quality IN ('good', 'very_good') THEN strpos(text, chr(10) || 'Rent') - 1 ELSE length(text) END AS n FROM ads WHERE deal_quality IS NOT NULL
UNION ALL SELECT id, 1, length(text) - strpos(text, chr(10) || 'Rent') FROM ads WHERE deal_quality IN ('good', 'very_good') UNION ALL SELECT id, 0, length(split_part(text, chr(10), 1)) FROM ads WHERE deal_quality IS NULL
UNION ALL SELECT id, 1, length(split_part(text, chr(10), 3)) FROM ads WHERE deal_quality IS NULL""")
def q_split(spark, d):
    return ex.split_blocks(adverts(spark, d).select("id", "text"), "text").select("id", "block_index", F.length("block").cast("bigint").alias("n"))


@query("is_spam", f"""{AD} SELECT id, bedrooms >= 3 AS is_spam FROM ads""")
def q_spam(spark, d):
    br = F.col("bedrooms")
    tail = F.when(br == 3, " cash buyer ready now").when(br == 4, " Budget: 2M only").when(br == 5, ". Also 2018 BMW 640i M Sport, automatic").otherwise("")
    return adverts(spark, d).select("id", ex.is_spam(F.concat("text", tail)).alias("is_spam"))


@query("deal_type", f"""{AD} SELECT id, CASE deal_quality WHEN 'good' THEN 'rent' WHEN 'very_good' THEN 'sale' WHEN 'interesting' THEN 'sale' WHEN 'normal' THEN 'sale' ELSE CASE WHEN sale >= 15000 AND sale < 500000 THEN 'rent' ELSE 'sale' END END AS deal_type,
  CASE WHEN deal_quality = 'good' THEN 0.9 WHEN deal_quality IS NULL THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence FROM ads""")
def q_deal_type(spark, d):
    t = ex.deal_type("text", F.col("sale"))
    return adverts(spark, d).select("id", t["deal_type"].alias("deal_type"), t["confidence"].alias("confidence"))


@query("rent_period", f"""{AD} SELECT id, CASE WHEN deal_quality = 'good' THEN 'yearly' WHEN sale < 30000 THEN 'monthly' WHEN sale > 500000 THEN 'yearly' ELSE 'unknown' END AS period FROM ads""")
def q_period(spark, d):
    return adverts(spark, d).select("id", ex.rent_period("text", F.col("sale")).alias("period"))


@query("price_amount", f"""{AD}, p AS (SELECT id, deal_quality, CASE deal_quality WHEN 'very_good' THEN sale WHEN 'good' THEN rent WHEN 'interesting' THEN CAST(trunc(CAST(printf('%.2f', sale / 1000000.0::DOUBLE) AS DOUBLE) * 1000000) AS BIGINT) ELSE sale END AS p FROM ads)
SELECT id, CASE WHEN deal_quality IN ('very_good', 'interesting') AND p < 100000 THEN NULL ELSE p END AS price, CASE WHEN deal_quality = 'interesting' THEN 9900000 END AS original_price FROM p""")
def q_price(spark, d):
    return ex.price_amounts(adverts(spark, d), "text").select("id", "price", "original_price")


@query("size", f"""{AD} SELECT id, CASE WHEN deal_quality = 'very_good' AND size_sqft >= 200 THEN size_sqft WHEN deal_quality = 'interesting' THEN CASE WHEN size_sqft IS NULL THEN 5000 WHEN size_sqft >= 200 THEN size_sqft END END AS size_sqft,
  CASE WHEN deal_quality = 'interesting' AND size_sqft >= 200 THEN size_sqft END AS bua_sqft, CASE WHEN deal_quality = 'interesting' THEN 5000.0 END::DOUBLE AS plot_sqft FROM ads""")
def q_size(spark, d):
    return adverts(spark, d).select("id", ex.sizes("text").alias("s")).select("id", "s.*")


@query("bedrooms_bathrooms", f"""{AD} SELECT id, CASE deal_quality WHEN 'very_good' THEN bedrooms WHEN 'good' THEN 0 WHEN 'interesting' THEN bedrooms + 2 WHEN 'normal' THEN NULL ELSE 2 END AS bedrooms, CASE WHEN deal_quality = 'interesting' THEN bedrooms + 1 END AS bathrooms FROM ads""")
def q_bedrooms(spark, d):
    return adverts(spark, d).select("id", ex.bedrooms("text").alias("bedrooms"), ex.bathrooms("text").alias("bathrooms"))


@query("furnishing_view_floor_handover", f"""{AD} SELECT id, CASE WHEN deal_quality = 'good' THEN 'furnished' WHEN deal_quality IS NULL THEN 'unfurnished' END AS furnishing, CASE WHEN deal_quality IN ('good', 'normal') THEN 'sea' END AS view,
  CASE WHEN deal_quality = 'good' THEN bedrooms + 3 END AS floor, CASE deal_quality WHEN 'good' THEN CASE WHEN bedrooms + 3 >= 5 THEN 'mid' ELSE 'low' END WHEN 'normal' THEN 'high' END AS category,
  CASE WHEN deal_quality = 'very_good' THEN 2026 END AS year, CASE WHEN deal_quality = 'very_good' THEN bedrooms % 4 + 1 END AS quarter, CASE deal_quality WHEN 'very_good' THEN 'Q' || (bedrooms % 4 + 1) || ' 2026' WHEN 'normal' THEN 'ready' END AS label FROM ads""")
def q_extras(spark, d):
    a = adverts(spark, d)
    return a.select("id", ex.furnishing("text").alias("furnishing"), ex.view("text").alias("view"), ex.floor("text").alias("f"), ex.handover("text").alias("h")).select("id", "furnishing", "view", "f.*", "h.*")


@query("off_plan", f"""{AD} SELECT id, CASE WHEN deal_quality IN ('very_good', 'interesting') THEN TRUE WHEN deal_quality = 'normal' THEN FALSE END AS off_plan FROM ads""")
def q_off_plan(spark, d):
    return adverts(spark, d).select("id", ex.off_plan("text").alias("off_plan"))


@query("contacts", f"""{AD} SELECT id, CASE WHEN deal_quality IN ('very_good', 'good') THEN '+971501234567' END AS phone, CASE WHEN deal_quality = 'good' THEN 'John Smith' END AS agent_name FROM ads""")
def q_contacts(spark, d):
    return adverts(spark, d).select("id", ex.contacts("text").alias("c")).select("id", "c.*")


@query("property_type", f"""{AD} SELECT id, CASE deal_quality WHEN 'very_good' THEN CASE WHEN bedrooms = 0 THEN 'studio' ELSE 'apartment' END WHEN 'good' THEN 'studio' WHEN 'interesting' THEN 'villa' ELSE 'apartment' END AS property_type FROM ads""")
def q_property_type(spark, d):
    return adverts(spark, d).select("id", ex.property_type("text").alias("property_type"))


@query("area_match", f"""{AD} SELECT id, ads.area, CASE WHEN n_nationkey % 7 <> 0 THEN r_name END AS emirate, CASE WHEN n_nationkey % 7 = 0 THEN 0.6 WHEN deal_quality = 'good' THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence FROM ads JOIN nation ON n_name = ads.area JOIN region ON n_regionkey = r_regionkey""")
def q_area_match(spark, d):
    n, r = load_table(spark, d, "nation"), load_table(spark, d, "region")
    spell = F.explode(F.array("n_name", F.lower(F.replace("n_name", F.lit("NATION"), F.lit("Quarter")))))
    areas = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("area"), F.col("r_name").alias("emirate"), spell.alias("alias"), (F.col("n_nationkey") % 7 == 0).alias("ambiguous"))
    regions = r.select(F.col("r_name").alias("area"), F.col("r_name").alias("alias"))
    return ex.area_match(adverts(spark, d).select("id", "text"), "id", "text", areas, regions)


@query("building_match", f"""{AD} SELECT id, CASE deal_quality WHEN 'good' THEN lower(replace(area, 'NATION', 'Quarter')) ELSE building END AS building, CASE WHEN deal_quality = 'good' THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence
FROM ads WHERE deal_quality IS NULL OR deal_quality IN ('very_good', 'good')""")
def q_building_match(spark, d):
    l = listings(spark, d)
    names = l.select("building").distinct().select("building", F.lit(None).cast("string").alias("area"), F.lit(None).cast("string").alias("emirate"), F.col("building").alias("alias"))
    out = ex.building_match(adverts(spark, d).select("id", "text"), "id", "text", names)
    return out.select("id", "building", "confidence")


@query("resolve_location", f"""WITH {LISTINGS}, l AS (SELECT id, CASE WHEN bedrooms < 2 THEN area END AS ba, CASE WHEN bedrooms < 2 THEN property_type END AS be, 0.95::DOUBLE AS bc, CASE WHEN bedrooms < 4 THEN 'txt ' || area END AS ta, CASE WHEN bedrooms < 4 THEN 'machinery' END AS te, 0.85::DOUBLE AS tc,
  CASE WHEN status = 'F' THEN 'household' END AS em, 0.9::DOUBLE AS ec, CASE WHEN bedrooms < 5 THEN 'hdr' END AS ha, CASE WHEN bedrooms < 5 THEN 'building' END AS he, 'furniture' AS de FROM listings)
SELECT id, coalesce(ba, ta, ha) AS area, CASE WHEN ba IS NOT NULL THEN 0.95 WHEN ta IS NOT NULL THEN 0.85 WHEN ha IS NOT NULL THEN 0.8 ELSE 0 END::DOUBLE AS area_confidence,
  CASE WHEN be IS NOT NULL THEN be WHEN em IS NOT NULL THEN em WHEN te IS NOT NULL THEN te WHEN he IS NOT NULL THEN he ELSE de END AS final_emirate,
  round(CASE WHEN be IS NOT NULL AND em <> be THEN 0.95 * 0.9 WHEN em IS NOT NULL THEN 0.9 WHEN be IS NOT NULL THEN 0.95 WHEN te IS NOT NULL THEN 0.85 * 0.9 WHEN he IS NOT NULL THEN 0.8 ELSE 0.65 END::DOUBLE, 6) AS final_emirate_confidence FROM l""")
def q_resolve(spark, d):
    br = F.col("bedrooms")
    rows = listings(spark, d).select(
        "id", F.when(br < 2, F.col("area")).alias("bld_area"), F.when(br < 2, F.col("property_type")).alias("bld_emirate"), F.lit(0.95).alias("bld_conf"), F.when(br < 4, F.concat(F.lit("txt "), "area")).alias("txt_area"),
        F.when(br < 4, "machinery").alias("txt_emirate"), F.lit(0.85).alias("txt_conf"), F.when(F.col("status") == "F", "household").alias("emirate"), F.lit(0.9).alias("emirate_conf"),
        F.when(br < 5, "hdr").alias("hdr_area"), F.when(br < 5, "building").alias("hdr_emirate"), F.lit("furniture").alias("dev_emirate"))
    return ex.resolve_location(rows).select("id", "area", "area_confidence", "final_emirate", F.round("final_emirate_confidence", 6).alias("final_emirate_confidence"))


@query("header_fields", f"""WITH {LISTINGS} SELECT id, CASE WHEN status <> 'P' THEN area END AS area, CASE WHEN status <> 'P' THEN building END AS building, CASE WHEN status = 'F' THEN CAST(bedrooms * 101 AS VARCHAR) END AS unit FROM listings""")
def q_header(spark, d):
    st = F.col("status")
    text = (
        F.when(st == "F", F.concat(F.lit("📍 Area: "), "area", F.lit("\nProject: "), "building", F.lit("\nUnit no: "), (F.col("bedrooms") * 101).cast("string")))
        .when(st == "O", F.concat("area", F.lit(" – "), "building", F.lit("\n2BR, vacant"))).otherwise("Lovely home\nno labels"))
    return listings(spark, d).select("id", ex.header_fields(text).alias("h")).select("id", "h.*")


@query("relevance_score", f"""{AD}, s AS (SELECT id, CASE deal_quality WHEN 'very_good' THEN 0.2::DOUBLE + 2 * 0.15::DOUBLE WHEN 'good' THEN 0.35 WHEN 'interesting' THEN 0.35 WHEN 'normal' THEN 0.0 ELSE 0.2::DOUBLE + 3 * 0.15::DOUBLE END::DOUBLE AS score FROM ads) SELECT id, round(score, 6) AS score, score >= 0.349999 AS relevant FROM s""")
def q_relevance(spark, d):
    s = ex.relevance_score("text")
    return adverts(spark, d).select("id", F.round(s, 6).alias("score"), (s >= 0.349999).alias("relevant"))


@query("news_dedup", """WITH i AS (SELECT page_id, sha1(url || '|' || regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS k FROM pages) SELECT min(page_id) AS page_id, k AS item_key FROM i GROUP BY k""")
def q_news_dedup(spark, d):
    p = load_table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"))
    return ex.dedup_items(p, "url", "title", "page_id").select("page_id", "item_key")


RULES = [
    ex.PatternRule("selling", "price", r"selling price: aed ([\d,]+)"), ex.PatternRule("any_number", "price", r"([\d,]{6,})"),
    ex.PatternRule("size", "area_sqft", r"size: ([\d,]+) sqft"), ex.PatternRule("rooms", "bedrooms", r"(\d)br", ("tower",)),
]


@query("pattern_eval", f"""{AD}, g AS (SELECT text FROM ads WHERE deal_quality = 'very_good'), b AS (SELECT lower(text) AS t FROM ads WHERE deal_quality IS NULL OR deal_quality <> 'very_good'),
r AS (SELECT 'selling' AS rule, (SELECT count(*) FILTER (WHERE CAST(replace(regexp_extract(text, '(?i)selling price: aed ([\\d,]+)', 1), ',', '') AS BIGINT) BETWEEN 100000 AND 100000000) / count(*) FROM g) AS m, 0.0::DOUBLE AS f
  UNION ALL SELECT 'size', (SELECT count(*) FILTER (WHERE TRY_CAST(replace(regexp_extract(text, '(?i)size: ([\\d,]+) sqft', 1), ',', '') AS BIGINT) BETWEEN 200 AND 50000) / count(*) FROM g), 0.0
  UNION ALL SELECT 'rooms', (SELECT count(*) FILTER (WHERE regexp_matches(text, '(?i)[1-9]br')) / count(*) FROM g), (SELECT count(*) FILTER (WHERE regexp_matches(t, '\\dbr') AND contains(substr(t, greatest(strpos(t, regexp_extract(t, '(\\d)br', 0)) - 30, 1), 63), 'tower')) / count(*) FROM b)
  UNION ALL SELECT 'any_number', (SELECT count(*) FILTER (WHERE TRY_CAST(replace(regexp_extract(text, '([\\d,]{{6,}})', 1), ',', '') AS BIGINT) BETWEEN 100000 AND 100000000) / count(*) FROM g),
   (SELECT count(*) FILTER (WHERE x <> '' AND (NOT coalesce(TRY_CAST(replace(x, ',', '') AS BIGINT) BETWEEN 100000 AND 100000000, FALSE) OR contains(c, 'rent') OR contains(c, 'deposit') OR contains(c, 'service charge'))) / count(*)
    FROM (SELECT regexp_extract(t, '([\\d,]{{6,}})', 1) AS x, substr(t, greatest(strpos(t, regexp_extract(t, '([\\d,]{{6,}})', 1)) - 30, 1), length(regexp_extract(t, '([\\d,]{{6,}})', 1)) + 60) AS c FROM b)))
SELECT rule, round_even(m, 3) AS match_rate, round_even(f, 3) AS fp_rate, round_even(m, 3) >= 0.5 AND round_even(f, 3) <= 0.05 AS is_valid FROM r""")
def q_pattern_eval(spark, d):
    a = adverts(spark, d)
    good = F.coalesce(F.col("deal_quality") == "very_good", F.lit(False))
    return ex.pattern_eval(a.filter(good), a.filter(~good), "text", RULES)


@query("intent_rules", """SELECT event_id, CASE event_type WHEN 'view' THEN 'analytics' WHEN 'click' THEN 'roi' WHEN 'signup' THEN 'hub' WHEN 'purchase' THEN 'resale' ELSE '' END AS bot, CASE event_type WHEN 'view' THEN 'analytics.trend' WHEN 'click' THEN 'roi.calculate'
  WHEN 'signup' THEN 'hub.menu' WHEN 'purchase' THEN 'resale.search' ELSE '' END AS intent, CASE event_type WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.92 WHEN 'signup' THEN 0.8 WHEN 'purchase' THEN 0.9 ELSE 0 END::DOUBLE AS confidence FROM events""")
def q_intents(spark, d):
    e = F.col("event_type")
    t = F.when(e == "view", "show me the price Trend").when(e == "click", "contact a manager about the YIELD").when(e == "signup", "please help").when(e == "purchase", "Куплю студию").otherwise("hmm")
    return load_table(spark, d, "events").select("event_id", ex.intent_rules(t).alias("i")).select("event_id", "i.*")


@query("rebuild_dictionary", f"""WITH {TX}, {LISTINGS}, own AS (SELECT lower(building) AS k, area, count(*) AS n FROM (SELECT CASE WHEN bedrooms = 0 THEN 'small ring' ELSE building END AS building, area FROM listings WHERE deal_quality IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2),
reg AS (SELECT k, area, deals FROM (SELECT lower(building) AS k, area, sum(count(*)) OVER (PARTITION BY lower(building)) AS deals, row_number() OVER (PARTITION BY lower(building) ORDER BY count(*) DESC, area) AS rn FROM tx GROUP BY lower(building), area) WHERE rn = 1)
SELECT k AS key, area, CAST(deals AS BIGINT) AS deals, 'registry' AS source FROM reg UNION ALL SELECT k, arg_min(area, (-n, area)), CAST(sum(n) AS BIGINT), 'own' FROM own WHERE k NOT IN (SELECT k FROM reg) GROUP BY k""")
def q_rebuild(spark, d):
    l = listings(spark, d).filter(F.col("deal_quality").isNotNull()).select(F.when(F.col("bedrooms") == 0, "small ring").otherwise(F.col("building")).alias("building"), "area")
    return ex.rebuild_dictionary(transactions(spark, d), l).select("key", "area", "deals", "source")


@query("messages_to_listings", f"""{AD}, p AS (SELECT *, CASE deal_quality WHEN 'good' THEN rent WHEN 'interesting' THEN CAST(trunc(CAST(printf('%.2f', sale / 1000000.0::DOUBLE) AS DOUBLE) * 1000000) AS BIGINT) ELSE sale END AS p FROM ads)
SELECT id, CASE WHEN deal_quality = 'good' THEN 'rent' ELSE 'sale' END AS deal_type, CASE deal_quality WHEN 'very_good' THEN CASE WHEN bedrooms = 0 THEN 'studio' ELSE 'apartment' END WHEN 'good' THEN 'studio' WHEN 'interesting' THEN 'villa' ELSE 'apartment' END AS property_type,
  CASE deal_quality WHEN 'very_good' THEN bedrooms WHEN 'good' THEN 0 WHEN 'interesting' THEN bedrooms + 2 WHEN 'normal' THEN NULL ELSE 2 END AS bedrooms, CASE WHEN deal_quality = 'good' OR p >= 200000 THEN p END::DOUBLE AS price, 'AED' AS currency,
  CASE deal_quality WHEN 'very_good' THEN 'offplan' WHEN 'interesting' THEN 'rented' END AS status, CASE deal_quality WHEN 'good' THEN lower(replace(area, 'NATION', 'Quarter')) WHEN 'interesting' THEN area WHEN 'normal' THEN NULL ELSE building END AS building,
  CASE deal_quality WHEN 'good' THEN 0.6 WHEN 'interesting' THEN 0.7 WHEN 'normal' THEN 0.0 ELSE 0.95 END::DOUBLE AS building_confidence, p.area, CASE WHEN n_nationkey % 7 = 0 THEN 0.6 WHEN deal_quality = 'good' THEN 0.85 ELSE 0.95 END::DOUBLE AS area_confidence,
  CASE WHEN n_nationkey % 7 <> 0 THEN r_name END AS emirate FROM p JOIN nation ON n_name = p.area JOIN region ON n_regionkey = r_regionkey""")
def q_messages(spark, d):
    n, r = load_table(spark, d, "nation"), load_table(spark, d, "region")
    spell = F.explode(F.array("n_name", F.lower(F.replace("n_name", F.lit("NATION"), F.lit("Quarter")))))
    areas = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("area"), F.col("r_name").alias("emirate"), spell.alias("alias"), (F.col("n_nationkey") % 7 == 0).alias("ambiguous"))
    regions = r.select(F.col("r_name").alias("region"), F.col("r_name").alias("alias"), F.col("r_regionkey").alias("priority"))
    none = F.lit(None).cast("string")
    buildings = listings(spark, d).select("building").distinct().select("building", none.alias("area"), none.alias("emirate"), F.col("building").alias("alias"))
    out = ms.parse_messages(adverts(spark, d).select("id", "text"), "id", "text", ms.Places(regions, areas, buildings))
    return out.select("id", "deal_type", "property_type", "bedrooms", "price", "currency", "status", "building", "building_confidence", "area", "area_confidence", "emirate")


_FIELDS = """coalesce(CASE WHEN regexp_matches(t, '(?i)\\bUSD\\b') THEN 'USD' END, CASE WHEN regexp_matches(t, '(?i)\\bEUR\\b') THEN 'EUR' END, CASE WHEN regexp_matches(t, '(?i)\\bGBP\\b') THEN 'GBP' END, CASE WHEN regexp_matches(t, '(?i)\\bRUB\\b') THEN 'RUB' END,
  CASE WHEN contains(t, '$') THEN 'USD' END, CASE WHEN contains(t, '€') THEN 'EUR' END, CASE WHEN contains(t, '£') THEN 'GBP' END, CASE WHEN contains(t, '₽') THEN 'RUB' END, 'AED') AS currency,
  CASE WHEN regexp_matches(lower(t), '\\boff[\\s-]?plan\\b|\\bunder\\s+construction\\b|\\bhandover\\s+(?:q[1-4]|in\\s+\\d{4}|\\d{4}|date)') THEN 'offplan' WHEN regexp_matches(lower(t), '\\b(?:rented|tenanted|with\\s+tenant|leased)\\b') THEN 'rented'
  WHEN regexp_matches(lower(t), '\\bvacant\\b|\\bunoccupied\\b') THEN 'vacant' WHEN regexp_matches(lower(t), '\\bready\\s+to\\s+(?:move\\s+in|occupy)\\b|\\bcompleted\\b|\\bhanded\\s+over\\b') THEN 'ready' END AS status,
  CASE WHEN length(regexp_extract(t, '(?i)(?:unit|apt|flat|#|no\\.)[:\\s#]*([A-Z0-9\\-]+)', 1)) BETWEEN 2 AND 10 THEN regexp_extract(t, '(?i)(?:unit|apt|flat|#|no\\.)[:\\s#]*([A-Z0-9\\-]+)', 1) END AS unit_number"""


@query("document_fields", f"""SELECT doc_id, {_FIELDS} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def q_document_fields(spark, d):
    return load_table(spark, d, "documents").select("doc_id", ms.currency("text").alias("currency"), ms.status("text").alias("status"), ms.unit_number("text").alias("unit_number"))


@query("conversation_fields", f"""SELECT conv_id, turn, {_FIELDS} FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def q_conversation_fields(spark, d):
    return load_table(spark, d, "conversations").select("conv_id", "turn", ms.currency("text").alias("currency"), ms.status("text").alias("status"), ms.unit_number("text").alias("unit_number"))


# Names are the first three words of the benchmark's passages, and all first words of conversations' texts.
@query("names_in_documents", r"""WITH b AS (SELECT string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark UNION ALL SELECT string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')[1:1] FROM conversations),
n AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS key, least(len(w), 3) AS k FROM b WHERE w[1] <> ''), d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM n)), r AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS key FROM g)
SELECT doc_id, key, CAST(count(*) AS BIGINT) AS mentions FROM r WHERE key IN (SELECT key FROM n) GROUP BY ALL""")
def q_names_in_documents(spark, d):
    words = lambda t: F.split(name_key("text"), " ")
    keys = load_table(spark, d, "benchmark").select(F.array_join(F.slice(words("text"), 1, 3), " ").alias("key")).unionByName(load_table(spark, d, "conversations").select(words("text")[0].alias("key")))
    return find_names(load_table(spark, d, "documents"), "doc_id", "text", keys).select("doc_id", "key", "mentions")
