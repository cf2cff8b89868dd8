"""Coercion and normalisation of registry columns (pure column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit factor and exchange rates.
SQFT_PER_SQM = 10.7639
RATES_TO_AED = {"USD": 3.67, "EUR": 4.00, "GBP": 4.65, "RUB": 0.040, "AED": 1.0, "DHS": 1.0, "DH": 1.0}

# Where a deep link comes from, by its first token.
LINK_ALIASES = {
    "offplan": "channel", "channel": "channel", "resale": "resale", "hub": "hub",
    "roi": "roi", "analytics": "analytics", "dld": "analytics", "lead": "lead",
}

ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
DAY_DASH = r"^\d{2}-\d{2}-\d{4}$"
DAY_SLASH = r"^\d{2}/\d{2}/\d{4}$"
EPOCH = r"^\d{10}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_date(col: Column | str) -> Column:
    """ISO prefix, DD-MM-YYYY, DD/MM/YYYY or ten-digit epoch → date; anything else NULL."""
    c = _c(col).cast("string")
    return (
        F.when(c.rlike(ISO_PREFIX), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
        .when(c.rlike(DAY_DASH), F.try_to_date(c, "dd-MM-yyyy"))
        .when(c.rlike(DAY_SLASH), F.try_to_date(c, "dd/MM/yyyy"))
        .when(c.rlike(EPOCH), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c.try_cast("bigint") / 86400).cast("int")))
    )


def date_format_class(col: Column | str) -> Column:
    """Which of the known date formats a text has; OTHER for unknown, NULL for NULL."""
    c = _c(col).cast("string")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c.rlike(ISO_PREFIX + "$"), "ISO_DATE")
        .when(c.rlike(ISO_PREFIX + r"[ T]\d{2}:\d{2}"), "ISO_DATETIME")
        .when(c.rlike(DAY_DASH), "DD-MM-YYYY")
        .when(c.rlike(DAY_SLASH), "DD/MM/YYYY")
        .when(c.rlike(EPOCH), "EPOCH")
        .otherwise("OTHER")
    )


def safe_num(col: Column | str) -> Column:
    """Digits and dots only (the sign is lost, as in the source data rules); NULL if none."""
    return F.regexp_replace(_c(col).cast("string"), "[^0-9.]", "").try_cast("double")


def safe_int(col: Column | str) -> Column:
    """As :func:`safe_num` but keeps the sign and floors."""
    return F.floor(F.regexp_replace(_c(col).cast("string"), r"[^0-9.\-]", "").try_cast("decimal(30,6)")).cast("bigint")


def safe_bool(col: Column | str) -> Column:
    low = F.lower(_c(col).cast("string"))
    return F.when(low.isin("true", "t", "yes", "y", "1"), F.lit(True)).when(low.isin("false", "f", "no", "n", "0"), F.lit(False))


def safe_text(col: Column | str, fallback: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(_c(col).cast("string")), F.lit("")), F.lit(fallback))


def title_case(col: Column | str) -> Column:
    return F.initcap(F.trim(_c(col)))


def norm_property_type(prop_type: Column | str, sub_type: Column | str) -> Column:
    """Registry (type, subtype) → residential type, NULL for everything else."""
    pt = F.lower(F.trim(F.coalesce(_c(prop_type), F.lit(""))))
    st = F.lower(F.trim(F.coalesce(_c(sub_type), F.lit(""))))
    return (
        F.when(pt.contains("villa") | st.contains("villa"), "villa")
        .when(st.contains("townhouse") | st.contains("town house"), "townhouse")
        .when(st.contains("penthouse"), "penthouse")
        .when((st == "flat") | ((pt == "unit") & st.contains("flat")), "apartment")
        .when(st.contains("hotel apartment"), "apartment")
    )


def norm_profile_type(prop_type: Column | str, sub_type: Column | str) -> Column:
    """Variant used for area profiles: land and commercial types are kept."""
    pt = F.lower(F.trim(F.coalesce(_c(prop_type), F.lit(""))))
    st = F.lower(F.trim(F.coalesce(_c(sub_type), F.lit(""))))
    return (
        F.when(pt.contains("villa") | st.contains("villa"), "villa")
        .when(F.array_contains(F.split(st, r"\s+"), "flat") | st.contains("hotel apartment"), "apartment")
        .when(pt == "land", "plot")
        .when(pt == "building", "commercial")
        .when(st.isin("office", "shop", "commercial", "warehouse", "industrial"), "commercial")
    )


def norm_bedrooms(rooms: Column | str, sub_type: Column | str) -> Column:
    """'Studio' → 0, 'N B/R' → N, otherwise the first number if 0..12."""
    r = F.lower(F.trim(F.coalesce(_c(rooms), F.lit(""))))
    st = F.lower(F.trim(F.coalesce(_c(sub_type), F.lit(""))))
    exact = F.regexp_extract(r, r"^\s*(\d+)\s*b\s*/?\s*r\s*$", 1).try_cast("int")
    first = F.regexp_extract(r, r"(\d+)", 1).try_cast("int")
    return (
        F.when((r == "") & st.startswith("studio"), 0)
        .when(r == "", F.lit(None).cast("int"))
        .when(r.contains("studio"), 0)
        .when(exact.isNotNull(), exact)
        .when(first.between(0, 12), first)
    )


def rooms_bucket(bedrooms: Column | str) -> Column:
    """studio / 1br … 4br / 5br+ / all."""
    b = _c(bedrooms)
    return (
        F.when(b.isNull(), "all").when(b <= 0, "studio").when(b >= 5, "5br+").otherwise(F.concat(b.cast("string"), F.lit("br")))
    )


def rooms_bucket_from_text(rooms: Column | str) -> Column:
    """Read-model spelling of a room text: studio / 1br … 4br / 4br+ / all."""
    r = F.lower(F.trim(_c(rooms)))
    out = F.when(r.isNull() | (r == ""), "all").when(r.contains("studio"), "studio")
    for n in "1234":
        out = out.when(r.startswith(n) | r.contains(f"{n}br") | r.contains(f"{n} b"), f"{n}br")
    return out.when(F.substring(r, 1, 1).isin("5", "6", "7"), "4br+").otherwise("all")


def rooms_label(bedrooms: Column | str) -> Column:
    """Registry label: Studio or 'N B/R' for 1..10."""
    b = _c(bedrooms)
    return F.when(b == 0, "Studio").when(b.between(1, 10), F.concat(b.cast("string"), F.lit(" B/R")))


def stats_property_type(col: Column | str) -> Column:
    """Listing type → read-model type; unknown types count as apartments."""
    p = F.lower(F.trim(_c(col)))
    return (
        F.when(p.isin("villa", "townhouse", "office", "warehouse"), p)
        .when(p.isin("retail", "shop"), "retail")
        .when(p.isin("plot", "land"), "land")
        .otherwise("apartment")
    )


def norm_area_name(df: DataFrame, col: str, aliases: DataFrame, out: str = "area_norm") -> DataFrame:
    """Trim, title-case, then the alias (``alias`` → ``canonical``) or the name as it is."""
    named = df.withColumn("__t", F.nullif(title_case(col), F.lit("")))
    side = aliases.select(F.col("alias").alias("__t"), F.col("canonical").alias("__canon"))
    return named.join(side, "__t", "left").withColumn(out, F.coalesce("__canon", "__t")).drop("__t", "__canon")


def norm_text_key(col: Column | str) -> Column:
    """Lower-case, keep letters (Latin, Cyrillic, Arabic), digits, space, dash, parentheses."""
    low = F.lower(F.trim(_c(col)))
    kept = F.regexp_replace(low, r"[^0-9a-z_ \-Ѐ-ӿ؀-ۿ()]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def norm_phone(col: Column | str) -> Column:
    """Digits only, at least eight, the last nine of them."""
    d = F.regexp_replace(_c(col), "[^0-9]", "")
    return F.when(F.length(d) >= 8, F.right(d, F.lit(9)))


def parse_utm(payload: Column | str) -> Column:
    """Deep-link payload → struct(from_bot, utm_source, utm_campaign, utm_content)."""
    p = F.trim(F.coalesce(_c(payload), F.lit("")))
    has = p.contains("_utm_")
    head = F.when(has, F.substring_index(p, "_utm_", 1)).otherwise(p)
    tail = F.when(has, F.substring(p, F.instr(p, "_utm_") + 5, F.length(p)))
    parts = F.split(tail, "_")
    piece = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit(""))
    rest = F.when(F.size(parts) >= 3, F.nullif(F.array_join(F.slice(parts, 3, 1_000_000), "_"), F.lit("")))
    first = F.lower(F.split(F.substring(head, 6, 1_000_000), "_")[0])
    named = F.coalesce(
        *[F.when(first == k, F.lit(v)) for k, v in LINK_ALIASES.items()], F.nullif(first, F.lit("")), F.lit("unknown")
    )
    origin = (
        F.when(head.startswith("from_"), named)
        .when(head.rlike(r"^proj[-_|]"), "channel")
        .when(head.rlike(r"^resale[-_]"), "resale")
        .when(head.rlike(r"^roi[-_]"), "roi")
        .when(head.rlike(r"^(area|bld)[-_]"), "analytics")
        .otherwise("unknown")
    )
    return F.struct(
        origin.alias("from_bot"), piece(1).alias("utm_source"), piece(2).alias("utm_campaign"), rest.alias("utm_content")
    )


def to_aed(amount: Column | str, currency: Column | str) -> Column:
    """Fixed-rate conversion, truncated to whole units; NULL for unknown currencies."""
    cur = F.upper(F.coalesce(F.nullif(_c(currency), F.lit("")), F.lit("AED")))
    rate = F.coalesce(*[F.when(cur == k, F.lit(v)) for k, v in RATES_TO_AED.items()])
    return (_c(amount) * rate).cast("bigint")


def area_units(sqft: Column | str, sqm: Column | str) -> tuple[Column, Column]:
    """Fill the missing unit from the other; both NULL outside 100..50000 sqft."""
    f, m = F.nullif(_c(sqft), F.lit(0.0)), F.nullif(_c(sqm), F.lit(0.0))
    sqft_all = F.coalesce(f, F.round(m * SQFT_PER_SQM, 1))
    sqm_all = F.coalesce(m, F.round(f / SQFT_PER_SQM, 1))
    wrong = (sqft_all < 100) | (sqft_all > 50000)
    return F.when(~F.coalesce(wrong, F.lit(False)), sqft_all), F.when(~F.coalesce(wrong, F.lit(False)), sqm_all)
