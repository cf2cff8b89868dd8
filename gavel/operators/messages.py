"""One job from messages to listings: every field of the first advert, its place, its price checks, confidence and review."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions import text_rules
from gavel.functions.exprs import half_even
from gavel.functions.patterns import Seen, compiled, pull, said, says
from gavel.operators import extract as ex
from gavel.operators.benchmarks import confidence
from gavel.operators.names import find_names, name_key, region_from_text
from gavel.session import cut_lineage

tr = compiled(text_rules)
WIDE = ex.WIDE


@dataclass(frozen=True)
class Places:
    """Dictionaries of the place steps. ``regions``: region, alias, priority. ``areas``: area, emirate, alias, ambiguous.
    ``buildings``: building, area, emirate, alias. ``spellings``: name, alias of names beyond the buildings. ``developers``: developer, alias, emirate."""

    regions: DataFrame
    areas: DataFrame
    buildings: DataFrame
    spellings: DataFrame | None = None
    developers: DataFrame | None = None
    abbreviations: Mapping[str, str] = field(default_factory=dict)


def currency(text: Column | str) -> Column:
    """Currency by code as a word, then by sign, else the home currency."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return _currency(t, t.rlike)


def _currency(t: Column, holds: Callable[[str], Column]) -> Column:
    by_code = [F.when(holds(rf"(?i)\b{c}\b"), c) for c in tr.CURRENCY_CODES]
    by_sign = [F.when(t.contains(sign), c) for sign, c in tr.CURRENCY_SIGNS]
    return F.coalesce(*by_code, *by_sign, F.lit(tr.HOME_CURRENCY))


def status(text: Column | str) -> Column:
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return _status(low.rlike)


def _status(holds: Callable[[str], Column]) -> Column:
    return F.coalesce(*[F.when(holds(WIDE + p), label) for label, p in tr.STATUS_RULES])


def unit_number(text: Column | str) -> Column:
    """The first unit-like number if it has 2 to 10 characters."""
    return _unit(F.regexp_extract(F.col(text) if isinstance(text, str) else text, tr.UNIT_NUMBER, 1))


def _unit(found: Column) -> Column:
    return F.when(F.length(found).between(2, 10), found)


def _terms(block: Column) -> Column:
    """struct(currency, status, unit) of a block, as the three functions above give them one by one."""

    def read(t: Seen, low: Seen) -> Column:
        return F.struct(_currency(t.text, lambda p: says(t, p)).alias("currency"), _status(lambda p: says(low, p)).alias("status"), _unit(pull(t, tr.UNIT_NUMBER, 1)).alias("unit"))

    return said(read, F.coalesce(block, F.lit("")), F.lower(F.coalesce(block, F.lit(""))))


def extra_info(text: Column | str, kind: Column | str) -> Column:
    """Further fields by property type, as a map of texts; empty where the type has none."""
    block = F.coalesce(ex.first_block(text), F.lit(""))
    kind = F.col(kind) if isinstance(kind, str) else kind

    def read(t: Seen, low: Seen, k: Column) -> Column:
        number = lambda p: pull(low, p, 1).try_cast("int").cast("string")
        label = lambda rules: F.coalesce(*[F.when(says(low, "(?uUs)" + p), name) for name, p in rules])
        flags = lambda rules: {name: F.when(says(low, "(?uU)" + p), "true") for name, p in rules.items()}
        gfa = F.regexp_replace(pull(t, tr.PLOT_GFA, 1), ",", "").try_cast("double").cast("bigint").cast("string")
        fields = {
            tuple(tr.COMMERCIAL_TYPES): {"fit_out": label(tr.FIT_OUT), "parking_spaces": number(tr.PARKING_SPACES), "meeting_rooms": number(tr.MEETING_ROOMS), **flags(tr.COMMERCIAL_FLAGS)},
            ("plot",): {
                "usage": F.coalesce(F.nullif(F.trim(pull(t, tr.PLOT_USAGE, 1)), F.lit("")), label(tr.PLOT_USAGES)), "tenure": label(tr.PLOT_TENURE), "gfa_sqft": gfa,
                "floors": F.concat(F.lit("G+"), pull(t, tr.PLOT_FLOORS, 1).try_cast("int").cast("string"))},
            tuple(tr.RESIDENTIAL_TYPES): {**flags(tr.RESIDENTIAL_FLAGS), "parking_spaces": number(tr.PARKING_SPACES)},
        }
        out = F.lit(None)
        for kinds, columns in fields.items():
            entries = F.array(*[F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in columns.items()])
            out = F.coalesce(F.when(k.isin(*kinds), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))), out)
        return F.coalesce(out, F.create_map().cast("map<string,string>"))

    return said(read, block, F.lower(block), k=kind)


def price_checks(df: DataFrame) -> DataFrame:
    """Price, size and price per foot made plausible: sizes in metres, totals given per foot, monthly rents, service charges.
    Columns read: price, size_sqft, deal_type, property_type, block."""
    c = F.col
    metres = (c("size_sqft") < tr.METRES_BELOW) & (c("price") > tr.METRES_PRICE)
    df = df.withColumn("size_sqft", F.when(F.coalesce(metres, F.lit(False)), half_even(c("size_sqft") * 10.764, 1)).otherwise(c("size_sqft")))
    total = F.floor(c("price") * c("size_sqft")).cast("double")
    per_foot = (c("price") < tr.PER_FOOT_BELOW) & (c("size_sqft") > tr.PER_FOOT_SIZE) & (c("deal_type") == "sale") & (total > tr.PER_FOOT_TOTAL)
    df = df.withColumn("price", F.when(F.coalesce(per_foot, F.lit(False)), total).otherwise(c("price")))
    monthly = (c("deal_type") == "rent") & (c("price") < tr.MONTHLY_BELOW) & (ex.rent_period("block", c("price")) == "monthly") & ~F.col("block").rlike(tr.YEARLY_IN_TEXT)
    df = df.withColumn("price", F.when(F.coalesce(monthly, F.lit(False)), c("price") * 12).otherwise(c("price")))
    charge = c("property_type").isin(*tr.RESIDENTIAL_TYPES) & (((c("deal_type") == "rent") & (c("price") < tr.RENT_FLOOR)) | ((c("deal_type") == "sale") & (c("price") < tr.SALE_FLOOR)))
    df = df.withColumn("price", F.when(~F.coalesce(charge, F.lit(False)), c("price")))
    return df.withColumn("price_per_sqft", F.when((c("price") != 0) & (c("size_sqft") != 0), half_even(c("price") / c("size_sqft"), 0)))


def _located(blocks: DataFrame, doc_id: str, places: Places) -> DataFrame:
    """Place columns of :func:`gavel.operators.extract.resolve_location`, one row per message that has any."""
    ids = blocks.select(doc_id)
    region = region_from_text(blocks, doc_id, "block", places.regions).withColumnsRenamed({"region": "emirate", "confidence": "emirate_conf"})
    found = ex.building_match(blocks, doc_id, "block", places.buildings, spellings=places.spellings)
    building = found.withColumnsRenamed({"area": "bld_area", "emirate": "bld_emirate", "confidence": "bld_conf"})
    known = ids.join(region, doc_id, "left").join(building, doc_id, "left").select(doc_id, "emirate", "emirate_conf", "building", "bld_area", "bld_emirate", "bld_conf")
    known = cut_lineage(known, "places")  # few columns, used three times: buildings are looked for once
    asked = blocks.select(doc_id, "block", "header").join(known, doc_id)
    asked = asked.withColumn("known_region", F.coalesce("bld_emirate", "emirate"))
    fallback = places.regions.select(F.col("region").alias("area"), "alias")
    area = ex.area_match(asked, doc_id, "block", places.areas, fallback, places.abbreviations, "known_region")
    area = area.withColumnsRenamed({"area": "txt_area", "emirate": "txt_emirate", "confidence": "txt_conf"})
    # an area named in a labelled line counts if it is a known spelling as a whole
    spelt = places.areas.groupBy(name_key("alias").alias("__k")).agg(F.min_by(F.struct(F.col("area").alias("hdr_area"), F.when(~F.col("ambiguous"), F.col("emirate")).alias("hdr_emirate")), "area").alias("__h"))
    placed = asked.join(area, doc_id, "left").withColumn("__k", name_key(F.col("header.area"))).join(spelt, "__k", "left")
    placed = placed.select("*", "__h.*").drop("__k", "__h")
    if places.developers is None:
        placed = placed.withColumns({"developer": F.lit(None).cast("string"), "dev_emirate": F.lit(None).cast("string")})
    else:
        named = places.developers.withColumn("key", name_key("alias"))
        hits = find_names(blocks, doc_id, "clean", named).join(named, "key")
        best = hits.groupBy(doc_id).agg(F.min_by(F.struct("developer", F.col("emirate").alias("dev_emirate")), F.struct(-F.length("key"), F.col("developer"))).alias("__d"))
        placed = placed.join(best, doc_id, "left").select("*", "__d.*").drop("__d")
    from_header = F.col("building").isNull() & F.col("header.building").isNotNull()
    placed = placed.withColumn("bld_conf", F.when(from_header, 0.70).otherwise(F.col("bld_conf"))).withColumn("building", F.coalesce("building", F.col("header.building")))
    return ex.resolve_location(placed).select(
        doc_id, "building", F.coalesce("bld_conf", F.lit(0.0)).alias("building_confidence"), "area", "area_confidence", F.col("final_emirate").alias("emirate"),
        F.col("final_emirate_confidence").alias("emirate_confidence"), "developer")


def parse_messages(docs: DataFrame, doc_id: str, text: str, places: Places) -> DataFrame:
    """Listings of messages: one row per message that is no spam, with all fields of its first advert.

    Messages go by ``doc_id``, which must be unique; null texts are spam (too short). Fields are null where a message does not name them.
    """
    rows = docs.select(F.col(doc_id), F.col(text).alias("text")).withColumn("clean", ex.clean_text("text"))
    # a column, not a filter: a filter would move in front of the shuffle that deals the messages out
    rows = rows.withColumn("spam", ex.is_spam("clean")).withColumn("block", ex.first_block("text")).select("*", ex.header_fields("text").alias("header"))
    blocks = cut_lineage(rows, "messages").filter(~F.col("spam")).drop("spam")  # read by the place steps, the price and the other fields
    prices = ex.price_amounts(blocks.select(doc_id, "block"), "block").select(doc_id, F.col("price").cast("double").alias("price"), F.col("original_price").cast("double").alias("original_price"))
    placed = _located(blocks, doc_id, places)
    fields = blocks.select(
        doc_id, "block", ex.deal_type("block")["deal_type"].alias("deal_type"), ex.bedrooms("block").alias("bedrooms"), ex.bathrooms("block").alias("bathrooms"),
        ex.sizes("block").alias("s"), ex.view("block").alias("view"), ex.floor("block").alias("fl"), _terms(F.col("block")).alias("terms"),
        F.col("header.unit").alias("__unit"), ex.furnishing("block").alias("furnishing"), ex.contacts("text").alias("who"), ex.off_plan("block").alias("off_plan"),
        ex.handover("block")["label"].alias("handover"))
    fields = fields.select("*", F.coalesce("__unit", "terms.unit").alias("unit_number"), "terms.status", "terms.currency")
    typed = fields.withColumn("property_type", ex.property_type("block", F.col("bedrooms"))).withColumn("extra", extra_info("block", "property_type"))
    wide = typed.select(doc_id, "block", "deal_type", "property_type", "bedrooms", "bathrooms", "s.*", "view", "fl.*", "unit_number", "status", "furnishing", "who.*", "off_plan", "handover", "currency", "extra")
    wide = wide.withColumnRenamed("category", "floor_category").join(prices, doc_id).join(placed, doc_id)
    return confidence(price_checks(wide)).drop("block")
