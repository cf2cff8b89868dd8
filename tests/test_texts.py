"""Advert wording: invented texts with hand-written expectations."""

import pytest
from pyspark.sql import functions as F

from gavel.operators import extract as ex

DEAL = [
    ("2BR flat for sale, rental yield 7%", "sale"), ("Asking price 1.2M, tenant pays 80k", "sale"), ("Sale price negotiable, per year service 10k", "sale"), ("Сдаётся студия на год", "rent"),
    ("Cosy studio, 4 cheques", "rent"), ("to let: villa with garden", "rent"), ("продаю квартиру", "sale"), ("off plan unit with payment plan", "sale"), ("chiller free, dewa free", "rent"), ("nice home", "sale"),
]
PRICES = [
    ("For sale\nPrice: AED 1,250,000\nRented at 75k", 1_250_000), ("Selling price -3M\n2 BHK", 3_000_000), ("OP: 2.1M\nSP: 1.95M", 1_950_000), ("Price 1,59 M AED", 1_590_000), ("AED 13.290.000 net", 13_290_000),
    ("Price: 2.300 000 AED", 2_300_000), ("Price: 7.800,000", 7_800_000), ("Price: 3.100.00 AED", 3_100_000), ("Selling price 2M\nNEW PRICE 1.8M", 1_800_000), ("Rent 85000\n2 cheques", 85_000),
    ("For rent, annual 95,000 AED", 95_000), ("Size 1200 sqft\nAED 1.1M", 1_100_000), ("Call +971 50 123 4567\nPrice 900k", 900_000), ("Reference No: 34881961\nAED 2,400,000", 2_400_000),
    ("No numbers here at all", None), ("For sale, 50k on handover", None), ("Цена: 1 200 000", 1_200_000), ("Priсe: 650k", 650_000), ("2.93B tower deal", None), ("~~AED 2M~~ now AED 1.7M", 1_700_000),
]
ROOMS = [("2BR flat", 2), ("studio near park", 0), ("Three bedroom\n2300 sqft", 3), ("2,5 bedroom loft", 2), ("Bedrooms: 4", 4), ("1-bed unit", 1), ("office", None), ("19 bedrooms", None), ("3 غرف نوم", 3)]
TYPES = [
    ("2BR apartment with villa view", "apartment"), ("Independent villa, 5BR", "villa"), ("Apartment in Villa Nova", "apartment"), ("Town house corner unit", "townhouse"), ("Penthouse on top", "penthouse"), ("Villa plot G+1", "plot"),
    ("1BR in Office Tower", "apartment"), ("Office space, fitted", "office"), ("Studio with balcony", "studio"), ("duplex views flat", "apartment"), ("G+12 building for sale", "whole_building"), ("Hotel apartment serviced", "hotel_apartment"),
]
SIZES = [("Size: 1,148 sqft", 1148.0), ("Area: 120 sqm", 1291.7), ("BUA: 3683 sqft, Plot: 5,000 sqft", 3683.0), ("75.4 m²", 811.6), ("18 000 sqft", 18000.0), ("50 sqft", None), ("380 sq/ft", 380.0), ("41,73 sqm", 449.2)]


def _check(spark, cases, column):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = {r.i: r.v for r in df.select("i", column.alias("v")).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(cases)} == dict(cases)


def test_deal_type(spark):
    _check(spark, DEAL, ex.deal_type("text")["deal_type"])


def test_price(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "i int, text string")
    got = {r.i: r.price for r in ex.price_amounts(df, "text").collect()}
    assert {t: got[i] for i, (t, _) in enumerate(PRICES)} == dict(PRICES)


def test_bedrooms(spark):
    _check(spark, ROOMS, ex.bedrooms("text"))


def test_property_type(spark):
    _check(spark, TYPES, ex.property_type("text"))


def test_size(spark):
    _check(spark, SIZES, ex.sizes("text")["size_sqft"])


@pytest.mark.parametrize(
    "text,blocks",
    [
        ("2BR HAVEN 12M | 3BR PALM 8M", ["2BR HAVEN 12M", "3BR PALM 8M"]), ("First nice flat here\n-----\nSecond nice flat here", ["First nice flat here", "Second nice flat here"]),
        ("1. Marina flat 2BR\n2. Palm villa 5BR", ["1. Marina flat 2BR", "2. Palm villa 5BR"]), ("short", ["short"]), ("   ", []),
        ("Palm Tower 2BR 3M here ok\n====\nPalm Tower 2BR 3M here ok, sea view", ["Palm Tower 2BR 3M here ok, sea view"]),
    ],
)
def test_split_blocks(spark, text, blocks):
    df = spark.createDataFrame([(text,)], "text string")
    rows = ex.split_blocks(df, "text").orderBy("block_index").collect()
    assert [r.block for r in rows] == blocks


def test_spam(spark):
    cases = [("too short", True), ("Looking for a 2BR in the marina area please", True), ("2018 BMW 640i M Sport, low mileage, automatic", True), ("Lovely flat in Batumi with sea view for you", True),
             ("Sunny two bedroom flat with balcony, asking price 1.2M", False), ("Cash buyer wants a studio in the creek now", True)]
    _check(spark, cases, ex.is_spam("text"))


def test_building_view_reference(spark):
    docs = spark.createDataFrame([(1, "2BR with Palm Tower view"), (2, "2BR in Palm Tower, high floor"), (3, "near Palm Tower and parks"), (4, "Palm Towr\n2BR")], "id int, text string")
    names = spark.createDataFrame([("Palm Tower", "Palm", "X", "Palm Tower")], "building string, area string, emirate string, alias string")
    got = {r.id: (r.building, r.confidence) for r in ex.building_match(docs, "id", "text", names).collect()}
    assert got == {2: ("Palm Tower", 0.95), 4: ("Palm Tower", 0.82)}


def test_handover_and_off_plan(spark):
    cases = [("Handover Q3 2027", "Q3 2027"), ("completion in 2026", "2026"), ("ready to move", "ready"), ("2028 Q1 handover", "Q1 2028"), ("sea breeze", None)]
    _check(spark, cases, ex.handover("text")["label"])
    _check(spark, [("off-plan, title deed", True), ("tenanted", False), ("sunny", None)], ex.off_plan("text"))


def test_literal_columns_work(spark):
    assert spark.range(1).select(ex.view(F.lit("full sea view"))).first()[0] == "sea"


def test_blanks_and_case_of_every_script(spark):
    price = lambda t: ex.price_amounts(spark.createDataFrame([(t,)], "t string"), "t").first().price
    assert price("Price: 1\u00a0200\u00a0000 AED") == price("Price: 1 200 000 AED") == 1_200_000
    assert price("Телефон: 33 44 5566778") == price("телефон: 33 44 5566778")
    row = spark.createDataFrame([("2\u00a0BR, 1,200\u202fsqft",)], "t string").select(ex.bedrooms("t").alias("b"), ex.clean_text("t").alias("c")).first()
    assert row.b == 2 and row.c == "2 BR, 1,200 sqft"


def test_names_of_any_length_and_late_blocks(spark):
    long = "The Grand Old Harbour View Residence Number Eight"
    names = spark.createDataFrame([(long, "A", "X", long), ("Short Tower", "A", "X", "Short Tower")], "building string, area string, emirate string, alias string")
    docs = spark.createDataFrame([(1, f"2BR in {long}, high floor"), (2, "2BR in Short Tower"), (3, "x")], "id int, text string")
    got = {r.id: r.building for r in ex.building_match(docs, "id", "text", names).collect()}
    assert got[1] == long and got[2] == "Short Tower"


def test_patterns_run_only_where_a_word_of_theirs_occurs(spark):
    """The words of a pattern never hide a match, whatever letters stand for them, and they are found at all."""
    from gavel.functions.patterns import needed_words, pull, says, with_fold

    assert needed_words(r"(?iuU)\bsea\s*view\b|\bocean") == ("ocean", "view") and needed_words(r"\d+(?:view)?") == () and needed_words(r"(?iu)[ab]\QX\E") == ()
    assert needed_words(r"(?i)\bBUA\s*(?:size)?\s*[:\-]?\s*([\d,]+)") == ("bua",)
    patterns = [r"(?iuU)\bsea\s*view\b|\bocean", r"(?iuU)вид\s+на\s+море", r"(?iu)kitchen\s+(\d+)", r"(?iu)build(?:ing)?\s(\d+)", r"бассейн (\d)", r"(?s)plot(?!\s+9).*sale"]
    texts = ["SEA VIEW", "ſea view", "ВИД на МОРЕ", "Kitchen 7", "buİldİng 4", "BUİLD 5", "бассейн 3", "Plot 1 sale", "plot 1\nsale", "plot 9 sale", "ocean", "", "straße", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", with_fold(F.col("t")).alias("x"))
    for p in patterns:
        rows = df.select(says(F.col("x"), p).alias("a"), F.col("t").rlike(p).alias("b"), pull(F.col("x"), p, 0).alias("c"), F.regexp_extract("t", p, 0).alias("d")).collect()
        assert all(r.a == r.b and (r.c or "") == (r.d or "") for r in rows) and any(r.b for r in rows), p
