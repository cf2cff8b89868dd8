"""Texts are worked on where they were dealt to, and only as far as their words ask for it."""

from pyspark.sql import functions as F

from gavel.functions import patterns
from gavel.operators import extract as ex
from gavel.operators import messages as ms
from gavel.operators import names


def test_spam_rules_do_not_move_in_front_of_the_shuffle(spark, monkeypatch):
    """A filter on texts is pushed through the exchange that deals them out, into the few tasks that read the files."""
    written = []

    class Stop(Exception):
        pass

    def record(df, purpose="cut"):
        written.append(df)
        raise Stop

    monkeypatch.setattr(ms, "cut_lineage", record)
    docs = spark.range(4).select("id", F.concat(F.lit("2BR for sale in Marina number "), F.col("id").cast("string")).alias("text")).repartition(4, "id")
    try:
        ms.parse_messages(docs, "id", "text", None)
    except Stop:
        pass
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Repartition"):]


def test_numbers_beyond_64_bits_are_no_amounts(spark):
    df = spark.createDataFrame([(1, "price: 12 345 678 901 234 567 890 123 and more"), (2, "selling price: 2.5M")], "id long, text string")
    got = {r["id"]: r["price"] for r in ex.price_amounts(df, "text").collect()}
    assert got == {1: None, 2: 2_500_000}


def test_blanked_equals_all_replacements(spark):
    rules = [r"(?iu)\bsaves?[\s:=]+\d+", r"#\s*\d{6,10}\b", r"(?iu)\b(?:paid|down\s+payment)[\s:=]+\d+"]
    texts = ["Saves 20 PAID: 300 #1234567", "down  payment 5", "plain", "", "sa#123456ves 4", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    plain = F.col("text")
    for p in rules:
        plain = F.regexp_replace(plain, p, " ")
    rows = df.select(plain.alias("a"), patterns.blanked(F.array("text"), rules)[0].alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_names_are_handed_on_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(names, "HITS_AT_ONCE", 3)
    finder = names.NameFinder(["ab", "cd", "ab cd"])
    assert finder.counts("AB, cd; ab", False) == {"ab": (2, 0), "cd": (1, 0), "ab cd": (1, 0)} == finder.counts("AB, cd; ab", True)
    docs = spark.createDataFrame([(i, "ab cd") for i in range(10)] + [(10, None)], "id long, text string").coalesce(1)
    keys = spark.createDataFrame([("ab",), ("cd",), ("ab cd",)], "key string")
    got = names.find_names(docs, "id", "text", keys).collect()
    assert len(got) == 30 and {r["mentions"] for r in got} == {1}


def _texts(spark):
    said = [
        "Selling price: AED 1,250,000\nRented at 75k, call +971 50 123 4567", "Цена: 3 755 409\nвид на море", "prıce 12.5M and SELLING PRİCE 3M", "final price 2M\r\nREF: 12345678", "éprice: 5M price: 6M",
        "Price 120 m² 900k", "op 2.1M, sp 1.95M", "1.234.56 AED rent 85,000 yearly", "new price 1.8M selling price 2M", "СР: 9м", "", " ", None, "x" * 70_000 + " price: 4M"]
    return spark.createDataFrame(list(enumerate(said)), "id int, text string").coalesce(1)


def test_texts_are_looked_through_in_batches_without_a_miss(spark):
    """Where a batch says that a pattern cannot be found, Spark's own expression finds nothing either."""
    tr = ex.tr
    rules = [*tr.PRICE_NOISE, *[p for p, _ in tr.PRICE_LABELS], *[p for p, _ in tr.GENERIC_PRICES], tr.ORIGINAL_PRICE, r"(?iu)[^a]b", r"(?U)\S\W", r"(?i)a{2,3}+b", r"\bprice\b(?!:)"]
    assert patterns.loose(r"(?i)a{2,3}+b") is None and patterns.loose(r"(?iu)\bprice[\s:]+(\d+)\s*[mk]?") is not None
    seen = patterns.Seen(F.col("x"), {p: i for i, p in enumerate(rules)})
    df = _texts(spark).select("id", patterns.look(F.col("text"), rules).alias("x"))
    missed = df.select("id", *[(seen.text.rlike(p) & ~seen.may(p)).alias(f"m{i}") for i, p in enumerate(rules)]).collect()
    assert [r["id"] for r in missed if any(r[f"m{i}"] for i in range(len(rules)))] == []
    tried = df.select("id", sum(F.coalesce(seen.may(p), F.lit(False)).cast("int") for p in tr.PRICE_NOISE).alias("n")).collect()
    assert {r["id"] for r in tried if r["n"] > 20} == {2, 4}  # letters whose cases leave their script


def test_prices_of_texts_in_batches_equal_prices_by_columns(spark, monkeypatch):
    df = _texts(spark)
    got = ex.price_amounts(df, "text").select("id", "price", "original_price").collect()
    plans = df.select(patterns.rewritten(F.col("text"), ex.PRICE_REPAIRS).alias("a"), ex._price_text(F.col("text")).alias("b"))
    both = plans.collect()
    assert sum(r["a"] is not None for r in both) >= 8 and all(r["a"] in (None, r["b"]) for r in both)
    monkeypatch.setattr(patterns, "loose", lambda p: None)  # every pattern is tried
    monkeypatch.setattr(ex, "rewritten", lambda text, steps: F.lit(None).cast("string"))
    assert sorted(got) == sorted(ex.price_amounts(df, "text").select("id", "price", "original_price").collect())


def test_price_patterns_are_not_evaluated_row_by_row(spark):
    """A price needs a look through the batch; the patterns of noise run there."""
    plan = ex.price_amounts(_texts(spark), "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 2
    assert ex.price_amounts(spark.createDataFrame([("prıce: 8M",)], "text string"), "text").first()["price"] == 8_000_000


def test_fields_of_texts_in_batches_equal_patterns_tried_everywhere(spark, monkeypatch):
    said = [
        "🔥 FOR SALE 🔥\n3BR villa view flat, BUA: 3,683 sqft, office tower\nParking 2 parking, balcony\nOff-plan, Q3 2027, agent: John Smith 050 123 4567", "furnıshed studıo, daıly", "Сдаётся студия, высокий этаж",
        "Area: Marina\nTower: Palm – Beach\nUnit: 12", "MARINA – PALM\r\nplot for sale G+2, usage: mixed use", "**5**,000 AED!!!  call  now ----", "tenanted, 7th floor, sea view, 2,5 bedroom, 3 baths", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    fields = lambda: df.select(
        "id", ex.clean_text("text"), ex.is_spam("text"), ex.header_fields("text"), ex.deal_type("text"), ex.deal_type("text", F.lit(9e5)), ex.rent_period("text"), ex.bedrooms("text"), ex.bathrooms("text"), ex.furnishing("text"), ex.view("text"),
        ex.floor("text"), ex.handover("text"), ex.off_plan("text"), ex.contacts("text"), ex.sizes("text"), ex.property_type("text"), ms._terms(F.col("text")), *[F.map_entries(ms.extra_info("text", F.lit(k))) for k in ("villa", "plot", "office")])
    got = sorted(fields().collect())
    assert (got[1][9], got[1][6], got[1][7]) == ("furnished", "daily", 0)  # the patterns take ı for i, as a word test in front of them did not
    one_by_one = df.select("id", ms.currency("text"), ms.status("text"), ms.unit_number("text")).collect()
    assert [tuple(r[17]) for r in got[:-1]] == [tuple(r)[1:] for r in sorted(one_by_one)[:-1]]
    monkeypatch.setattr(patterns, "loose", lambda p: None)
    monkeypatch.setattr(ex, "rewritten", lambda text, steps: F.lit(None).cast("string"))
    assert got == sorted(fields().collect())


def test_lines_are_sorted_by_token_once_each(spark, monkeypatch):
    """Of equal lines one is compared with names: what is worked out for it does not move in front of the distinct."""
    from gavel.functions import similarity

    written = []
    monkeypatch.setattr(similarity, "cut_lineage", lambda df, purpose="cut": written.append(df) or df)
    left = spark.range(100).select(F.concat(F.lit("tower "), (F.col("id") % 2).cast("string")).alias("l"))
    got = similarity.fuzzy_pairs(left, "l", spark.createDataFrame([("0 tower",)], "r string"), "r", 90)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "Aggregate" in line) + 1:]
    assert below and not any("split(" in line or "Filter" in line for line in below)
    assert got.collect() == [("tower 0", "0 tower", 100.0)]
