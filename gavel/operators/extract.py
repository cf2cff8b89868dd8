"""Structured fields from advert texts: column expressions over whole texts, no row loops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.exprs import bind, half_even
from gavel.functions import text_rules
from gavel.functions.patterns import Seen, blanked, compiled, look, plain_blanks, pull, rewritten, said, says
from gavel.functions.scale import best_per_key
from gavel.functions.similarity import fuzzy_pairs
from gavel.operators.aggregates import mode_value
from gavel.operators.names import expand_abbreviations, find_names, name_key
from gavel.session import cut_lineage

WIDE = "(?iuU)"
tr = compiled(text_rules)
#: A slice length beyond any array.
TO_THE_END = 2_000_000_000


def _c(x: Column | str) -> Column:
    return plain_blanks(F.col(x) if isinstance(x, str) else x)


def _any(text: Seen, patterns: Sequence[str]) -> Column:
    return says(text, WIDE + "(?:" + "|".join(patterns) + ")")


def _words(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _label(text: Seen, rules: Sequence[tuple[str, str]], flags: str = WIDE) -> Column:
    """Label of the first pattern that is found."""
    return F.coalesce(*[F.when(says(text, flags + p), F.lit(label)) for label, p in rules])


def _number(text: Seen, patterns: Sequence[str], low: int, high: int, flags: str = "") -> Column:
    """First pattern whose group 1 is an integer inside the range."""
    found = F.array(*[pull(text, flags + p, 1).try_cast("int") for p in patterns])
    return F.try_element_at(F.filter(found, lambda v: v.between(low, high)), F.lit(1))


def first_block(text: Column | str) -> Column:
    """The first advert of a message: up to a rule line or two empty lines."""
    return F.split(_c(text), tr.FIRST_BLOCK, 2)[0]


CLEANING = [
    ("[\U0001F300-\U0001FAFF\u2600-\u27BF\uFE0F]+", " "), (r"[=_\-*•·|]{3,}", " "), (r"!{2,}", "!"), (r"(\d)\*{1,2}(?=,\d{3})", "$1"), (r"\*{1,2}(\d)", "$1"), (r"(\d)\*{1,2}", "$1"),
    (r"\s{2,}|[\t\n\x0B\f\r]", " ")]


def clean_text(text: Column | str) -> Column:
    """Without emoji, rules, repeated exclamation marks and markdown around digits."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.trim(F.coalesce(rewritten(t, CLEANING), bind(t, lambda x: reduce(lambda x, r: F.regexp_replace(x, *r), CLEANING, x))))


def _signature(block: Column) -> Column:
    low = F.lower(block)
    millions = F.regexp_extract(low, r"\b(\d+(?:\.\d+)?)\s*m\b", 1).try_cast("double") * 1_000_000
    dirhams = F.regexp_replace(F.regexp_extract(low, r"aed\s*([\d,]+)", 1), ",", "").try_cast("double")
    name = F.nullif(F.lower(F.regexp_extract(block, r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})\b", 1)), F.lit(""))
    rooms = F.regexp_extract(low, r"\b(\d+)\s*(?:br|bedroom|bhk)\b", 1).try_cast("int")
    return F.struct(name.alias("n"), F.coalesce(millions, dirhams).cast("bigint").alias("p"), rooms.alias("r"))


def split_blocks(df: DataFrame, text: str) -> DataFrame:
    """Message → advert blocks (``block_index`` from 0, ``block``), several rows per message.

    Tried in order: inline bars between complete adverts, rule lines, repeated sale/rent headers,
    numbering; otherwise the message is one block. Consecutive blocks with the same (name, price,
    bedrooms) keep the longer text. Everything happens inside the row.
    """
    body = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), tr.FORWARDED, ""))
    cut = "\u0001"
    tidy = lambda a, n: F.filter(F.transform(a, lambda x: F.trim(x, F.lit(" \n\t\r"))), lambda x: F.length(x) > n)
    staged = df.withColumn("__b", F.trim(body, F.lit(" \n\t\r")))
    bars = F.split("__b", r"\s*\|\s*")
    marks = lambda p: F.slice(F.split(F.regexp_replace("__b", p, cut + "$0"), cut), 2, TO_THE_END)
    complete = F.forall("__i", lambda p: p.rlike(tr.INLINE_BEDROOMS) & p.rlike(tr.INLINE_PRICE))
    staged = staged.select(*df.columns, "__b", bars.alias("__i"))
    # a way of cutting is tried only where those before it left one piece
    ways = [tidy(F.split("__b", tr.SEPARATOR_LINE), 10), tidy(marks(tr.BLOCK_HEADER), 10), tidy(marks(tr.NUMBERED), 10)]
    cut_up = reduce(lambda rest, way: bind(way, lambda x: F.when(F.size(x) > 1, x).otherwise(rest)), reversed(ways), F.array("__b"))
    pieces = (
        F.when((F.size("__i") > 1) & complete, tidy(F.col("__i"), 0))
        .when(F.length("__b") < 30, F.filter(F.array("__b"), lambda x: x != "")).otherwise(cut_up))
    several = staged.select(*df.columns, pieces.alias("__q"))
    # signatures tell pieces of one message from each other: a single piece needs none
    signed = several.withColumn("__p", F.transform("__q", lambda b: F.struct(b.alias("b"), F.when(F.size("__q") > 1, _signature(b)).alias("s"))))
    start = F.array().cast("array<struct<b:string,s:struct<n:string,p:bigint,r:int>>>")

    def fold(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        known = x["s"]["n"].isNotNull() | (x["s"]["p"].isNotNull() & x["s"]["r"].isNotNull())
        same = F.coalesce(last["s"] == x["s"], F.lit(False)) & known
        longer = F.when(F.length(x["b"]) > F.length(last["b"]), F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), x)).otherwise(acc)
        return F.when(same, longer).otherwise(F.array_append(acc, x))

    kept = F.aggregate("__p", start, fold)
    return signed.select(*df.columns, F.posexplode(kept).alias("block_index", "__k")).select(*df.columns, "block_index", F.col("__k.b").alias("block"))


def is_spam(text: Column | str) -> Column:
    """Too short, advertising words, vehicles, foreign markets, business offers, buyer requests."""
    t = F.coalesce(_c(text), F.lit(""))

    def read(low: Seen) -> Column:
        car = (says(low, tr.CAR_BRANDS) & says(low, tr.CAR_FEATURES)) | says(low, tr.CAR_HEADLINE)
        abroad = _any(low, tr.FOREIGN_MARKETS) & ~says(low, WIDE + tr.HOME_MARKET)
        weak = _any(low, tr.WEAK_BUYER) & ~says(low, tr.OFFER_MARKERS)
        # business offers and buyers' wording one by one: each has words of its own
        wanted = reduce(lambda a, b: a | b, [says(low, WIDE + p) for p in (*tr.BUSINESS_OFFERS, *tr.STRONG_BUYER)])
        return says(low, "|".join([*tr.SPAM_WORDS, *tr.COMMERCIAL_WORDS])) | car | abroad | wanted | weak

    return (F.length(F.trim(t)) < 25) | said(read, F.lower(t))


def deal_type(text: Column | str, price: Column | None = None) -> Column:
    """struct(deal_type, confidence): strong sale wording, strong rent wording, price size,
    counted signals, price format, price range, else sale."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))

    def read(x: Seen, p: Column) -> Column:
        hits = lambda words: reduce(lambda a, b: a + b, [F.when(x.text.contains(w), 1).otherwise(0) for w in words])
        rent = hits(tr.RENT_SIGNALS) + F.when(says(x, tr.CHEQUES), 1).otherwise(0) + F.when(says(x, tr.RENT_NUMBER), 1).otherwise(0)
        sale = hits(tr.SALE_SIGNALS)
        out = lambda d, c: F.struct(F.lit(d).alias("deal_type") if isinstance(d, str) else d.alias("deal_type"), F.lit(c).alias("confidence"))
        hint = F.coalesce(_label(x, tr.FORMAT_HINTS, ""), F.when(p >= 15_000, F.when(p < 500_000, "rent").otherwise("sale")), F.lit("sale"))
        opens_rent = F.substring(x.text, 1, 300).rlike(WIDE + tr.RENT_OPENING)

        def decide(n: Column) -> Column:
            return (
                F.when((p >= 500_000) & (n["rent"] == 0), out("sale", 0.5)).when((p >= 1_200_000) & ~opens_rent, out("sale", 0.5))
                .when(n["rent"] > n["sale"], out("rent", 0.5)).when(n["sale"] > n["rent"], out("sale", 0.5)).otherwise(out(hint, 0.5)))

        counted = bind(F.struct(rent.alias("rent"), sale.alias("sale")), decide)
        return F.when(says(x, WIDE + tr.SALE_HARD), out("sale", 0.95)).when(says(x, WIDE + tr.RENT_HARD), out("rent", 0.90)).otherwise(counted)

    return said(read, low, p=price if price is not None else F.lit(None).cast("double"))


def rent_period(text: Column | str, price: Column | None = None) -> Column:
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    by_price = F.lit(None).cast("string") if price is None else F.when(price > 0, F.when(price < 30_000, "monthly").when(price > 500_000, "yearly"))
    return F.coalesce(said(lambda x: _label(x, tr.RENT_PERIODS), low), by_price, F.lit("unknown"))


def bedrooms(text: Column | str) -> Column:
    """Numbers first, then number words, studio (0), Arabic forms; 0..15."""

    def read(low: Seen) -> Column:
        words = F.coalesce(*[F.when(says(low, rf"\b{w}\s+(?:bedroom|bed|br|bhk|b/r)s?\b"), F.lit(n)) for w, n in tr.BEDROOM_WORDS.items()])
        arabic = F.coalesce(_number(low, tr.ARABIC_BEDROOMS, 0, 15, WIDE), F.when(says(low, r"غرفتين|غرفتان"), F.lit(2)))
        return F.coalesce(_number(low, tr.BEDROOM_NUMBERS, 0, 15), words, F.when(says(low, WIDE + tr.STUDIO), F.lit(0)), arabic)

    return said(read, F.lower(first_block(text)))


def bathrooms(text: Column | str) -> Column:
    return said(lambda t: _number(t, tr.BATHROOMS, 1, 20), first_block(text))


def furnishing(text: Column | str) -> Column:
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return said(lambda x: F.coalesce(*[F.when(_any(x, p), F.lit(label)) for label, p in tr.FURNISHING]), low)


def view(text: Column | str) -> Column:
    return said(lambda x: _label(x, tr.VIEWS), F.lower(F.coalesce(_c(text), F.lit(""))))


def floor(text: Column | str) -> Column:
    """struct(floor, category): a number wins (low < 5, mid < 20, high), else wording."""
    low = F.lower(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[*_~`]+", " "))

    def read(x: Column) -> Column:
        n, word = x["n"], x["word"]
        by_number = F.when(n >= 20, "high").when(n >= 5, "mid").when(n.isNotNull(), "low")
        return F.struct(
            F.coalesce(n, F.when(word == "ground", F.lit(0))).alias("floor"), F.coalesce(by_number, F.when(word == "ground", "low").otherwise(word)).alias("category"))

    found = said(lambda t: F.struct(_number(t, tr.FLOOR_NUMBERS, 1, 199, "(?uU)").alias("n"), _label(t, tr.FLOOR_WORDS).alias("word")), low)
    return bind(found, read)


def handover(text: Column | str) -> Column:
    """struct(year, quarter, label) such as 'Q3 2026', '2027' or 'ready'."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))

    def scan(t: Seen) -> Column:
        grab = lambda p, g: pull(t, p, g).try_cast("int")
        return F.struct(
            grab(tr.QUARTER_YEAR, 2).alias("y1"), grab(tr.QUARTER_YEAR, 1).alias("q1"), grab(tr.YEAR_QUARTER, 1).alias("y2"), grab(tr.YEAR_QUARTER, 2).alias("q2"),
            grab(WIDE + tr.HANDOVER_YEAR, 1).alias("y3"), grab(tr.OFFPLAN_YEAR, 1).alias("y4"), says(t, WIDE + tr.READY).alias("ready"))

    def settle(x: Column) -> Column:
        ok = lambda y: y.between(2020, 2099)
        quarter = F.when(ok(x["y1"]), x["q1"]).when(ok(x["y2"]), x["q2"])
        year = F.coalesce(*[F.when(ok(x[y]), x[y]) for y in ("y1", "y2", "y3", "y4")])
        return F.struct(year.alias("year"), quarter.alias("quarter"), x["ready"].alias("ready"))

    def name(x: Column) -> Column:
        year, quarter = x["year"], x["quarter"]
        label = (
            F.when(quarter.isNotNull(), F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string")))
            .when(year.isNotNull(), year.cast("string")).when(x["ready"], "ready"))
        return F.struct(year.alias("year"), quarter.alias("quarter"), label.alias("label"))

    return bind(bind(said(scan, low), settle), name)


def off_plan(text: Column | str) -> Column:
    """True, False, or NULL without signal; mixed signals count as off-plan."""
    t = F.coalesce(_c(text), F.lit(""))
    return said(lambda x: F.when(says(x, WIDE + tr.OFF_PLAN), F.lit(True)).when(says(x, WIDE + tr.READY_SIGNALS), F.lit(False)), t)


def contacts(text: Column | str) -> Column:
    """struct(phone, agent_name): the first local number as +971…"""

    def read(t: Seen) -> Column:
        digits = F.nullif(F.regexp_replace(pull(t, tr.LOCAL_PHONE, 1), r"[\s\-]", ""), F.lit(""))
        phone = F.concat(F.lit("+971"), F.regexp_replace(digits, r"^(?:\+971|0+)", ""))
        return F.struct(phone.alias("phone"), F.nullif(pull(t, tr.AGENT_NAME, 1), F.lit("")).alias("agent_name"))

    return said(read, F.coalesce(_c(text), F.lit("")))


def plain_numbers(raws: Column) -> Column:
    """Array of number texts → doubles. One comma with one or two digits after it is a decimal
    comma, other commas and blanks are thousands, '1.234,56' is European."""
    tight = F.transform(raws, lambda x: F.regexp_replace(x, r"\s", ""))

    def plain(s: Column) -> Column:
        none = F.lit("")
        european = F.replace(F.replace(s, F.lit("."), none), F.lit(","), F.lit("."))
        return (
            F.when(s.rlike(r"^[^,]*\.[^,]*,[^,.]*$"), european).when(s.rlike(r"^[^,.]*,\d{1,2}$"), F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), none))
        ).try_cast("double")

    return F.transform(tight, plain)


def sizes(text: Column | str, sqm_factor: float = 10.764) -> Column:
    """struct(size_sqft, bua_sqft, plot_sqft) of the first block, metres converted."""
    order = [
        ("bua", False, tr.BUA_SQFT), ("bua", True, tr.BUA_SQM), ("plot", False, tr.PLOT_SQFT), ("plot", True, tr.PLOT_SQM), *[("size", True, p) for p in tr.SQM_LABELLED],
        *[("size", False, p) for p in tr.SQFT_LABELLED], *[("size", False, p) for p in tr.SQFT_BARE], *[("size", True, p) for p in tr.SQM_BARE],
    ]
    numbers = said(lambda t: plain_numbers(F.array(*[pull(t, p, 1) for _, _, p in order])), first_block(text))

    def read(v: Column) -> Column:
        feet = [F.when(v[i].between(5, 10_000), half_even(v[i] * sqm_factor, 1)) if metric else F.when(v[i].between(200, 100_000), v[i]) for i, (_, metric, _) in enumerate(order)]
        pick = lambda kind: F.coalesce(*[f for f, (k, _, _) in zip(feet, order) if k == kind])
        return F.struct(F.coalesce(pick("size"), pick("bua")).alias("size_sqft"), pick("bua").alias("bua_sqft"), pick("plot").alias("plot_sqft"))

    return bind(numbers, read)


def property_type(text: Column | str, rooms: Column | None = None) -> Column:
    """Type of the first advert: whole building, plot, studio, villa (unless a flat is named
    first), townhouse, penthouse, duplex, flats in office towers, office, then the word list."""
    block = F.split(_c(text), r"\n\s*[-—–=]{3,}\s*\n|\n\s*\n\s*\n", 2)[0]
    low = F.lower(F.coalesce(block, F.lit("")))
    head = F.coalesce(rewritten(low, [(p, " ") for p in tr.VIEW_PHRASES]), reduce(lambda t, p: F.regexp_replace(t, p, " "), tr.VIEW_PHRASES, low))
    return said(_type_of, low, head, br=rooms if rooms is not None else F.lit(None).cast("int"))


def _type_of(low: Seen, head: Seen, br: Column) -> Column:
    measured = says(low, tr.BUILT_AREA) & says(low, tr.PLOT_AREA)
    house_word = says(head, r"\b(?:villa|townhouse|penthouse)\b")
    villa = says(head, WIDE + tr.VILLA) & ~says(head, "(?U)" + tr.HOME_BEFORE_VILLA) & ~says(head, tr.HOME_IN_VILLA_PROJECT)
    out = (
        F.when(says(head, "(?s)" + tr.WHOLE_BUILDING), "whole_building")
        .when(says(head, "(?s)" + tr.PLOT_OFFER) & ~measured, "plot")
        .when((F.coalesce(br == 0, F.lit(False)) | says(head, WIDE + r"\b(?:studio|студия)\b")) & ~house_word, "studio")
        .when(villa, "villa")
        .when(says(head, WIDE + r"\b(?:townhouse|town\s+house|townhome|таунхаус|th)\b"), "townhouse")
        .when(says(head, WIDE + r"\b(?:penthouse|pent\s+house|пентхаус)\b"), "penthouse")
        .when(says(head, WIDE + r"\b(?:duplex|дуплекс)\b"), "duplex")
        .when(says(head, tr.OFFICE_TOWER) & says(head, WIDE + tr.HOME_UNIT), "apartment")
        .when(says(head, tr.OFFICE), "office")
    )
    for label, words in tr.TYPE_WORDS:
        hit = _any(head, [rf"\b{w}\b" for w in words])
        out = out.when(hit & ~measured if label == "plot" else hit, label)
    return out.when(br == 0, "studio").otherwise("apartment")


# ---- price ---------------------------------------------------------------------------


def parse_amounts(raws: Column) -> Column:
    """Array of price texts → array of whole amounts (NULL where it is no amount).

    '1.5M', '750k', '3.2ML', '1,200,000', '1,59 M' (decimal comma), '1.064.000', '2.93B' (billions
    need a decimal). Plain numbers must exceed 1000. Each step binds its value once.
    """
    s = F.transform(raws, lambda x: F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), r"\bAED\b|\bUSD\b|\bEUR\b|ДРХ|د\.إ", ""), r"\s", ""))
    s = F.transform(s, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[.,\-*:]+", ""), r"^([^,.]*),(\d{1,2})(?!\d)([^,.]*)$", "$1.$2$3"))
    s = F.transform(s, lambda x: F.replace(x, F.lit(","), F.lit("")))
    s = F.transform(s, lambda x: F.when(F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))) > 1, F.regexp_replace(x, r"\.(\d{3})(?=\.|$|[A-Z])", "$1")).otherwise(x))
    parts = F.transform(s, lambda x: F.struct(F.regexp_extract(x, r"^([\d.]+)(?:MLN|ML|M|K|B)?$", 1).try_cast("double").alias("v"), F.regexp_extract(x, r"^[\d.]+(MLN|ML|M|K|B)?$", 1).alias("u"), F.contains(x, F.lit(".")).alias("d")))

    def amount(p: Column) -> Column:
        v, u = p["v"], p["u"]
        return (
            F.when(u.isin("MLN", "ML", "M"), F.when(v < 10_000, v * 1_000_000)).when(u == "K", F.when(v < 100_000, v * 1000))
            .when(u == "B", F.when(p["d"] & v.between(0.05, 100), v * 1_000_000_000)).otherwise(F.when(v > 1000, v))
        ).try_cast("bigint")

    return F.transform(parts, amount)


#: Noise is blanked, cut-off and broken thousands are joined and look-alike letters replaced, in this order.
PRICE_REPAIRS = [
    *[(p, " ") for p in tr.PRICE_NOISE], tr.TRUNCATED_THOUSANDS, (tr.OLD_PRICE, " ", tr.NEW_PRICE),
    (f"[{tr.HOMOGLYPHS_FROM}]", dict(zip(tr.HOMOGLYPHS_FROM, tr.HOMOGLYPHS_TO))), *tr.THOUSANDS]


def _price_text(body: Column) -> Column:
    """``PRICE_REPAIRS`` by Spark's functions, for any text."""
    t = F.regexp_replace(blanked(F.array(body), tr.PRICE_NOISE)[0], *tr.TRUNCATED_THOUSANDS)
    t = bind(t, lambda x: F.when(x.rlike(tr.NEW_PRICE), F.regexp_replace(x, tr.OLD_PRICE, " ")).otherwise(x))
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), tr.THOUSANDS, F.translate(t, tr.HOMOGLYPHS_FROM, tr.HOMOGLYPHS_TO))


def price_amounts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``price`` and ``original_price`` of the first advert in ``text``.

    Fragments with numbers that are no prices are removed, look-alike letters and broken
    thousands are repaired, then candidates are read in priority order: labelled prices, the
    original price, currency and rent forms, bare amounts with their own minimum. Amounts that
    cannot be prices are dropped.
    """
    body = first_block(F.coalesce(F.col(text), F.lit("")))
    # columns of their own: what is read more than once is worked out once
    cleaned = df.withColumns({"__b": body, "__plan": said(lambda x: says(x, tr.PAYMENT_PLAN), _c(text))})
    month = lambda x: F.regexp_extract(pull(x, tr.MONTHLY_RENT, 0), r"([\d][\d,.]*)", 1)
    cleaned = cleaned.withColumns({"__t": rewritten(F.col("__b"), PRICE_REPAIRS), "__m": said(month, F.col("__b"))})
    cleaned = cleaned.withColumn("__t", F.coalesce("__t", bind(F.col("__b"), _price_text)))
    asked = [*tr.PRICE_LABELS, *tr.PRICE_FALLBACKS, *tr.GENERIC_PRICES]
    order = {p: i for i, p in enumerate([*[p for p, _ in asked], tr.ORIGINAL_PRICE, tr.SLASH_RENT, tr.MILLIONS, tr.LABELLED_RU, tr.SALE_WORDING, tr.RENT_WORDING])}
    x = Seen(F.col("__x"), order)

    def tag(raw: Column, low: int, high: int) -> Column:
        return F.struct(raw.alias("raw"), F.lit(low).alias("lo"), F.lit(high).cast("bigint").alias("hi"))

    def one(pattern: str, low: int = 0) -> Column:
        return F.when(x.may(pattern), tag(F.regexp_extract(x.text, pattern, 1), low, 10**10))

    cash, rest = tr.PRICE_FALLBACKS[:2], tr.PRICE_FALLBACKS[2:]
    millions = F.concat(F.nullif(F.regexp_extract(x.text, tr.MILLIONS, 1), F.lit("")), F.lit("M"))
    single = F.array(
        *[one(p, low) for p, low in tr.PRICE_LABELS], one(tr.ORIGINAL_PRICE), *[one(p, low) for p, low in cash], F.when(~F.col("__plan"), one(tr.SLASH_RENT, 1000)),
        F.when(~F.col("__plan"), tag(F.col("__m"), 1000, 100_000)), *[one(p, low) for p, low in rest], F.when(x.may(tr.MILLIONS), tag(millions, 0, 10**10)),
        F.when(x.may(tr.LABELLED_RU), tag(F.regexp_replace(F.regexp_extract(x.text, tr.LABELLED_RU, 1), r"\s", ""), 0, 10**10)))
    several = [F.when(x.may(p), F.transform(F.regexp_extract_all(x.text, F.lit(p), 1), lambda r: tag(r, low, 10**10))) for p, low in tr.GENERIC_PRICES]  # noqa: B023
    found = F.flatten(F.filter(F.array(single, *several), lambda c: c.isNotNull()))
    # empty texts are no amounts: only what was found is parsed, up to the first amount that fits
    found = F.filter(found, lambda c: c["raw"] != "")
    fits = lambda c: bind(parse_amounts(F.array(c["raw"]))[0], lambda a: F.when((a > c["lo"]) & (a <= c["hi"]), a))
    price = F.aggregate(found, F.lit(None).cast("bigint"), lambda known, c: F.coalesce(known, fits(c)))
    original = F.when(x.may(tr.ORIGINAL_PRICE), parse_amounts(F.array(F.regexp_extract(x.text, tr.ORIGINAL_PRICE, 1)))[0])
    read = cleaned.withColumn("__x", look(F.col("__t"), list(order))).withColumns({"__p": price, "__o": original})
    short = F.length(x.text) < 800
    sane = lambda a: F.when((a <= 10_000_000_000) & ~((a > 500_000_000) & short), a)
    low_sale = (F.col("__p") < 100_000) & says(x, tr.SALE_WORDING) & ~says(x, tr.RENT_WORDING)
    return read.select(*df.columns, F.when(~F.coalesce(low_sale, F.lit(False)), sane(F.col("__p"))).alias("price"), sane(F.col("__o")).alias("original_price"))


# ---- names ---------------------------------------------------------------------------


def area_match(docs: DataFrame, doc_id: str, text: str, areas: DataFrame, fallback: DataFrame, abbreviations: Mapping[str, str] | None = None, known_region: str | None = None) -> DataFrame:
    """Area per text: the longest known area whose name or alias occurs. Confidence .95 for the
    name, .85 for an alias, .60 for ambiguous names, .45 at most if only an expanded abbreviation says so; .40 for a region name alone.

    ``areas``: area, emirate, alias, ambiguous (one row per spelling, the name included);
    ``fallback``: area, alias (regions). ``abbreviations`` are expanded before areas are looked for. ``known_region``: column of
    ``docs``; areas of another region do not count where it is not null. Repeated or null ids share one result.
    """
    a = areas.withColumn("key", name_key("alias")).withColumn("own", name_key("alias") == name_key("area"))
    f = fallback.withColumn("key", name_key("alias"))
    keys = a.select("key").unionByName(f.select("key")).distinct()
    read = docs.select(doc_id, F.col(text).alias("__said"), expand_abbreviations(text, abbreviations or {}).alias("__read"))
    hits = find_names(read, doc_id, "__read", keys).select(doc_id, "key")
    written = hits
    if abbreviations:
        expanded = read.filter(F.col("__said") != F.col("__read"))
        # where nothing was expanded, what is read is what is written
        said = find_names(expanded, doc_id, "__said", keys).select(doc_id, "key")
        written = hits.join(expanded.select(doc_id).distinct(), doc_id, "left_anti").unionByName(said)
    spellings = written.join(a, "key").select(doc_id, "area").distinct().withColumn("__written", F.lit(True))
    conf = F.when(F.col("ambiguous"), 0.60).otherwise(F.least(F.when(F.col("own"), 0.95).otherwise(0.85), F.when(F.col("__written").isNull(), 0.45).otherwise(1.0)))
    direct = hits.join(a, "key")
    if known_region:
        direct = direct.join(docs.groupBy(doc_id).agg(F.first(known_region, ignorenulls=True).alias("__region")), doc_id).filter(F.coalesce(F.col("emirate") == F.col("__region"), F.lit(True)))
    direct = direct.join(spellings, [doc_id, "area"], "left").select(doc_id, "area", F.when(~F.col("ambiguous"), F.col("emirate")).alias("emirate"), conf.alias("confidence"), F.lit(0).alias("stage"))
    region = hits.join(f, "key").select(doc_id, "area", F.col("area").alias("emirate"), F.lit(0.40).alias("confidence"), F.lit(1).alias("stage"))
    return best_per_key(direct.unionByName(region), [doc_id], [F.col("stage"), F.length("area").desc(), F.col("area"), F.col("confidence").desc()]).drop("stage")


def building_match(docs: DataFrame, doc_id: str, text: str, buildings: DataFrame, fuzzy_cutoff: float = 75, line_chars: tuple[int, int] = (4, 80), spellings: DataFrame | None = None) -> DataFrame:
    """Building per text: known name .95, alias .90, fuzzy line .82 (.75 for a name that is not in ``buildings``), wording hint .60.

    A name counts only if it occurs at least once outside a view or near-by reference. Lines outside
    ``line_chars`` characters are not tried for a fuzzy name: that rule belongs to the cascade.
    ``buildings``: building, area, emirate, alias (one row per spelling, the name included). ``spellings``: name, alias of further
    names that fuzzy lines are compared with.
    """
    b = buildings.withColumn("key", name_key("alias")).withColumn("stage", F.when(name_key("alias") == name_key("building"), 1).otherwise(2))
    hits = find_names(docs, doc_id, text, b, references=True).join(b, "key")
    judged = hits.select(doc_id, "building", "area", "emirate", "stage", F.lit(0.0).alias("score"), (F.col("mentions") > F.col("refs")).alias("is_real"))
    judged = cut_lineage(judged, "mentions")  # few rows, used three times: the texts are read once for them
    real = judged.filter("is_real").drop("is_real")
    rest = docs.select(doc_id, text).join(real.select(doc_id).distinct(), doc_id, "left_anti")
    pieces = rest.select(doc_id, F.explode(F.array_distinct(F.split(text, r"[|,·\n]|\s-\s"))).alias("line")).withColumn("line", F.trim("line")).filter(F.length("line").between(*line_chars))
    lines = cut_lineage(pieces.select(doc_id, F.lower("line").alias("low")), "lines")
    known = b.select(F.lower(F.trim("alias")).alias("name"), "building", "area", "emirate", F.lit(3).alias("stage"))
    if spellings is not None:
        own = b.select(F.lower(F.trim("building")).alias("__own"), F.col("building").alias("__building"), F.col("area").alias("__area"), F.col("emirate").alias("__emirate")).dropDuplicates(["__own"])
        further = spellings.select(F.lower(F.trim("alias")).alias("name"), F.col("name").alias("building")).distinct().join(own, F.lower(F.trim("building")) == F.col("__own"), "left")
        known = known.unionByName(further.select(
            "name", F.coalesce("__building", "building").alias("building"), F.col("__area").alias("area"), F.col("__emirate").alias("emirate"), F.when(F.col("__own").isNotNull(), 3).otherwise(4).alias("stage"))).distinct()
    near = fuzzy_pairs(lines, "low", known.select("name").distinct(), "name", fuzzy_cutoff).select(F.col("a").alias("low"), F.col("b").alias("name"), "score")
    mentioned = judged.select(doc_id, "building").distinct()  # only as a reference, or found above
    fuzzy = lines.join(near, "low").join(known, "name").join(mentioned, [doc_id, "building"], "left_anti")
    fuzzy = fuzzy.filter((F.col("stage") == 3) | (F.lower("building") != F.col("low"))).select(doc_id, "building", "area", "emirate", "stage", "score")
    hint = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(F.col(text), p, 1)), F.lit("")) for p in tr.BUILDING_HINTS])
    hinted = rest.select(doc_id, hint.alias("building")).filter(F.col("building").isNotNull()).select(
        doc_id, "building", F.lit(None).cast("string").alias("area"), F.lit(None).cast("string").alias("emirate"), F.lit(5).alias("stage"), F.lit(0.0).alias("score"))
    every = real.unionByName(fuzzy).unionByName(hinted)
    best = best_per_key(every, [doc_id], [F.col("stage"), F.col("score").desc(), F.length("building").desc(), F.col("building")])
    conf = F.element_at(F.array(*[F.lit(x) for x in (0.95, 0.90, 0.82, 0.75, 0.60)]), F.col("stage"))
    return best.select(doc_id, "building", "area", "emirate", conf.alias("confidence"))


def header_fields(text: Column | str) -> Column:
    """struct(area, building, unit) from labelled lines of the first block; a first line of the
    form 'AREA – BUILDING' fills what is missing."""

    def read(t: Seen) -> Column:
        lab = {k: F.nullif(F.trim(pull(t, p, 1)), F.lit("")) for k, p in tr.HEADER_LABELS.items()}
        left, right = (F.nullif(F.trim(pull(t, tr.HEADER_DASH, g)), F.lit("")) for g in (1, 2))
        return F.struct(F.coalesce(lab["area"], left).alias("area"), F.coalesce(lab["building"], right).alias("building"), lab["unit"].alias("unit"))

    return said(read, first_block(text))


def resolve_location(df: DataFrame) -> DataFrame:
    """Final area, region and confidence per row. The building's own area and region outrank the
    text; a region conflict lowers its confidence to 90 %; header hints count .80.

    Columns: bld_area, bld_emirate, bld_conf, txt_area, txt_emirate, txt_conf, emirate, emirate_conf,
    hdr_area, hdr_emirate, dev_emirate.
    """
    c = F.col
    area = F.coalesce("bld_area", "txt_area", "hdr_area")
    area_conf = F.when(c("bld_area").isNotNull(), c("bld_conf")).when(c("txt_area").isNotNull(), c("txt_conf")).when(c("hdr_area").isNotNull(), 0.80).otherwise(0.0)
    conflict = c("bld_emirate").isNotNull() & (c("emirate") != c("bld_emirate"))
    via_text = F.when(c("bld_area").isNull(), c("txt_emirate"))
    via_header = F.when(c("bld_area").isNull() & c("txt_area").isNull(), c("hdr_emirate"))
    emirate = F.coalesce("bld_emirate", "emirate", via_text, via_header, "dev_emirate")
    conf = (
        F.when(conflict, c("bld_conf") * 0.9).when(c("emirate").isNotNull(), c("emirate_conf")).when(c("bld_emirate").isNotNull(), c("bld_conf"))
        .when(via_text.isNotNull(), c("txt_conf") * 0.9).when(via_header.isNotNull(), 0.80).when(c("dev_emirate").isNotNull(), 0.65).otherwise(0.0)
    )
    return df.withColumns({"area": area, "area_confidence": area_conf, "final_emirate": emirate, "final_emirate_confidence": conf})


# ---- rule-driven text jobs -------------------------------------------------------------


def relevance_score(text: Column | str) -> Column:
    """0 without keyword, else min(1, .2 + .15·hits); relevant from .35."""
    n = F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(tr.MARKET_KEYWORDS))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.2 + n * 0.15))


def dedup_items(df: DataFrame, url: str, title: str, row_id: str) -> DataFrame:
    """One row (smallest id) per SHA-1 of (url, title)."""
    keyed = df.withColumn("item_key", F.sha1(F.concat_ws("|", url, title)))
    return keyed.join(keyed.groupBy("item_key").agg(F.min(row_id).alias(row_id)), ["item_key", row_id], "left_semi")


def intent_rules(text: Column | str) -> Column:
    """struct(bot, intent, confidence) of the most confident rule that matches."""
    t = F.coalesce(_c(text), F.lit(""))
    out = lambda b, i, c: F.struct(F.lit(b).alias("bot"), F.lit(i).alias("intent"), F.lit(c).alias("confidence"))
    ranked = sorted(tr.INTENTS, key=lambda r: -r[2])
    return F.coalesce(*[F.when(t.rlike(p), out(b, i, c)) for b, i, c, p in ranked], out("", "", 0.0))


@dataclass(frozen=True)
class PatternRule:
    """A proposed extraction rule: regex with the value as group 1."""

    name: str
    field: str
    pattern: str
    anti_words: tuple[str, ...] = ()


def value_sanity(field: str, value: Column) -> Column:
    """Whether a captured value is plausible for its field."""
    v = F.trim(value)
    digits = F.regexp_replace(v, r"[^\d]", "").try_cast("bigint")
    checks: Mapping[str, Column] = {
        "price": digits.between(100_000, 100_000_000), "area_sqft": digits.between(200, 50_000),
        "bedrooms": F.lower(v).isin("studio", "0") | digits.between(1, 9), "handover": v.rlike(r"20\d{2}"),
    }
    return F.coalesce((v != "") & checks.get(field, F.length(v).between(1, 80)), F.lit(False))


def pattern_eval(samples: DataFrame, others: DataFrame, text: str, rules: Sequence[PatternRule], context: int = 30) -> DataFrame:
    """Match rate on the samples the rule was made for and false-positive rate elsewhere, all
    rules in one pass per table. Valid: rate ≥ .5 and false positives ≤ .05. A hit elsewhere is
    false when its value is implausible or an anti-word stands within ``context`` characters."""
    t = F.col(text)

    def hit(r: PatternRule) -> Column:
        return F.regexp_extract(t, "(?i)" + r.pattern, 1)

    def false_hit(r: PatternRule) -> Column:
        whole = F.regexp_extract(t, "(?i)" + r.pattern, 0)
        at = F.instr(t, whole)
        around = F.lower(F.substring(t, F.greatest(at - context, F.lit(1)), F.length(whole) + 2 * context))
        words = [*tr.ANTI_CONTEXT.get(r.field, []), *r.anti_words]
        near = _words(around, [w.lower() for w in words]) if words else F.lit(False)
        return (whole != "") & (~value_sanity(r.field, hit(r)) | near)

    good = samples.agg(F.count("*").alias("n"), *[F.count_if((hit(r) != "") & value_sanity(r.field, hit(r))).alias(f"h{i}") for i, r in enumerate(rules)])
    bad = others.agg(F.count("*").alias("n"), *[F.count_if(false_hit(r)).alias(f"f{i}") for i, r in enumerate(rules)])
    rows = lambda df, p, name: df.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), half_even(F.coalesce(F.try_divide(F.col(f"{p}{i}").cast("double"), F.col("n").cast("double")), F.lit(0.0)), 3).alias(name)) for i, r in enumerate(rules)])).alias("x")).select("x.*")
    both = rows(good, "h", "match_rate").join(rows(bad, "f", "fp_rate"), "rule")
    return both.withColumn("is_valid", (F.col("match_rate") >= 0.5) & (F.col("fp_rate") <= 0.05))


def rebuild_dictionary(registry: DataFrame, own: DataFrame, min_own: int = 2) -> DataFrame:
    """All building names with their modal area, from the registry, completed by own rows that
    name building and area together at least ``min_own`` times."""
    key = F.lower(F.trim("building"))
    reg = mode_value(registry.withColumn("key", key).filter(F.col("key") != ""), ["key"], "area").withColumn("source", F.lit("registry"))
    pairs = own.withColumn("key", key).filter((F.col("key") != "") & F.col("area").isNotNull()).groupBy("key", "area").agg(F.count("*").alias("n")).filter(F.col("n") >= min_own)
    best = pairs.groupBy("key").agg(F.min_by("area", F.struct(-F.col("n"), F.col("area"))).alias("area"), F.sum("n").alias("deals")).withColumn("source", F.lit("own"))
    return reg.unionByName(best.join(reg.select("key"), "key", "left_anti")).withColumn("name", F.initcap("key"))
