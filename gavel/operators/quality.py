"""Data-quality contracts, gates, queues and repair sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.coerce import date_format_class
from gavel.functions.scale import salt_nulls
from gavel.operators.dedup import missing
from gavel.operators.joins import substring_lookup
from gavel.session import cut_lineage



@dataclass(frozen=True)
class ColumnRule:
    """Contract of one column: accepted types, importance, minimum share of present values."""

    types: tuple[str, ...]
    criticality: str = "HIGH"
    min_non_null_pct: float = 0.0
    is_date: bool = False


def contract_check(df: DataFrame, table: str, rules: Mapping[str, ColumnRule], max_other_share: float = 0.10) -> DataFrame:
    """Violations (table, column, kind, criticality, actual): missing column, type mismatch, too
    many NULLs, unknown date formats. Schema facts are known at planning time; all shares come
    from one pass over the whole table."""
    actual = dict(df.dtypes)
    schema: list[tuple[str, str, str, str]] = []
    aggs: list[Column] = []
    measured: list[tuple[str, str, Column, Column]] = []
    total = F.count("*")
    for name, rule in rules.items():
        if name not in actual:
            schema.append((name, "missing_column", rule.criticality, ""))
            continue
        if actual[name] not in rule.types:
            schema.append((name, "type_mismatch", rule.criticality, actual[name]))
        share = F.coalesce(F.count(name) * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0))
        aggs.append(share.alias(f"nn_{name}"))
        measured.append((name, "null_pct", F.col(f"nn_{name}"), F.col(f"nn_{name}") + 0.01 < rule.min_non_null_pct))
        if rule.is_date:
            other = F.count_if(date_format_class(F.col(name)) == "OTHER") / F.greatest(F.count(name), F.lit(1))
            aggs.append(other.alias(f"of_{name}"))
            measured.append((name, "format_drift", F.col(f"of_{name}"), F.col(f"of_{name}") >= max_other_share))
    item = lambda n, k, c, a: F.struct(F.lit(table).alias("table"), F.lit(n).alias("column"), F.lit(k).alias("kind"), F.lit(c).alias("criticality"), a.alias("actual"))
    found = [F.when(cond, item(n, k, rules[n].criticality, F.round(v, 4).cast("string"))) for n, k, v, cond in measured]
    found += [item(n, k, c, F.lit(a)) for n, k, c, a in schema]
    one = df.agg(*(aggs or [total.alias("n")]))
    return one.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*")


def date_format_profile(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(date_format_class(col).alias("format")).agg(F.count("*").alias("n"))


def expectations(checks: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """One row per named check: counted rows, the minimum, and whether it holds."""
    rows = [df.agg(F.lit(name).alias("check"), F.count("*").alias("n"), F.lit(low).alias("expect_min")) for name, (df, low) in checks.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("n") >= F.col("expect_min"))


def low_confidence_log(df: DataFrame, critical: Sequence[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows with low confidence or missing critical fields, one (the smallest id) per text."""
    t = dict(df.dtypes)
    lacking = lambda f: (F.col(f).isNull() | F.col(f).isin("", "null")) if t[f] == "string" else F.col(f).isNull()
    gaps = F.array_compact(F.array(*[F.when(lacking(f), F.lit(f)) for f in critical]))
    bad = df.withColumn("missing_fields", F.array_join(gaps, ",")).filter((F.col(text) != "") & ((F.col("confidence") < threshold) | (F.size(gaps) > 0))).withColumn("text_hash", F.sha2(text, 256))
    firsts = bad.groupBy("text_hash").agg(F.min("id").alias("id"))
    return bad.join(firsts, ["text_hash", "id"], "left_semi")


def drift_guarded_lift(old: DataFrame, new: DataFrame, key_fields: Sequence[str], target: float) -> DataFrame:
    """Accept a re-extraction when its confidence reaches the target, rises, and no key field
    changed (NULL, '' and 0 are the same)."""
    t = dict(old.dtypes)
    norm = lambda c, f: F.when(~missing(c, t[f]), c.cast("string"))
    n = new.select("id", *[F.col(f).alias(f"__n_{f}") for f in key_fields], F.col("confidence").alias("new_confidence"))
    j = old.join(n, "id")
    drift = F.array_compact(F.array(*[F.when(~norm(F.col(f), f).eqNullSafe(norm(F.col(f"__n_{f}"), f)), F.lit(f)) for f in key_fields]))
    verdict = F.when(F.size(drift) > 0, "drifted").when((F.col("new_confidence") >= target) & (F.col("new_confidence") > F.col("confidence")), "accepted").otherwise("no_lift")
    return j.select("id", "confidence", "new_confidence", F.array_join(drift, ",").alias("drifted_fields"), verdict.alias("verdict"))


def _present(df: DataFrame, cols: Sequence[str]) -> Column:
    t = dict(df.dtypes)
    return reduce(lambda a, b: a & b, [~missing(F.col(c), t[c]) for c in cols])


def completeness_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows for staging)."""
    ok = F.coalesce(_present(df, ["building", "area", "price", "deal_type"]) & ~F.coalesce("needs_review", F.lit(False)) & ~F.coalesce("is_audit", F.lit(False)), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def promotable(staging: DataFrame, violations: Column) -> DataFrame:
    """Staged rows whose critical fields are filled (zero bedrooms count) and break no rule."""
    return staging.filter(_present(staging, ["building", "area", "price", "deal_type"]) & F.col("bedrooms").isNotNull() & (F.size(violations) == 0))


def retry_queue(staging: DataFrame, as_of: Column, limit: int, max_attempts: int = 3, wait_minutes: int = 30) -> DataFrame:
    """Least tried, then oldest rows that may be tried again."""
    due = F.col("last_try").isNull() | (F.col("last_try") < as_of - F.expr(f"INTERVAL {wait_minutes} MINUTES"))
    return staging.filter((F.col("attempts") < max_attempts) & due).orderBy("attempts", "created_at", "id").limit(limit)


def log_signature_dedup(log: DataFrame) -> DataFrame:
    """Errors by SHA-256 of 'file:line:class' with counts and first and last sight."""
    sig = F.sha2(F.concat_ws(":", "file_path", F.col("line_no").cast("string"), "exc_class"), 256)
    return log.groupBy(sig.alias("signature")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def audit_flags(listings: DataFrame, medians: DataFrame) -> DataFrame:
    """Audit reasons per listing, joined by '; ' (NULL = clean).

    ``medians``: name, sale_median, sale_count, rent_median; names match by the staged lookup.
    """
    medians = cut_lineage(medians, "medians")  # one row per name, read twice
    hits = substring_lookup(listings, medians, "building", "name").join(medians, F.col("hit") == F.col("name")).drop("hit", "name", "stage").withColumnRenamed("value", "__k")
    j = listings.withColumn("__k", salt_nulls(F.col("building"), *listings.columns)).join(hits, "__k", "left")
    p, deal, pt = F.col("price"), F.col("deal_type"), F.col("property_type")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    no_size = F.coalesce(F.col("size_sqft"), F.lit(0)) == 0
    unpriced = ~F.coalesce(p > 0, F.lit(False))
    amount = p.cast("bigint").cast("string")
    legit_high = ["hotel", "plot", "office", "retail", "warehouse", "hotel_apartment", "serviced_apartment"]
    residential = ["apartment", "studio", "villa", "townhouse", "penthouse", "duplex"]
    sale_med = F.when(F.coalesce(F.col("sale_count"), F.lit(0)) >= 5, F.nullif(F.col("sale_median"), F.lit(0.0)))
    rent_med = F.nullif(F.col("rent_median"), F.lit(0.0))

    def off(med: Column, cond: Column, tag: str) -> Column:
        diff = F.abs(p - med) / med * 100.0
        side = F.when(p > med, "above").otherwise("below")
        return F.when(cond & (diff > 50), F.concat(F.lit(tag), diff.cast("bigint").cast("string"), F.lit("%_"), side, F.lit("_median_"), med.cast("bigint").cast("string")))

    reasons = F.array_compact(F.array(
        F.when(none("building") & unpriced & none("area"), "no_building_price_area"),
        F.when((deal == "sale") & pt.isin(*residential) & none("building") & none("area") & no_size, "residential_no_basic_info"),
        F.when((p > 500_000_000) & ~F.coalesce(pt.isin(*legit_high), F.lit(False)), F.concat(F.lit("price_too_high_"), amount)),
        F.when((deal == "sale") & (p > 0) & (p < 50_000) & ~pt.eqNullSafe("plot"), F.concat(F.lit("sale_price_too_low_"), amount)),
        F.when((deal == "rent") & (p > 5_000_000), F.concat(F.lit("rent_too_high_"), amount)),
        off(sale_med, (deal == "sale") & (p > 100_000), "bench_diff_"),
        off(rent_med, (deal == "rent") & (p > 5000), "bench_rent_diff_"),
    ))
    return j.select(*listings.columns, F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).alias("audit_reason"))


def audit_reason_counts(flagged: DataFrame) -> DataFrame:
    """Counts by the first two words of every reason."""
    r = flagged.filter(F.col("audit_reason").isNotNull()).select(F.explode(F.split("audit_reason", "; ")).alias("r"))
    return r.groupBy(F.substring_index("r", "_", 2).alias("reason")).agg(F.count("*").alias("n"))


# Building texts that are no buildings.
NOT_A_BUILDING = [
    "year", "month", "day", "week", "price", "sale", "rent", "studio", "apartment", "villa", "townhouse", "plot", "land", "unit",
    "1 bedroom", "2 bedroom", "3 bedroom", "4 bedroom", "5 bedroom", "bedroom", "available", "vacant", "furnished", "unfurnished",
    "high floor", "low floor", "mid floor", "top floor",
]


def clean_building(building: Column, area: Column) -> Column:
    """Strip advert wording, symbols and the area's own name; NULL for descriptors."""
    low = F.lower(F.trim(building))
    gone = low.isin(*NOT_A_BUILDING) | low.rlike(r"^\d+[\s\-]*(?:bedroom|bed|br|bdr|bhk)s?\b") | low.rlike(r"\b(?:plot\s+area|sqft\s+area|bua|gfa)\b")
    c = F.trim(F.split(building, "\n")[0])
    for pattern in (
        r"(?i)^(?:studio|1\s*br|2\s*br|3\s*br|4\s*br|apartment|villa|townhouse|penthouse|duplex)\s*\|\s*",
        r"(?i)^(?:apartment|studio|villa|townhouse|penthouse|duplex|office|flat|unit)\s+in\s+",
        r"(?i)^(?:for\s+sale|for\s+rent|distress\s+deal|hot\s+deal)\s*[:|\-]?\s*",
        r"(?i)^(?:below\s+op|op\s+|original\s+price|sale\s+price|distress|urgent|hot|best|new|exclusive|prime|premium|brand\s+new)\s+",
        r"^[^\p{L}\p{N}_]+",
        r"(?i)\s*[-–—]\s*plot\s*$",
        r"(?i)\s+plot\s*$",
        r"(?i)\s+(?:type|property|unit|apartment|villa|townhouse)\s*$",
        r"\s*\([^)]{3,30}\)\s*$",
    ):
        c = F.regexp_replace(c, pattern, "")
    tail = F.concat(F.lit(" - "), area)
    ends = F.coalesce(F.endswith(F.lower(c), F.lower(tail)), F.lit(False))
    c = F.when(ends, F.substring(c, F.lit(1), F.length(c) - F.length(tail))).otherwise(c)
    c = F.regexp_replace(c, r"^[ \-—–|*:,.]+|[ \-—–|*:,.]+$", "")
    return F.when(~gone & (F.length(c) >= 3), c)


def fill_empty(old: Column, new: Column) -> Column:
    """The new value only where nothing is stored."""
    return F.coalesce(F.when(F.trim(old.cast("string")) != "", old), F.when(F.trim(new.cast("string")) != "", new), old)


def repair_sweeps(df: DataFrame, families: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All bulk repairs in one projection: no bedrooms for plots, offices and shops recognised from
    the head of the text, half-bedroom counts, missing bedrooms from the text, cleaned building
    names, and the area of known building families. Columns: property_type, bedrooms, building,
    area, text."""
    head = F.lower(F.split("text", r"\n\s*\n\s*\n\s*\n|\n\s*[-—–=━]{3,}\s*\n", 2)[0])
    apartment = F.col("property_type") == "apartment"
    office = apartment & head.rlike(r"office\s*[-–—:]\s*[\d.,]+\s*sq")
    retail = apartment & head.rlike(r"\b(?:prime|premium|hot)\s+retail\b|\bretail\s+(?:unit|space|opportunity)\b")
    kind = F.when(office, "office").when(retail, "retail").otherwise(F.col("property_type"))
    half = F.regexp_extract(F.lower("text"), r"(\d)[,.]5\s*(?:bedroom|bed\b|br\b|bdr\b|bhk)", 1).try_cast("int")
    named = F.regexp_extract(head, r"(?<![\d.])(\d+)[ \t\-]*(?:bedrooms?|bdrs?|brs?|beds?|bds?)\b", 1).try_cast("int")
    homes = F.col("property_type").isin("apartment", "penthouse", "villa", "townhouse", "duplex", "studio", "hotel_apartment", "serviced_apartment")
    rooms = (
        F.when(kind.isin("plot", "whole_building", "office", "retail"), F.lit(None).cast("int"))
        .when((F.col("bedrooms") >= 5) & half.isNotNull(), half)
        .when(F.col("bedrooms").isNull() & homes & named.between(0, 15), named)
        .otherwise(F.col("bedrooms"))
    )
    building = clean_building(F.col("building"), F.col("area"))
    area = F.col("area")
    for name, members in (families or {}).items():
        in_family = reduce(lambda a, b: a | b, [F.lower(building).contains(m) for m in members])
        area = F.when(F.coalesce(in_family, F.lit(False)), F.lit(name)).otherwise(area)
    return df.withColumns({"property_type": kind, "bedrooms": rooms, "building": building, "area": area})
