"""Duplicate detection, record merging and row-order operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.exprs import half_even
from gavel.functions.scale import gap_sessions, null_safe_join, salt_nulls, split_lag, top_n
from gavel.functions.similarity import trigram_pairs
from gavel.session import cut_lineage


def flag_repeats(df: DataFrame, keys: Sequence[str], row_id: str, keep: str = "newest", flag: str = "is_dup") -> DataFrame:
    """Flag every row of a key group but the newest (or oldest) one.

    The surviving id is a map-side aggregate; rows get it by an equi-join, so a group that
    owns a third of the table is never sorted in one task.
    """
    pick = F.max(row_id) if keep == "newest" else F.min(row_id)
    survivors = df.groupBy(*keys).agg(pick.alias("__keep"))
    return null_safe_join(df, survivors, keys).withColumn(flag, F.col(row_id) != F.col("__keep")).withColumnRenamed("__keep", "keep_id")


def spam_pattern_groups(df: DataFrame, broker: Column, min_copies: int = 10, max_brokers: int = 2, max_days: float = 7) -> DataFrame:
    """(building, price) groups posted often, by few brokers, in a short span."""
    span = (F.unix_micros(F.max("created_at").cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 8.64e10
    return (
        df.filter(F.col("building").isNotNull() & F.col("price").isNotNull())
        .groupBy(F.lower("building").alias("building"), "price")
        .agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(broker).alias("brokers"), span.alias("span_days"))
        .filter((F.col("copies") >= min_copies) & (F.col("brokers") <= max_brokers) & (F.col("span_days") <= max_days))
    )


def autobot_groups(
    df: DataFrame, broker: Column, whitelist: DataFrame | None = None, min_rows: int = 150, strict: bool = True, max_diversity_pct: float = 30
) -> DataFrame:
    """Brokers with many adverts of few distinct (building, price) objects.

    ``strict`` asks for more than ``min_rows`` (nightly sweep), else at least (write gate). An
    object with a NULL part is no object; the whitelist is an anti-join on the broker.
    """
    rows = df.withColumn("broker", F.lower(broker)).filter(F.length("broker") > 3)
    if whitelist is not None:
        rows = rows.join(whitelist.select(F.lower("broker").alias("broker")).distinct(), "broker", "left_anti")
    thing = F.concat(F.col("building"), F.col("price").cast("string"))
    out = rows.groupBy("broker").agg(F.count(F.lit(1)).alias("total"), F.count_distinct(thing).alias("unique_objects"))
    enough = F.col("total") > min_rows if strict else F.col("total") >= min_rows
    return out.filter(enough & (100.0 * F.col("unique_objects") / F.col("total") < max_diversity_pct))


def fingerprint(url: Column | str) -> Column:
    """First 16 hex digits of the SHA-1 of a file or page address; NULL when empty."""
    c = F.col(url) if isinstance(url, str) else url
    return F.when(F.length(c) > 0, F.substring(F.sha1(c), 1, 16))


def content_hash(text: Column | str, prefix: int | None = None) -> Column:
    """SHA-256 of the lower-cased text without punctuation, blanks collapsed; NULL when fewer
    than 30 characters remain. ``prefix`` hashes only so many characters of that key."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    key = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))
    key = key if prefix is None else F.substring(key, 1, prefix)
    return F.when(F.length(key) >= 30, F.sha2(key, 256))


def text_signature(text: Column | str, prefix: int | None = None) -> Column:
    """Blank-collapsed text, NULL when it has 50 characters or fewer. ``prefix`` looks at only so
    many characters of the text."""
    c = F.col(text) if isinstance(text, str) else text
    sig = F.trim(F.regexp_replace(c if prefix is None else F.substring(c, 1, prefix), r"\s+", " "))
    return F.when(F.length(sig) > 50, sig)


def listing_key(parts: Mapping[str, Column], bedrooms: Column, size: Column, price: Column, floor: Column) -> Column:
    """Pipe-joined non-empty parts with size cut to whole units and price to thousands;
    NULL when neither area nor building is known. Zero bedrooms or floor leave no part."""
    squeezed = {k: F.nullif(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")), F.lit("")) for k, c in parts.items()}
    whole = lambda c, by=1: F.coalesce((c.cast("double") / by).cast("bigint"), F.lit(0)).cast("string")
    num = lambda c: F.when(c != 0, c.cast("string"))
    known = F.coalesce(squeezed["area"], squeezed["building"]).isNotNull()
    return F.when(known, F.concat_ws("|", *squeezed.values(), num(bedrooms), whole(size), whole(price, 1000), num(floor)))


def missing(c: Column, dtype: str) -> Column:
    """NULL, empty text or zero count as missing."""
    if dtype == "string":
        return c.isNull() | (c == "")
    if dtype in ("boolean", "date", "timestamp", "timestamp_ntz"):
        return c.isNull()
    return c.isNull() | (c == 0)


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def record_score(df: DataFrame, fields: Sequence[str]) -> Column:
    """10·confidence + 2·filled fields + years since 1970 of the creation time."""
    t = _types(df)
    filled = reduce(lambda a, b: a + b, [F.when(missing(F.col(f), t[f]), 0).otherwise(1) for f in fields])
    years = F.unix_seconds(F.col("created_at").cast("timestamp")) / 86400.0 / 365.0
    return F.coalesce(F.col("confidence_score"), F.lit(0.0)) * 10.0 + filled * 2.0 + F.coalesce(years, F.lit(0.0))


def _resolve(df: DataFrame, key: str, fields: Sequence[str], leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winner with filled fields, and losers, per group key (groups of two or more)."""
    t = _types(df)
    order = F.struct(F.col("__score"), -F.col("id"))
    merged = [F.max_by(F.when(~missing(F.col(f), t[f]), F.col(f)), F.when(~missing(F.col(f), t[f]), order)).alias(f) for f in fields]
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.max_by("id", order).alias("winner_id"), *merged).filter(F.col("group_size") >= 2)
    losers = (
        df.select("id", key).join(groups.select(key, "winner_id"), key).filter(F.col("id") != F.col("winner_id"))
        .join(leads.select(F.col("listing_id").alias("id")).distinct(), "id", "left_anti")
        .select("id", F.concat(F.lit("dup_of:"), F.col("winner_id").cast("string")).alias("review_reason"), "winner_id")
    )
    return groups, losers


def cross_source_resolve(df: DataFrame, fields: Sequence[str], leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve the same object across sources: photo groups first, then (area, building,
    bedrooms, price in 100k steps) among rows outside photo groups.

    Returns (winners with the gaps filled from the best losers, losers to deactivate). Rows
    that have leads are never deactivated. All picks are map-side ``max_by`` aggregates.
    """
    scored = df.withColumn("__score", record_score(df, fields))
    photo = scored.filter(F.col("photo_phash") != "").withColumn("group_key", F.concat(F.lit("photo:"), "photo_phash"))
    sizes = photo.groupBy("photo_phash").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= 2)
    in_photo = photo.join(sizes, "photo_phash", "left_semi").select("id")
    combo = (
        scored.join(in_photo, "id", "left_anti")
        .filter((F.trim("area") != "") & (F.trim("building") != "") & F.col("bedrooms").isNotNull() & (F.col("price") > 0))
        .withColumn("group_key", F.concat_ws("|", F.lower(F.trim("area")), F.lower(F.trim("building")), "bedrooms", F.round(F.col("price") / 100000.0).cast("bigint").cast("string")))
    )
    both = photo.unionByName(combo)
    return _resolve(both, "group_key", fields, leads)


def ingest_cascade(batch: DataFrame, store: DataFrame, signals: Mapping[str, Column | Sequence[str]], row_id: str = "id") -> DataFrame:
    """First matching signal decides: each batch row gets the stored row it repeats, or the
    earliest row of the batch with the same signal value, and the name of the signal.

    ``signals`` is in priority order; a NULL signal value never matches.
    """
    out = batch
    for i, (name, expr) in enumerate(signals.items()):
        col = expr if isinstance(expr, Column) else F.concat_ws("\u001f", *expr)
        stored = store.select(col.alias("__k"), F.col(row_id).alias("__hit")).filter(F.col("__k").isNotNull()).groupBy("__k").agg(F.min("__hit").alias(f"__s{i}"))
        inside = batch.select(col.alias("__k"), F.col(row_id).alias("__hit")).filter(F.col("__k").isNotNull()).groupBy("__k").agg(F.min("__hit").alias(f"__b{i}"))
        known = stored.join(inside, "__k", "full_outer")
        out = out.withColumn("__k", salt_nulls(col, row_id)).join(known, "__k", "left").drop("__k")
        own = F.when(F.col(f"__b{i}") < F.col(row_id), F.col(f"__b{i}"))
        out = out.withColumn(f"__m{i}", F.coalesce(f"__s{i}", own)).drop(f"__s{i}", f"__b{i}")
    marks = [F.when(F.col(f"__m{i}").isNotNull(), F.struct(F.lit(n).alias("signal"), F.col(f"__m{i}").alias("duplicate_of"))) for i, n in enumerate(signals)]
    hit = F.coalesce(*marks)
    return out.select(*batch.columns, hit["signal"].alias("signal"), hit["duplicate_of"].alias("duplicate_of"))


def semantic_repost(new: DataFrame, store: DataFrame) -> DataFrame:
    """New adverts that repeat a stored one (seller, building, area, equal size) without a
    price drop. The newest active stored row is compared."""
    sizes = F.array_distinct(F.array_compact(F.array("size_sqft", "bua_sqft")))
    key = ["seller", "building", "area", "__size"]
    by_size = store.filter(F.col("is_active")).withColumn("__size", F.explode(sizes))
    newest = by_size.groupBy(*key).agg(F.max_by(F.struct(F.col("id").alias("old_id"), F.col("price").alias("old_price")), F.struct("created_at", "id")).alias("__o"))
    size = F.coalesce(F.nullif("size_sqft", F.lit(0.0)), F.nullif("bua_sqft", F.lit(0.0)))
    hits = new.withColumn("__size", size).join(newest, key)
    p, o = F.coalesce("price", F.lit(0.0)), F.coalesce(F.col("__o.old_price"), F.lit(0.0))
    return hits.filter((p == 0) | (o == 0) | (p >= o)).select("id", F.col("__o.old_id").alias("repost_of"))


# ---- message merge -------------------------------------------------------------------

MERGE_KEYS = ("price", "area", "building", "bedrooms")


def message_groups(df: DataFrame, window_s: int = 120) -> DataFrame:
    """Candidate groups: blocks of one message, and chains of messages by one author in one
    chat at most ``window_s`` apart. A repeated message id breaks a chain."""
    chain = gap_sessions(df, ["chat", "author"], "ts", "id", window_s, same_breaks="message_id").withColumn(
        "group_key", F.concat_ws("|", F.lit("time"), "chat", "author", F.col("session_first").cast("string"))
    )
    by_message = df.withColumn("group_key", F.concat_ws("|", F.lit("msg"), "chat", F.col("message_id").cast("string")))
    return by_message.unionByName(chain.select(*by_message.columns))


def compatible_components(df: DataFrame, group: str = "group_key") -> DataFrame:
    """Sets of mutually compatible rows per group (label ``component``), others dropped.

    Two rows are compatible when their filled key fields agree and they share a filled field
    or one of them has text. A connected set only counts when *all* its pairs are compatible.
    No pair is ever formed: rows are keyed by which fields are filled (16 masks × text), each
    row looks up the counts and value ranges of the rows that agree with it mask by mask, and a
    set is valid when every member sees the same merged record and exactly the set's size.
    Only masks that its group has are looked up; a row alone in its group makes no set.
    """
    filled = {
        "price": F.col("price").isNotNull() & (F.col("price") != 0),
        "area": F.col("area") != "",
        "building": F.col("building") != "",
        "bedrooms": F.col("bedrooms").isNotNull(),
    }
    value = {
        "price": F.col("price").cast("string"), "area": F.lower(F.trim("area")),
        "building": F.lower(F.trim("building")), "bedrooms": F.col("bedrooms").cast("string"),
    }
    mask = reduce(lambda a, b: a + b, [F.when(F.coalesce(filled[k], F.lit(False)), 1 << i).otherwise(0) for i, k in enumerate(MERGE_KEYS)])
    values = [F.when(F.coalesce(filled[k], F.lit(False)), value[k]).alias(f"__v{i}") for i, k in enumerate(MERGE_KEYS)]
    has_text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    base = df.select("id", group, mask.alias("__mask"), has_text.alias("__text"), *values)
    shape = F.struct(F.col("__mask").alias("m"), F.col("__text").alias("t"))
    present = base.groupBy(group).agg(F.count(F.lit(1)).alias("__rows"), F.collect_set(shape).alias("__shapes")).filter(F.col("__rows") > 1)
    base = base.join(present.drop("__rows"), group)

    def sub_key(bits: Column) -> Column:
        pieces = [F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.col(f"__v{i}")).otherwise("*") for i in range(4)]
        return F.concat_ws("\u001f", *pieces)

    subsets = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda s: s.bitwiseAND(F.col("__mask")) == s)
    table = (
        base.select(group, F.col("__mask").alias("__om"), F.col("__text").alias("__ot"), "__v0", "__v1", "__v2", "__v3", F.explode(subsets).alias("__s"))
        .withColumn("__k", sub_key(F.col("__s")))
        .groupBy(group, "__om", "__ot", "__s", "__k")
        .agg(F.count(F.lit(1)).alias("__n"), *[f(f"__v{i}").alias(f"__{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max))])
    )
    probes = (
        base.select("id", group, "__mask", "__text", "__v0", "__v1", "__v2", "__v3", F.explode("__shapes").alias("o"))
        .withColumn("__s", F.col("__mask").bitwiseAND(F.col("o.m")))
        .filter((F.col("__s") != 0) | F.col("__text") | F.col("o.t"))
        .select(
            "id", group, F.when((F.col("__mask") == 0) & ~F.col("__text"), 1).otherwise(0).alias("__self"),
            F.col("o.m").alias("__om"), F.col("o.t").alias("__ot"), "__s", sub_key(F.col("__s")).alias("__k"))
    )
    seen = probes.join(table, [group, "__om", "__ot", "__s", "__k"]).groupBy("id", group).agg(
        (F.sum("__n") + F.max("__self")).alias("__seen"), *[f(f"__{n}{i}").alias(f"__{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    agree = reduce(lambda a, b: a & b, [F.col(f"__lo{i}").eqNullSafe(F.col(f"__hi{i}")) for i in range(4)])
    label = F.concat_ws("\u001f", F.col(group), *[F.coalesce(F.col(f"__lo{i}"), F.lit("*")) for i in range(4)])
    good = seen.filter(agree).select("id", group, "__seen", label.alias("component"))
    sizes = good.groupBy("component").agg(F.count(F.lit(1)).alias("__size"), F.min("__seen").alias("__min"), F.max("__seen").alias("__max"))
    valid = sizes.filter((F.col("__size") >= 2) & (F.col("__min") == F.col("__size")) & (F.col("__max") == F.col("__size"))).select("component", F.col("__size").alias("size"))
    return df.join(good.select("id", group, "component").join(valid, "component"), ["id", group])


def message_merge(df: DataFrame, fill: Sequence[str], window_s: int = 120) -> tuple[DataFrame, DataFrame]:
    """Merge fragments of one advert that were posted as several messages or blocks.

    Input columns: id, chat, author, message_id, ts, text, blocks_in_message, price, area,
    building, bedrooms, size_sqft, floor, unit, has_images. Returns (merged records, one row
    per primary; text parts in order, one row per distinct text). Steps before the last see the lengths of a text and
    whether it is null, empty or blank; only members of merged sets get theirs back.
    """
    t = _types(df)
    trimmed = F.trim(F.coalesce("text", F.lit("")))
    stand_in = F.when(F.length(trimmed) > 0, "x").otherwise(F.substring("text", 1, 1))
    slim = df.withColumn("__length", F.length(F.coalesce("text", F.lit("")))).withColumn("__trimmed", F.length(trimmed)).withColumn("text", stand_in)
    groups = cut_lineage(message_groups(cut_lineage(slim, "parts"), window_s), "groups")
    comp = cut_lineage(compatible_components(groups), "components")
    complete = (F.coalesce(F.col("area"), F.lit("")) != "") & F.col("price").isNotNull() & F.col("bedrooms").isNotNull() & (F.coalesce(F.col("building"), F.lit("")) != "")
    order = F.struct("ts", "id")
    real = lambda f: F.when(~missing(F.col(f), t[f]), F.col(f))
    keep = lambda f: F.col(f) if f == "bedrooms" else real(f)
    has_price = F.coalesce(F.col("price") != 0, F.lit(False))
    header = (F.col("area") != "") & (F.coalesce(F.col("building"), F.lit("")) == "") & ~has_price
    detail = (F.coalesce(F.col("building"), F.lit("")) != "") & has_price
    rank = F.struct("__length", F.when(F.col("price").isNotNull(), 1).otherwise(0), -F.col("id"))
    n = F.count(F.lit(1))
    mixed = lambda f: (F.count(real(f)) > 0) & (F.count(real(f)) < n)
    useful = reduce(lambda a, b: a | b, [mixed(f) for f in ("area", "price", "building", "bedrooms", "size_sqft", "text")])
    firsts = [F.min_by(real(f), F.when(real(f).isNotNull(), order)).alias(f"__fill_{f}") for f in fill]
    primaries = [F.max_by(keep(f), rank).alias(f"__own_{f}") for f in fill]
    g = comp.groupBy("component").agg(
        n.alias("parts"),
        F.max_by("id", rank).alias("primary_id"),
        F.bool_and(complete).alias("__all_complete"),
        (F.bool_or(complete) | useful).alias("__useful"),
        (F.coalesce(F.count_distinct(real("size_sqft")) <= 1, F.lit(True)) & (F.count_distinct(real("floor")) <= 1) & (F.count_distinct(real("unit")) <= 1)).alias("__same_unit"),
        (F.bool_or(F.col("__trimmed") >= 50) & F.bool_or(F.col("__trimmed") < 20)).alias("__rich_poor"),
        ((F.count_distinct("message_id") == 1) & (n == 2) & F.bool_and(F.col("blocks_in_message") == 2) & F.bool_or(header) & F.bool_or(detail)).alias("__header_detail"),
        F.bool_or("has_images").alias("has_images"),
        *firsts, *primaries,
    )
    ok = g.filter(~F.col("__all_complete") & F.col("__same_unit") & F.col("__useful") & (F.col("__rich_poor") | F.coalesce("__header_detail", F.lit(False))))
    # A record can lead a block group and a time chain: blocks of one message go first.
    ok = top_n(ok, ["primary_id"], [F.col("component")], 1)
    merged = ok.select(
        "component", "primary_id", "parts", "has_images", *[F.coalesce(f"__own_{f}", f"__fill_{f}").alias(f) for f in fill])
    members = comp.filter(F.col("__trimmed") > 0).select("component", "id", "ts").join(ok.select("component", "primary_id"), "component").drop("component")
    texts = (
        df.select("id", trimmed.alias("text")).join(members, "id")
        .groupBy("primary_id", "text").agg(F.min(order).alias("__o")).select("primary_id", F.col("__o.ts").alias("ts"), F.col("__o.id").alias("first_id"), "text")
    )
    return merged, texts


# ---- ordered operators ----------------------------------------------------------------


def deal_gaps(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Number of deals and mean days between consecutive deals. The gaps of a sorted series add
    up to its span, so no sort is needed: mean = (last − first)/(n − 1)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("deals"), (F.datediff(F.max(date), F.min(date)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("avg_days_between"))


def pct_change_flags(series: DataFrame, keys: Sequence[str], period: str, value: str, threshold: float = 0.10, yoy_points: int = 12) -> DataFrame:
    """Period-on-period change with jump flag, and change against ``yoy_points`` − 1 points back
    (or the first point). Input: one row per key and period."""
    w = Window.partitionBy(*keys).orderBy(period)
    prev = F.lag(value).over(w)
    base = F.coalesce(F.lag(value, yoy_points - 1).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.when(prev > 0, (F.col(value) - prev) / prev)
    return series.withColumn("change", change).withColumn("is_jump", F.coalesce(F.abs("change") >= threshold, F.lit(False))).withColumn(
        "yoy_pct", F.when((base > 0) & prev.isNotNull(), (F.col(value) - base) / base * 100.0))


def streak(df: DataFrame, keys: Sequence[str], order: str, good: Column, name: str = "streak") -> DataFrame:
    """Length of the run of good rows that ends at the newest row of each key: rows after the
    last row that is not good. Two aggregates, no ordered window."""
    marked = df.withColumn("__good", F.coalesce(good, F.lit(False)))
    last_bad = marked.groupBy(*keys).agg(F.max(F.when(~F.col("__good"), F.col(order))).alias("__bad"))
    joined = null_safe_join(marked, last_bad, keys)
    return joined.groupBy(*keys).agg(F.count_if(F.col("__bad").isNull() | (F.col(order) > F.col("__bad"))).alias(name))


def diversified_topn(examples: DataFrame, text_len: int, kind: str, n: int, pool: int = 30) -> DataFrame:
    """Up to ``n`` examples nearest in text length, then newest, at most one per building and,
    once two price buckets are in, one per bucket. Input: id, text, kind, building, price,
    created_at. The pool is bounded, so the greedy choice runs as one array fold."""
    near = (
        examples.filter((F.col("kind") == kind) | F.col("kind").isNull())
        .withColumn("len_diff", F.abs(F.length("text") - text_len))
        .orderBy("len_diff", F.col("created_at").desc(), F.col("id").desc()).limit(pool)
    )
    bucket = F.when(F.col("price") < 1_000_000, 0).when(F.col("price") < 3_000_000, 1).when(F.col("price") < 10_000_000, 2).otherwise(3)
    item = F.struct("len_diff", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), (-F.col("id")).alias("nid"),
                    F.lower(F.trim(F.coalesce("building", F.lit("")))).alias("b"), bucket.alias("p"))
    folded = near.agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.struct(F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("bs"), F.array().cast("array<int>").alias("ps"))

    def step(acc: Column, x: Column) -> Column:
        clash = ((x["b"] != "") & F.array_contains(acc["bs"], x["b"])) | (F.array_contains(acc["ps"], x["p"]) & (F.size(acc["ps"]) >= 2))
        taken = F.struct(
            F.array_append(acc["ids"], -x["nid"]).alias("ids"),
            F.when(x["b"] != "", F.array_append(acc["bs"], x["b"])).otherwise(acc["bs"]).alias("bs"),
            F.array_union(acc["ps"], F.array(x["p"])).alias("ps"),
        )
        return F.when(clash | (F.size(acc["ids"]) >= n), acc).otherwise(taken)

    picked = folded.select(F.posexplode(F.aggregate("items", empty, step)["ids"]).alias("pos", "id"))
    return picked.select((F.col("pos") + 1).alias("rank"), "id")


def stratified_sample(df: DataFrame, tier: Column, row_id: str, per_tier: int, seed: str) -> DataFrame:
    """The same quota from every tier in a seeded hash order (repeatable, not clock-bound)."""
    tagged = df.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    order = F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string")))
    return top_n(tagged, ["tier"], [order, F.col(row_id)], per_tier)


def price_history_diff(history: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Price changes per key: old and new price, drop amount and percent, drop flag."""
    lagged = split_lag(history, [key], ts, tie, ["price"], "old_", "month")
    changed = lagged.filter((F.col("price") != 0) & (F.col("old_price") != 0) & (F.col("price") != F.col("old_price")))
    drop = F.col("old_price") - F.col("price")
    return changed.withColumn("discount_amount", F.abs(drop)).withColumn(
        "discount_percent", F.abs(half_even(drop / F.col("old_price") * 100.0, 1))).withColumn("price_drop_detected", drop > 0)


def near_dup_merge(facts: DataFrame, threshold: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """Greedy near-duplicate merge of facts within (user, type), in id order.

    A fact is kept unless an earlier kept one is similar (trigram Jaccard ≥ threshold), else it
    is superseded by the earliest such fact. Equal texts collapse first; similar pairs come from
    an exact prefix-filter join; keep/supersede is settled in rounds (a fact is settled once all
    its earlier neighbours are), with lineage cut per round. Returns (kept, superseded).
    """
    keys = ["user_id", "fact_type"]
    firsts = facts.groupBy(*keys, "fact_text").agg(F.min("id").alias("first_id"))
    pairs = trigram_pairs(firsts, "fact_text", firsts, "fact_text", threshold, keys).filter(F.col("a") != F.col("b"))  # within a user and type
    left = firsts.select(*keys, F.col("fact_text").alias("a"), F.col("first_id").alias("x"))
    right = firsts.select(*keys, F.col("fact_text").alias("b"), F.col("first_id").alias("y"))
    edges = cut_lineage(pairs.join(left, [*keys, "a"]).join(right, [*keys, "b"]).filter(F.col("x") < F.col("y")).select("x", "y").distinct(), "edges")
    nodes = edges.select(F.col("y").alias("id")).distinct()
    settled = edges.select(F.col("x").alias("id")).distinct().join(nodes, "id", "left_anti").withColumn("kept", F.lit(True))
    settled = cut_lineage(settled, "settled")
    while True:
        open_nodes = nodes.join(settled, "id", "left_anti")
        view = edges.join(open_nodes.withColumnRenamed("id", "y"), "y").join(settled.withColumnRenamed("id", "x"), "x", "left")
        state = view.groupBy(F.col("y").alias("id")).agg(
            F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_and(F.col("kept").isNotNull()).alias("known"))
        fresh = state.filter(F.col("hit") | F.col("known")).select("id", (~F.col("hit")).alias("kept"))
        fresh = cut_lineage(fresh, "round")
        if fresh.isEmpty():
            break
        settled = cut_lineage(settled.unionByName(fresh), "settled")
    losers = settled.filter(~F.col("kept")).select(F.col("id").alias("y"))
    winners = settled.filter(F.col("kept")).select(F.col("id").alias("x"))
    into = edges.join(losers, "y").join(winners, "x").groupBy(F.col("y").alias("first_id")).agg(F.min("x").alias("__into"))
    rows = null_safe_join(facts, firsts.join(into, "first_id", "left"), [*keys, "fact_text"])
    target = F.coalesce("__into", F.when(F.col("id") != F.col("first_id"), F.col("first_id")))
    rows = rows.withColumn("superseded_by", target).drop("first_id", "__into")
    gone = rows.filter(F.col("superseded_by").isNotNull())
    boost = gone.groupBy(F.col("superseded_by").alias("id")).agg(F.max("confidence").alias("__c"), F.sum("reference_count").alias("__r"))
    kept = (
        rows.filter(F.col("superseded_by").isNull()).join(boost, "id", "left")
        .withColumn("confidence", F.when(F.col("__c").isNull(), F.col("confidence")).otherwise(F.least(F.lit(1.0), F.greatest("confidence", "__c") + 0.05)))
        .withColumn("reference_count", F.col("reference_count") + F.coalesce("__r", F.lit(0))).drop("__c", "__r", "superseded_by")
    )
    return kept, gone


def decay_and_prune(facts: DataFrame, as_of: Column, stale_days: int = 30, step: float = 0.05, floor: float = 0.05, prune_days: int = 60, prune_below: float = 0.1) -> DataFrame:
    """Lower the confidence of facts unused for a month, then drop old ones that nobody believes."""
    stale = F.col("last_referenced") < as_of - F.expr(f"INTERVAL {stale_days} DAYS")
    decayed = facts.withColumn("confidence", F.when(stale, F.greatest(F.lit(floor), F.col("confidence") - step)).otherwise(F.col("confidence")))
    return decayed.filter(~((F.col("confidence") < prune_below) & (F.col("created_at") < as_of - F.expr(f"INTERVAL {prune_days} DAYS"))))
