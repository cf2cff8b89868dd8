"""String similarity expressions and exact candidate joins that avoid all-pairs work."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gavel.functions.exprs import bind
from gavel.session import cut_lineage


def ngrams(col: Column | str, n: int) -> Column:
    """Distinct character n-grams; a shorter text is its own single gram."""
    c = F.col(col) if isinstance(col, str) else col

    def cut(t: Column) -> Column:
        last = F.greatest(F.length(t) - n + 1, F.lit(1))
        return F.when(F.length(t) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.lit(n)))))

    return bind(c, cut)


def word_trigrams(col: Column | str) -> Column:
    """Trigram set of a text: lower-case alphanumeric words, two blanks before, one after."""
    c = F.col(col) if isinstance(col, str) else col
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Size of the intersection over the size of the union of two sets; 0 when both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.col(a) if isinstance(a, str) else a) + F.size(F.col(b) if isinstance(b, str) else b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(word_trigrams(a), word_trigrams(b))


def token_sort(col: Column | str) -> Column:
    """Words in alphabetical order, single blanks."""
    c = F.col(col) if isinstance(col, str) else col
    words = F.filter(F.split(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.array_join(F.sort_array(words), " ")


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """100 · (1 − edit distance / longer length)."""
    ca, cb = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    longest = F.greatest(F.length(ca), F.length(cb))
    return F.when(longest > 0, 100.0 * (1 - F.levenshtein(ca, cb) / longest)).otherwise(100.0)


def containment_pairs(needles: DataFrame, needle: str, hay: DataFrame, text: str, n: int = 3) -> DataFrame:
    """Distinct (needle, text) pairs with ``needle`` inside ``text``; exact, no cross join.

    A contained needle brings all its n-grams along, so each needle is looked up only by
    its rarest n-gram in the texts; needles shorter than ``n`` use grams of their length.
    """
    nd = needles.select(F.col(needle).alias("needle")).filter(F.length("needle") > 0).distinct()
    tx = hay.select(F.col(text).alias("text")).filter(F.length("text") > 0).distinct()
    sizes = range(1, n + 1)
    text_grams = F.array_distinct(F.concat(*[ngrams("text", k) for k in sizes]))
    index = tx.select("text", F.explode(text_grams).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("__df"))
    probes = (
        nd.select("needle", F.explode(ngrams("needle", n)).alias("gram"))
        .join(frequency, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("__df", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    return probes.join(index, "gram").filter(F.contains("text", "needle")).select("needle", "text")


def overlap_candidates(
    left: DataFrame, a: str, ga: str, right: DataFrame, b: str, gb: str, share: float, common: float, block: Sequence[str] = ()
) -> DataFrame:
    """Distinct (block, a, b) whose token sets may have ``share`` of each set, and ``common`` of both sizes together, in common; complete.

    Prefix filter: with tokens in rare-first order, two sets can only reach the overlap when
    their first ``|x| − ⌈share·|x|⌉ + 1`` tokens meet, so frequent tokens are never joined on. Length bands: sizes must agree within
    ``share``. Position filter: what two sets have in common is at most one token more than stands behind their first meeting in
    either, and at most the meetings plus what stands behind the last. Only rows of one ``block`` (columns of both sides) meet.
    """
    block = list(block)
    freq = (
        left.select(F.explode(ga).alias("g")).unionByName(right.select(F.explode(gb).alias("g")))
        .groupBy("g").agg(F.count(F.lit(1)).alias("__df"))
    )

    def prefixes(df: DataFrame, key: str, grams: str) -> DataFrame:
        sets = df.select(*block, key, F.size(grams).alias("__n"), F.explode(grams).alias("g")).join(freq, "g")
        ordered = sets.groupBy(*block, key, "__n").agg(F.sort_array(F.collect_list(F.struct("__df", "g"))).alias("__o"))
        keep = (F.col("__n") - F.ceil(F.col("__n") * F.lit(share) - 1e-9) + 1).cast("int")
        first = F.slice("__o", F.lit(1), F.greatest(keep, F.lit(1)))
        placed = ordered.select(*block, key, F.col("__n").alias(f"__n_{key}"), F.posexplode(first).alias("__i", "p"))
        return placed.select(*block, key, f"__n_{key}", F.col("p.g").alias("g"), (F.col("__i") + 1).alias(f"__i_{key}"))

    na, nb, ia, ib = (F.col(c) for c in (f"__n_{a}", f"__n_{b}", f"__i_{a}", f"__i_{b}"))
    need = F.greatest(F.greatest(na, nb) * F.lit(share), (na + nb) * F.lit(common)) - 1e-9
    fits = F.least(na, nb) >= F.greatest(na, nb) * F.lit(share) - 1e-9
    met = prefixes(left, a, ga).join(prefixes(right, b, gb), [*block, "g"]).filter(fits & (1 + F.least(na - ia, nb - ib) >= need))
    pairs = met.groupBy(*block, a, b, f"__n_{a}", f"__n_{b}").agg(F.count(F.lit(1)).alias("__c"), F.max(ia).alias(f"__i_{a}"), F.max(ib).alias(f"__i_{b}"))
    return pairs.filter(F.col("__c") + F.least(na - ia, nb - ib) >= need).select(*block, a, b)


def trigram_candidates(left: DataFrame, a: str, right: DataFrame, b: str, threshold: float, block: Sequence[str] = ()) -> DataFrame:
    la = left.select(*block, F.col(a).alias("a")).distinct().withColumn("ga", word_trigrams("a")).filter(F.size("ga") > 0)
    rb = right.select(*block, F.col(b).alias("b")).distinct().withColumn("gb", word_trigrams("b")).filter(F.size("gb") > 0)
    return overlap_candidates(la, "a", "ga", rb, "b", "gb", threshold, threshold / (1 + threshold), block)


def trigram_pairs(left: DataFrame, a: str, right: DataFrame, b: str, threshold: float, block: Sequence[str] = ()) -> DataFrame:
    """Distinct (block, a, b) text pairs with trigram Jaccard ≥ ``threshold``; exact. Rows without a ``block`` value meet no other."""
    pairs = trigram_candidates(left, a, right, b, threshold, block).withColumn("similarity", trigram_similarity("a", "b"))
    return pairs.filter(F.col("similarity") >= threshold).select(*block, "a", "b", "similarity")


def char_bag(col: Column | str) -> Column:
    """Characters with their occurrence number ('a1', 'a2', …), a set that keeps multiplicity."""
    c = F.col(col) if isinstance(col, str) else col
    return bind(
        F.sort_array(F.split(c, "")), lambda chars: F.transform(chars, lambda x, i: F.concat(x, (i - F.array_position(chars, x) + 2).cast("string"))))


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 · 2·LCS/(|a|+|b|): share of characters kept when only inserting and deleting."""

    def one(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        row = np.zeros(len(y) + 1, dtype=np.int32)
        codes = np.frombuffer(y.encode("utf-32-le"), dtype=np.uint32)
        for ch in x:
            hit = row[:-1] + (codes == ord(ch))
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
        return 200.0 * int(row[-1]) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def fuzzy_pairs(left: DataFrame, a: str, right: DataFrame, b: str, cutoff: float) -> DataFrame:
    """Distinct pairs whose token-sorted texts reach ``cutoff`` (0–100) by :func:`lcs_ratio`.

    The kept characters are common to both character bags, which gives a complete candidate
    join; only candidates are scored.
    """
    t = cutoff / 100.0
    # written once, before the filter: it would move in front of the distinct and sort the tokens of every row
    la = cut_lineage(left.select(F.col(a).alias("a")).distinct().withColumn("sa", token_sort("a")).withColumn("ga", char_bag("sa")), "texts").filter(F.length("sa") > 0)
    rb = right.select(F.col(b).alias("b")).distinct().withColumn("sb", token_sort("b")).filter(F.length("sb") > 0).withColumn("gb", char_bag("sb"))
    pairs = overlap_candidates(la, "a", "ga", rb, "b", "gb", t / (2 - t), t / 2)
    # The bags bound the kept characters from above: most candidates end here, before Python.
    sorted_texts = pairs.withColumn("sa", token_sort("a")).withColumn("sb", token_sort("b"))
    common = F.size(F.array_intersect(char_bag("sa"), char_bag("sb")))
    close = sorted_texts.filter(2.0 * common >= t * (F.length("sa") + F.length("sb")) - 1e-9)
    return close.withColumn("score", lcs_ratio("sa", "sb")).filter(F.col("score") >= cutoff).select("a", "b", "score")
