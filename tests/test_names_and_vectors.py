"""Name automata and the vector index against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.operators import extract as ex
from gavel.operators import names as nm
from gavel.operators import vector_index as vi
from gavel.operators.search import text_cluster, vector_topk

rng = random.Random(5)


def brute_names(rows, keys):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for key in keys:
            k = key.split(" ")
            n = sum(words[a : a + len(k)] == k for a in range(len(words) - len(k) + 1))
            if n:
                out[i, key] = n
    return out


def name_rows():
    vocabulary = ["palm", "Tower", "tower", "The", "of", "été", "дом", "x1", "a", "b", "a-b", "o'neil"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - ", "_"]) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    keys = {" ".join(re.findall(r"[^\W_]+", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))).lower())) for _ in range(80)} | {"a", "a b", "b a", "palm tower of the"}
    return rows + [(900, None), (901, ""), (902, "palm " * 60_000)], keys


@pytest.mark.parametrize("parts", [None, 5])
def test_names_are_found(spark, parts):
    rows, keys = name_rows()
    docs = spark.createDataFrame(rows, "id int, key string").repartition(4)  # a text column with a clashing name
    names = spark.createDataFrame([(k,) for k in [*keys, ""]] * 2, "key string")
    got = nm.find_names(docs, "id", "key", names, parts=parts).collect()
    assert len(got) == len({(r.id, r.key) for r in got})
    assert {(r.id, r.key): r.mentions for r in got} == brute_names(rows, keys)


def test_names_of_whole_tables(spark, sf):
    names = spark.createDataFrame([("the and",), ("und",), ("the",)], "key string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id, r.key): r.mentions for r in nm.find_names(docs, "doc_id", "text", names).collect()}
    assert got == brute_names(rows, ["the and", "und", "the"]) != {}


def test_no_names_no_texts(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "id int, text string"), spark.createDataFrame([], "key string")
    assert nm.find_names(docs, "id", "text", none).count() == 0
    assert nm.find_names(docs.limit(0), "id", "text", spark.createDataFrame([("a",)], "key string")).count() == 0


def test_references_do_not_count(spark):
    names = spark.createDataFrame([("burj vista",)], "key string")
    cases = [("2BR in Burj Vista", 1, 0), ("view of Burj   Vista", 1, 1), ("Burj Vista view, next to the Burj Vista", 2, 2), ("near Burj Vista. Unit in burj-vista", 2, 1), ("вид на Burj Vista", 1, 1)]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, text string")
    got = {r.id: (r.mentions, r.refs) for r in nm.find_names(docs, "id", "text", names, references=True).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_area_stages(spark):
    areas = spark.createDataFrame(
        [("Jumeirah Village Circle", "Dubai", a, False) for a in ("Jumeirah Village Circle", "jv circle")] + [("Marina", "Dubai", "marina", False), ("Al Nahda", "Sharjah", "al nahda", True), ("Yas Island", "Abu Dhabi", "yas", False)],
        "area string, emirate string, alias string, ambiguous boolean")
    regions = spark.createDataFrame([("Dubai", "dubai"), ("Sharjah", "sharjah")], "area string, alias string")
    short = {"JVC": "Jumeirah Village Circle", "DM": "Marina"}
    cases = [
        ("2BR in Jumeirah Village Circle", None, ("Jumeirah Village Circle", "Dubai", 0.95)), ("studio, JV circle", None, ("Jumeirah Village Circle", "Dubai", 0.85)),
        ("2BR JVC, vacant", None, ("Jumeirah Village Circle", "Dubai", 0.45)), ("jvc", None, None), ("xJVC", None, None), ("JVC, Jumeirah Village Circle", None, ("Jumeirah Village Circle", "Dubai", 0.95)),
        ("DM or marina", None, ("Marina", "Dubai", 0.95)), ("Al Nahda", None, ("Al Nahda", None, 0.60)), ("somewhere in Sharjah", None, ("Sharjah", "Sharjah", 0.40)), ("yas, dubai", "Dubai", ("Dubai", "Dubai", 0.40)), ("yas, dubai", "Abu Dhabi", ("Yas Island", "Abu Dhabi", 0.85)), (None, None, None),
    ]
    docs = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], "id int, text string, region string")
    got = {r.id: (r.area, r.emirate, r.confidence) for r in ex.area_match(docs, "id", "text", areas, regions, short, "region").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases) if want}
    spelt = spark.createDataFrame([("Abu Dhabi", "abu dhabi", 2), ("Dubai", "dubai", 1), ("Dubai", "dxb", 1)], "region string, alias string, priority int")
    assert [(r.region, r.confidence) for r in nm.region_from_text(spark.createDataFrame([(1, "Abu  Dhabi or DXB")], "id int, text string"), "id", "text", spelt).collect()] == [("Dubai", 0.95)]


def test_building_stages(spark):
    buildings = spark.createDataFrame([("Palm Tower", "Palm", "Dubai", a) for a in ("Palm Tower", "Plm Twr One")], "building string, area string, emirate string, alias string")
    more = spark.createDataFrame([("Palm Tower", "tower of palms north"), ("Harbour Gate", "harbor gate residences")], "name string, alias string")
    cases = ["2BR in Palm Tower", "plm twr one", "tower of palm north", "Harbor Gates Residences", "nothing here at all", "Project: Sunny House\nsea"]
    docs = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = {r.id: (r.building, r.area, r.confidence) for r in ex.building_match(docs, "id", "text", buildings, spellings=more).collect()}
    assert {i: got.get(i) for i in range(5)} == {0: ("Palm Tower", "Palm", 0.95), 1: ("Palm Tower", "Palm", 0.90), 2: ("Palm Tower", "Palm", 0.82), 3: ("Harbour Gate", None, 0.75), 4: None}


# --- vector index -------------------------------------------------------------------------------


def table(spark, vectors, name, vec):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, {vec} array<double>")


def brute(items, queries, k, metric):
    out = {}
    for q, x in enumerate(queries):
        if metric == "cosine":
            s = -(items @ x) / np.sqrt((items * items).sum(1) * (x @ x))
        else:
            s = np.sqrt(((items - x) ** 2).sum(1))
        out[q] = np.lexsort((np.arange(len(items)), s))[:k].tolist()
    return out


@pytest.fixture(scope="module")
def clustered():
    gen = np.random.default_rng(2)
    centres = gen.standard_normal((60, 24)) * 4
    items = centres[gen.integers(0, 60, 6000)] + gen.standard_normal((6000, 24)) * 0.5
    return items, items[::150] + gen.standard_normal((40, 24)) * 0.2


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_clustered_vectors(spark, clustered, metric):
    items, queries = clustered
    index = vi.build_index(table(spark, items, "id", "vec"), metric, cells=60, sample_rows=3000, list_rows=150)
    assert index.sizes.sum() == len(items) and index.slices.max() > 1
    asked = table(spark, queries, "qid", "qvec")
    want = brute(items, queries, 10, metric)

    def found(rows):
        out = {}
        for r in sorted(rows.collect(), key=lambda r: (r.qid, r.position)):
            out.setdefault(r.qid, []).append(r.id)
        return out

    few = found(vi.search(index, asked, 10, probes=3))
    recall = np.mean([len(set(few[q]) & set(want[q])) / 10 for q in want])
    routes = vi._routes(index, vi.usable(asked, "qvec", metric), lambda batch, near, bound: np.arange(near.shape[1])[None, :] < 3)
    share = vi.scored_pairs(index, routes) / (len(items) * len(queries))
    assert recall >= 0.9 and share < 0.1, (recall, share)
    assert found(vi.search(index, asked, 10, probes=1, exact=True, block_queries=7)) == want
    first = vi.search(index, asked, 10, probes=3)
    more = vi.scored_pairs(index, vi.exact_routes(index, vi.usable(asked, "qvec", metric), first, 10, 3)) / (len(items) * len(queries))
    assert share + more < 0.25, (share, more)


def test_given_vectors_need_many_probes(spark):
    sf = "/root/testdata/sf0.1"
    items = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = items.filter("id % 40 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    index = vi.build_index(items, "cosine")
    want = {(r.qid, r.id) for r in vector_topk(asked, items, 10).collect()}
    got = {(r.qid, r.id) for r in vi.search(index, asked, 10, probes=int(0.6 * len(index.centres))).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {(r.qid, r.id) for r in vi.search(index, asked, 10, exact=True).collect()} == want


def test_vector_edges(spark):
    kind = "id long, vec array<double>"
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, []), (7, [2.0, 0.0]), (8, [-1.0, 0.0])]
    items = spark.createDataFrame(rows, kind)
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "qid long, qvec array<double>")
    got = [tuple(r) for r in vi.search(vi.build_index(items, cells=2), asked, 5, exact=True).orderBy("qid", "position").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 7, 1.0, 2), (1, 8, -1.0, 3)]
    assert vi.build_index(items.filter("id in (2, 3)")) is None
    assert vi.search(None, asked, 5).count() == 0
    with pytest.raises(ValueError):
        vi.build_index(items.filter("id in (1, 7)"), cells=2, sample_rows=2, metric="dot")


def test_texts_are_cut_into_words_once(spark):
    """Fitting and the result of ``text_cluster`` read term counts, so neither reads the texts again."""
    docs = spark.createDataFrame([(i, f"{w} house {w} garden {w}") for i, w in enumerate(["red", "blue", "green"] * 10)], "id bigint, t string")
    out = text_cluster(docs, "t", "id", k=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "LogicalRDD" not in plan
    labels = {}
    for r in out.collect():
        labels.setdefault(r.id % 3, set()).add(r.cluster_id)
    assert all(len(v) == 1 for v in labels.values()) and len(set.union(*labels.values())) == 3
