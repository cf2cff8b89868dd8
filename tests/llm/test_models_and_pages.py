"""Toxicity, nearest neighbours, page text, registered queries and the pipeline."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.llm import ann, html_text, queries, toxicity


@pytest.fixture(scope="module")
def marked(spark):
    gen = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("ba", "do", "ki", "lu") for b in ("ne", "ra", "so", "ti", "mu")]
    docs, labels = [], []
    for i in range(400):
        words = gen.choice(plain, int(gen.integers(20, 120))).tolist()
        bad = i % 4 == 0
        if bad:
            for w in gen.choice(["zwyxel", "qworrik", "vlughed"], 2):
                words.insert(int(gen.integers(len(words))), str(w))
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, int(bad)))
    docs += [(1000, None, "x", 1), (1001, "", "x", 1), (1002, "z" * 5000, "x", 1), (None, "bane", "x", 1)]
    labels += [(1000, 1), (None, 1), (5, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_the_held_out_fold(marked):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == 404 and all(0 <= r.toxic_score <= 1 for r in rows)
    held = [(r.toxic_score >= 0.5, r.doc_id % 4 == 0) for r in rows if r.held and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.97 * len(held)
    empty = [r.toxic_score for r in rows if r.doc_id in (1000, 1001)]
    assert empty[0] == empty[1] < 0.5


def test_toxicity_without_one_class(marked):
    docs, labels = marked
    model = toxicity.train(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, model).agg(F.max("toxic_score")).first()[0] < 0.01
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_rows_do_not_matter(marked):
    docs, labels = marked
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_op1_contract(spark, sf):
    out = queries.op1_compression_toxicity(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def _exact(ids, x, q, k=5):
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    s = unit @ unit[ids == q][0]
    return [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:k]


def test_op2_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in queries.op2_prefix_forest(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {int(i) for i in ids if i % 50 == 0}
    recall = []
    for q, hits in found.items():
        recall.append(len({h.vec_id for h in hits} & set(_exact(ids, x, q))) / 5)
        assert [h["rank"] for h in hits] == [1, 2, 3, 4, 5]
        for h in hits:
            a, b = x[ids == q][0], x[ids == h.vec_id][0]
            assert abs(h.score - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12
    assert np.mean(recall) >= 0.9


def test_forest_recall_over_several_shards(spark):
    gen = np.random.default_rng(2)
    centres = gen.standard_normal((40, 16))
    x = (centres[gen.integers(0, 40, 3000)] + 0.3 * gen.standard_normal((3000, 16))).astype(float)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), share=0.1, least=64, shard_rows=700, block_queries=25).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(_exact(ids, x, q))) / 5 for q in got]) >= 0.9


def test_forest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, float("nan")]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id in (0, 3, 4)")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 0.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>'
    '<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy now</div>'
    '<div class="cookie-notice">We use cookies, and this is a long notice about them.</div><main><article class="post-{n}"><h1>Head &amp; tail</h1>'
    "<p>First   para\n graph {n} with <b>bold</b>, <a href='#'>link</a>&nbsp;and &#233;.<p>Second &lt;one&gt;<br>line."
    '<ul><li>item one<li>item two</ul><form><p>Your mail</p><input></form><div class="comments"><p>A reader says something long here.</p></div></article></main>'
    '<aside><p>Related things to read, quite a lot of them in here.</p></aside><footer>&copy; 2020</footer></body></html>'
)
TEXT = "Head & tail\n\nFirst para graph {n} with bold, link and é.\n\nSecond <one> line.\n\nitem one\n\nitem two"


def test_page_text(spark):
    pages = [(i, f"https://h.example/{i}", PAGE.replace("{n}", str(i)), "t") for i in range(3)]
    pages += [(3, None, None, "t"), (4, "http://h.example", "", "t"), (5, "x", "just text", "t"), (6, "https://h.example/c", PAGE[: PAGE.index("Second")], "t"), (7, "https://o.example", "<p>" + "word " * 50000, "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert [got[i] for i in range(3)] == [TEXT.replace("{n}", str(i)) for i in range(3)]
    assert got[3] == got[4] == "" and got[5] == "just text" and got[6] == TEXT.replace("{n}", "{n}").split("\n\nSecond")[0]
    assert got[7] == " ".join(["word"] * 50000)
    assert html_text.extract(df.limit(0)).count() == 0


def test_the_host_decides(spark):
    """A page whose comments outgrow its article follows its host."""
    usual = '<body><div class="story"><p>{}</p></div><div class="talk"><p>{}</p></div></body>'
    pages = [(i, "http://a.example/p", usual.format("story words " * 30, "talk words")) for i in range(5)]
    pages.append((9, "http://A.example:80/q", usual.format("story words " * 30, "talk words " * 45)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()}[9] == " ".join(["story words"] * 30)
    assert html_text.host_paths(df).collect()[0].winner == ">body>div.story"


ARTICLE = "<h1>Head of it</h1><p>" + "words of the article " * 20 + "</p>"
JUNK = '<div class="cookie-notice"><p>We use cookies here.</p></div><div class="site-nav"><a href="/">Home</a></div>'


@pytest.mark.parametrize("name", ["overflow-hidden", "has-sidebar", "no-sidebar", "content-sidebar-wrap", "share-enabled", "lg:hidden", "widget"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main><div class='body'>{}</div></main>"])
def test_names_of_wrappers_do_not_discard_the_page(name, inner):
    page = f"<body>{JUNK}<div class='{name}'>{inner.format(ARTICLE)}<div class='sidebar'><p>Side words.</p></div></div></body>"
    assert [b[0] for b in html_text.page_blocks(page)] == ["Head of it", ("words of the article " * 20).strip()]


def test_named_asides_still_go():
    talk = "<div id='comments'><article class='comment-body'><p>" + "a reader writes " * 90 + "</p></article></div>"
    cards = "<div class='related-posts'><article class='card'><p>Another page.</p></article></div>"
    page = f"<body>{JUNK}<article>{ARTICLE}</article>{cards}{talk}</body>"
    assert [b[0] for b in html_text.page_blocks(page)][0] == "Head of it" and len(html_text.page_blocks(page)) == 2
    short = "<body><div class='ad'><p>Much longer than the article.</p></div><article><p>Short.</p></article></body>"
    assert [b[0] for b in html_text.page_blocks(short)] == ["Short."]
    assert html_text.page_blocks("<body><div class='nav'><a href='/'>Home</a></div></body>") == []


LEAD, BODY, END = "the lead of it " * 3, "body words here " * 40, "the end of it " * 3


@pytest.mark.parametrize("page", [
    "<body><article><h1>Head</h1><p>{0}</p><div class='body'><p>{1}</p></div><div class='end'><p>{2}</p></div></article></body>",
    "<body><main><h1>Head</h1><section><p>{0}</p></section><section class='long'><div><p>{1}</p></div></section><p>{2}</p></main></body>",
    "<body><div id='page'><div class='story'><h1>Head</h1><div class='intro'>{0}</div><div class='body'>{1}</div><div class='end'>{2}</div></div></div></body>",
    "<body><main><h1>Head</h1><p>{0}</p><article><p>{1}</p><p>{2}</p></article></main></body>",
    "<body><h1>Head</h1><p>{0}</p><div class='body'><p>{1}</p></div><p>{2}</p></body>",
])
def test_headline_lead_and_end_stay_with_the_body(page):
    links = "<body><div class='list'>" + "<a href='/x'>Another page of this host</a> " * 9 + "</div>"
    want = "\n\n".join(["Head", LEAD.strip(), BODY.strip(), END.strip()])
    html = page.format(LEAD, BODY, END).replace("<body>", links)
    own, _ = html_text.best_container(html_text.page_blocks(html))
    assert html_text.main_text(html, None) == html_text.main_text(html, own) == html_text.main_text(html, ">body>div.nowhere") == want


def test_a_winner_that_holds_less_does_not_replace():
    page = "<body><div class='blurb'><p>{}</p></div><article><h1>Head</h1><div class='body'><p>{}</p></div></article></body>".format("short " * 9, BODY)
    got = html_text.main_text(page, ">body>div.blurb")
    assert got == "\n\n".join([("short " * 9).strip(), "Head", BODY.strip()])
    # half of the text inside the same article is no reason to drop the rest
    two = "<body><article><div class='a'><p>{}</p></div><div class='b'><p>{}</p></div></article></body>".format("one " * 100, "two " * 70)
    assert html_text.main_text(two, ">body>article>div.b") == html_text.main_text(two, None) == ("one " * 100).strip() + "\n\n" + ("two " * 70).strip()


@pytest.mark.parametrize("hidden", ["<div hidden><p>Not shown.</p></div>", "<div style='color:red; display : none'><p>Not shown.</p></div>", "<p hidden=''>Not shown.</p>", '<section style="visibility:hidden">Not shown.</section>'])
def test_hidden_parts_go(hidden):
    page = f"<body><article><h1>Head</h1>{hidden}<p>{BODY}</p><p style='display:block'>Shown.</p></article></body>"
    assert html_text.main_text(page, None) == "\n\n".join(["Head", BODY.strip(), "Shown."])


def test_a_form_around_the_page_is_no_aside():
    for inner in ("<article>{}</article>", "<div class='text'>{}</div>"):
        page = "<body><form id='aspnetForm' action='/'><input>" + inner.format(f"<h1>Head</h1><p>{BODY}</p><form><p>Your mail</p><input></form>") + "</form></body>"
        assert html_text.main_text(page, None) == "Head\n\n" + BODY.strip()


def test_ids_inside_the_article_are_places():
    parts = "<section id='social'><p>Of social life.</p></section><section id='related-work'><h2 id='navigation'>Navigation</h2><p>At sea.</p></section><h2 id='login' class='share'>Login</h2>"
    links = "<div id='related'><a href='/a'>Another page</a> <a href='/b'>And one more</a></div><div class='share'><p>Share it.</p></div>"
    page = f"<body><main><header><h1>Head</h1></header><p>{BODY}</p>{parts}{links}</main><div id='related'><p>Something else.</p></div></body>"
    assert html_text.main_text(page, None) == "\n\n".join(["Head", BODY.strip(), "Of social life.", "Navigation", "At sea.", "Login"])


def test_odd_markup():
    for page in ("<", "<a", "<p class='x", "</p></div>", "<!-- open", "<script>no end", "<p>a<!--x-->b</p>", "<b><i></b></i>t", "a<br/>b<hr>c", "<P>A<P>B"):
        html_text.page_blocks(page)
    assert [b[0] for b in html_text.page_blocks("<p>a<!--x-->b</p>")] == ["ab"]
    assert [b[0] for b in html_text.page_blocks("<P>A<P>B")] == ["A", "B"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_pipeline(spark, sf):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")):
        pytest.skip("no pipeline")
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = []
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and (name != "suffix_dedup" or ids == before)
        names.append(name)
        docs = after
    assert names == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup"]
    packed = pipeline.run(spark, sf)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).filter("n <> all").count()
    assert tokens == 0 and {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_stages_on_an_empty_table(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_repeated_rows_through_the_pipeline(spark, sf, tmp_path):
    """A table that was ingested twice loses the second copy of a row, not its text."""
    import corpus_pipeline as pipeline

    gen = np.random.default_rng(8)
    words = [[f"v{j}" for j in gen.integers(0, 5000, 150)] for i in range(4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    edited = " ".join(["changed", *words[0][1:]])
    # ingested twice; an id with another text; an id with a near copy of its text; a near copy without an id
    given = rows * 2 + [(1, rows[3][1]), (0, edited), (None, edited + " tail")]
    schema = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").schema
    spark.createDataFrame(given, schema).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    copies = pipeline.drop_copies(spark, docs, str(tmp_path))
    assert copies.count() == 6 and copies.columns == docs.columns
    near = pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == [0, 1, 1, 2] and near.columns == docs.columns
    packed = pipeline.run(spark, str(tmp_path))
    whole = pipeline.pack(spark, near, str(tmp_path)).agg(F.sum("length")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == whole > 4 * 150
