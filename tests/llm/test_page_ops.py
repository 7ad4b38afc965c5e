"""HTML text, URL filter, embeddings, the pipeline and the registry."""

import random

import duckdb
import llm_brute as brute
import numpy as np
import pytest

from eventweave.llm import embedding_dedup, html_text, url_filter
from eventweave.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="page menu-open">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies and more cookies on all of our pages.</div>
<div id="sidebar"><p>Read also this long text about something else entirely, friends.</p></div>
<article><header><h1>The  title</h1></header><p>First <b>bold</b> &amp; <i>plain</i>&nbsp;text<br>goes on for quite a while, so that it is long.<p>Ok.</p>
<form><label>Name</label><input><button>Send</button></form><div class="ad">Buy this now, it is cheap, really cheap.</div>
<ul><li>One item of the list that is long enough to read</li><li>two</li></ul><blockquote>A quotation &lt;here&gt; &eacute;</blockquote></article>
<section class="comments"><p>I think that this article is quite good, said a reader of it.</p></section><aside>Aside</aside><footer>&copy; us</footer></body></html>"""


def test_main_text():
    want = "The title\nFirst bold & plain text goes on for quite a while, so that it is long.\nOk.\nOne item of the list that is long enough to read\ntwo\nA quotation <here> é"
    assert html_text.main_text(PAGE) == want
    no_article = "<body><div class=menu>a b c</div><div><p>" + "long words here " * 20 + "</p><p>Short.</p></div><div><a href=x>l1</a><a href=y>l2</a><a href=z>l3</a></div></body>"
    assert html_text.main_text(no_article) == ("long words here " * 20).strip() + "\nShort."
    for odd in (None, "", "<", "<p", "</p></p>", "<![if", "<!--", "&#x110000;", "<script>never ends"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<article>" * 3000 + "deep") == "deep"


def test_ratios_decide_inside_an_article(monkeypatch):
    long = "words that go on and on " * 8
    page = f"<article><h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p><div>" + "".join(f"<i>{i}</i><b>x</b><br>" for i in range(9)) + "</div></article>"
    text = "\n".join(["Title", long.strip(), "Short.", long.strip()])
    filler = "<div><p><i>a</i></p></div>" * 6
    page = page.replace("<div>", filler + "<div>")
    got = html_text.main_text(page)
    assert got.startswith(text) and len(got.split("\n")) <= 6  # at most the blocks beside a long paragraph besides
    monkeypatch.setattr(html_text, "smooth", lambda values: [1.0] * len(values))
    assert len(html_text.main_text(page).split("\n")) == 11
    assert html_text.main_text("<article><p>a</p></article>") == "a"


def test_html_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in html_text.html_query(spark, DATA).collect():
        # Plain reading of these pages: the blocks of the article.
        import html
        import re

        body = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|blockquote|div|table|tr|td)\b[^>]*>", re.sub(r"<!--.*?-->", "", body, flags=re.DOTALL))
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n".join(b for b in plain if b) and r.url == pages[r.page_id].url


def test_text_after_unknown_declarations_stays():
    for odd in ("<![foo[x]]>", "<![1]>", "<![%x[ y ]]>", "<![CDATA[x]]>", "<![if !IE]>", "<!x>"):
        assert html_text.main_text(f"<p>a</p>{odd}<p>b</p>") == "a\nb", odd


def test_left_out_elements_between_and_inside_paragraphs():
    for page, want in [
        ("<article><p>a</p><script>var x=1</script><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><style>p{}</style>tail<p>b</p></article>", "a\ntail\nb"),
        ("<p>text <button>Share</button></p>", "text"),
        ("<p>one<button>Share</button>two <span class='ad'>buy</span> three</p>", "one two three"),
        ("<p>wo<script>x</script>rd</p>", "word"),
        ("<div>text <span class='ad'><p>buy</p></span>tail</div>", "text\ntail"),
        ("<html><head><title>T</title><style>p{}</style><script>var a=1;</script></head><body><p>one</p><p>two</p></body></html>", "one\ntwo"),
    ]:
        assert html_text.main_text(page) == want, page


def test_html_rows(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (2, "u", PAGE, 6)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.page_id, r.n_chars > 0) for r in got) == [(1, False), (1, False), (2, True)]
    assert all(len(r.text) == r.n_chars for r in got)
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


URLS = [
    ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"), ("x://net/", "net", "/", "net/", "block"), ("http://b.net", "b.net", "", None, None),
    ("http://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"), ("http://anexample.com/de/x", "anexample.com", "/de/x", None, None),
    ("https://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"), ("https://w.org/frx", "w.org", "/frx", None, None), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("a://b://c.net/x", "b:", "//c.net/x", None, None), ("http://É.net?x=/en/", "É.net", "", None, None), ("http://notnet/", "notnet", "/", None, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(df.drop("host"), url_filter.fit(url_filter.SEED)).collect()}
    for i, (url, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")
        assert url_filter.parts(url) == (host, path)


def test_url_model_learns_and_generalises(spark):
    w = url_filter.fit_on(spark.createDataFrame([*url_filter.SEED, (None, 1), ("http://x.test", None)], "url string, label int"))
    df = spark.createDataFrame([(1, "http://www.cheap-pills.example.com/en/1"), (2, "http://www.garden-library.example.com/en/articles/1")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df, w, rules=[]).collect()} == {1: "block", 2: "allow"}


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(n // 6, 1), dims))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dims)) * rng.choice([0, 0.05, 0.1, 0.4], size=(n, 1))
    x[n // 2] = x[0] * 3
    return x


def exact(ids, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u @ u.T >= 0.95
    np.fill_diagonal(m, False)
    comp = brute.groups(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(m), strict=True)])
    return sorted((ids[i], int(m[i].sum()), comp[ids[i]], ids[i] == comp[ids[i]]) for i in range(len(ids)))


@pytest.mark.parametrize("block", [4096, 40])
def test_embeddings_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    x = vectors(block, 300)
    ids = list(range(1000, 1300))
    df = spark.createDataFrame([(i, v.tolist(), 0, "s") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int, cell string")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == exact(ids, x)


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-200, 1e-202])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10))
    assert [got[i] for i in (7, 8, 9, 11)] == [(3, 7, True), (3, 7, False), (3, 7, False), (3, 7, False)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_traversal_prunes():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(20), 100, axis=0) + rng.normal(size=(2000, 20)) * 0.01
    t = embedding_dedup.load_tree(embedding_dedup.build_tree(np.arange(2000), np.ones(2000, np.int64), list(x)))
    calls = []
    original = embedding_dedup.Found.compare
    embedding_dedup.Found.compare = lambda self, i, j, c: (calls.append((i.stop - i.start) * (j.stop - j.start)), original(self, i, j, c))[1]
    try:
        f = embedding_dedup.traverse(t, t, 0.95)
    finally:
        embedding_dedup.Found.compare = original
    assert (f.links[0] + f.links[1]).tolist() == [99] * 2000 and sum(calls) < 200_000


def test_pipeline_does_each_stage(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(0)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in ("n", "r", "st", "l")]
    text = lambda n=80: " ".join(rng.choices(words, k=n))
    bad = ["moronic", "scumbag", "clownish"]
    docs, labels = [], []
    for i in range(200):
        t = text()
        if i % 4 == 0:
            t = " ".join(w if rng.random() < 0.9 else rng.choice(bad) for w in t.split())
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    item = text(30)
    copy = docs[1][1]
    docs += [(300, copy, "en", "s0", len(copy)), (301, text(20) + " " + item + " " + text(20), "en", "s1", 0), (302, text() + " write to a@b.com", "en", "s1", 1), (303, None, None, None, None), (304, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept, masked = spark.read.parquet(f"{tmp_path}/documents.parquet"), [], None
    for k, (name, stage) in enumerate(cp.STAGES):
        df = stage(spark, df, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert df.columns == cp.COLUMNS, name
            df.write.parquet(f"{tmp_path}/{k}")
            df = spark.read.parquet(f"{tmp_path}/{k}")
            kept.append({r.doc_id for r in df.select("doc_id").collect()})
            masked = df
    clean = {i for i in range(200) if i % 4}
    assert clean | {300, 301, 302, 303, 304} <= kept[0] and len(kept[0] & set(range(0, 200, 4))) <= 3
    assert kept[0] - kept[1] == {300} and kept[1] - kept[2] == {301} and kept[3] == kept[2]
    assert next(r for r in masked.collect() if r.doc_id == 302).text.endswith("write to <EMAIL>")
    assert {r.doc_id for r in df.collect()} == kept[3]
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == sorted(map(str, df.collect()))


def test_registry():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    rel = db.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(rel.fetchall())
