"""Page facts on small documents: article and content selection, metadata keys, feeds, result pages, next pages; traversal and prefixes on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import pagefacts as P
from corpusloom.functions.dom import parse
from corpusloom.operators import ranking, similarity, tech, traverse

LONG = "One sentence, with commas, that is long enough to count as a paragraph of an article."


def test_article_strips_before_it_scores():
    nav = "<nav>" + "".join(f"<p>{LONG} {LONG}</p>" for _ in range(9)) + "</nav>"
    doc = f"<body>{nav}<div id='x'><p>{LONG}</p><p>{LONG}</p></div></body>"
    a = P.article(doc)
    assert a["text"] == f"{LONG} {LONG}" and not a["fallback_used"] and a["candidate_count"] == 2
    # two paragraphs: 1 point, 2 commas, their length by 100, half a sentence end; their box starts with 5
    assert a["score"] == pytest.approx(5 + 2 * (1 + 2 + len(LONG) / 100 + 0.5))


def test_article_without_candidates_falls_back_to_the_body():
    a = P.article("<html><body><p>Too short.</p><ul><li>x</li></ul></body></html>")
    assert a["text"] == "Too short. x" and a["fallback_used"] and a["score"] == 0.0 and a["candidate_count"] == 0
    assert P.article("")["text"] == "" and P.article(None)["fallback_used"]


def test_article_fast_path_scores_100():
    a = P.article(f"<body><div>{LONG}</div><main><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></main></body>")
    assert (a["score"], a["candidate_count"], a["fallback_used"]) == (100.0, 1, False)


def test_content_prefers_a_long_article_and_keeps_empty_elements():
    doc = f"<body><div id='content'><p>no</p></div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p></p><a href='/x'>l</a></div></body>"
    assert LONG in P.content_root(doc).text() and P.content_root(doc).name == "article"
    assert P.render("<body><p></p><h2></h2><a>x</a><p>a <b>b</b></p></body>") == "\n\n## \n\n[x]()\n\nab"
    assert P.content_links("<body><main>t<a href='/a#x'>1</a><a href='mailto:z@y.org'>2</a></main><a href='/b'>3</a></body>", "https://h.example/p") == ["https://h.example/a", "mailto:z@y.org"]


@pytest.mark.parametrize(
    ("kind", "title"),
    [("BlogPosting", "H"), ("LiveBlogPosting", "H"), ("NewsArticle", "H"), ("ArticleList", "T"), ("Product", "T")],
)
def test_structured_data_counts_by_type(kind, title):
    assert P.article_metadata(f'<title>T</title><script type="application/ld+json">{{"@type": "{kind}", "headline": "H"}}</script>')["title"] == title


def test_metadata_keys_and_bylines():
    m = P.article_metadata(
        "<html lang='en'><meta name='sailthru.author' content='By Ann Lee and Bo Ray'><meta name='publish_date' content='03/04/2021'><meta property='article:author' content='Nobody'>"
        "<meta name='thumbnail' content='/t.png'><meta name='parsely-page' content='{&quot;section&quot;: &quot;Arts&quot;, &quot;tags&quot;: [&quot;a&quot;, &quot;b,a&quot;]}'><article><span class='entry-author'>Cy Fox 2</span><time datetime='2020-01-02'>x</time></article>"
    )
    assert m["authors"] == ["Ann Lee", "Bo Ray", "Cy Fox"] and m["date_published"] == "2021-03-04T00:00:00"
    assert (m["image"], m["section"], m["keywords"], m["language"]) == ("/t.png", "Arts", ["a", "b"], "en")


@pytest.mark.parametrize(("text", "want"), [("2021-02-03T04:05:06Z", "2021-02-03T04:05:06+00:00"), ("20210203", "2021-02-03T00:00:00"), ("Friday, March 05, 2021, 3:04 PM", "2021-03-05T15:04:00"), ("soon", "soon"), ("", None), (None, None)])
def test_dates(text, want):
    assert P.parse_date(text) == want


def test_feeds_merge_by_key():
    doc = parse("<link rel='alternate' type='application/json' href='/api'><link rel='alternate' type='application/rss+xml' href='/feed?utm_source=x' title='F'><a href='/feed'>f</a><a href='/my-rss-tips'>t</a>")
    got = {c["url"]: (c["score"], tuple(c["sources"]), c["title"]) for c in P.feed_candidates(doc, "https://h.example/")}
    assert got["https://h.example/feed?utm_source=x"] == (100, ("link", "anchor", "guess"), "F") and got["https://h.example/my-rss-tips"][0] == 50
    assert got["https://h.example/api"][0] == 100  # alternate with json in its type
    assert all(c["score"] < 100 for c in P.feed_candidates(parse("<link type='application/json' href='/api'>"), "https://h.example/"))
    links = parse("<a href='/a/b'>x</a><a href='/news'>Blog news</a><a href='//other.example/feed'>f</a><a href='/feed'>f</a>")
    assert P.feed_spider_links(links, "https://h.example/a/", 2) == ["https://h.example/feed", "https://h.example/news"]


def test_result_page():
    doc = parse(
        "<div><div><a href='https://a.example/'><h3>Alpha</h3></a><cite>a.example</cite></div><div>A description of some length</div></div><a href='/search?q=x'><h3>Own</h3></a><a href='https://a.example/'><h3>Again</h3></a><a href='https://b.example/'>no heading</a>"
    )
    got = P.search_results(doc)
    assert [(r["title"], r["link"], r["description"]) for r in got] == [("Alpha", "https://a.example/", "A description of some length")]


@pytest.mark.parametrize(
    ("url", "label", "rel", "score"),
    [("https://h.example/a?page=2", "Next", ["next"], 60 + 25 + 30 + 20 + 10), ("https://h.example/b", "Next", [], None), ("https://h.example/a/page/3", "3", [], None), ("https://o.example/a?page=2", "Next", ["next"], None), ("https://h.example/a.pdf", "Next", ["next"], None)],
)
def test_next_page_points(url, label, rel, score):
    assert P.next_page_score(url, label, rel, "https://h.example/a") == score


def test_sitemap_hints():
    assert P.sitemap_hints(parse("<link rel='sitemap' href='/s.xml'><link rel='x' href='/sitemap_index.xml'><a href='/sitemap'>no</a>"), "https://h.example/") == ["https://h.example/s.xml", "https://h.example/sitemap_index.xml"]


def test_traversal_takes_links_by_place_and_beyond_4096(spark):
    edges = [("s", i, f"k{i:05d}") for i in range(5000)] + [("k04999", 0, "z"), ("k00001", 7, "z"), ("z", 0, "y"), ("y", 0, "x")]
    nodes = spark.createDataFrame([("s",), *((e[2],) for e in edges)], "key string").distinct()
    got = traverse.traverse(nodes, spark.createDataFrame(edges, "src string, pos int, dst string"), ["s"], max_depth=3).orderBy("seq").collect()
    assert [r.key for r in got] == ["s", *(f"k{i:05d}" for i in range(5000)), "z", "y"]
    few = traverse.traverse(nodes, spark.createDataFrame(edges, "src string, pos int, dst string"), ["s"], max_pages=3, max_depth=3).collect()
    assert {r.key for r in few} == {"s", "k00000", "k00001"}


def test_longest_prefix_with_ties_and_nulls(spark):
    u = spark.createDataFrame([("/a/b",), ("/a/b",), ("/c",), (None,), ("",)], "path string")
    p = spark.createDataFrame([("/a",), ("/a/",), ("/a",), ("/zz",)], "prefix string")
    got = sorted(((r.path, r.prefix) for r in ranking.longest_prefix(u, p).collect()), key=str)
    assert got == sorted([("/a/b", "/a/"), ("/a/b", "/a/"), ("/c", None), (None, None), ("", None)], key=str)


def test_keys_of_half_the_bits_miss_no_pair(spark):
    import random

    r = random.Random(3)
    fps = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    for f in list(fps):
        m = 0
        for b in r.sample(range(64), r.choice([1, 2, 3, 4])):
            m ^= 1 << b
        x = (f & ((1 << 64) - 1)) ^ m
        fps.append(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    got = {(x.id_a, x.id_b) for x in similarity.neardup_pairs(df, "id", "fp").collect()}
    u = [f & ((1 << 64) - 1) for f in fps]
    assert got == {(a, b) for a in range(len(u)) for b in range(a + 1, len(u)) if 0 < (u[a] ^ u[b]).bit_count() <= 3}


def test_versions_take_every_group_and_implications_go_to_the_end(spark):
    chain = {f"T{i}": {"implies": f"T{i + 1}"} for i in range(1, 9)}
    catalog = {"technologies": {"T0": {"headers": {"Server": "x/(\\d+)\\.(\\d+)\\;version:\\2-\\1"}, "implies": "T1"}, **chain}}
    pages = spark.createDataFrame([(1, "https://h.example/", "<p>", {"Server": "x/4.7"})], "page_id long, url string, html string, headers map<string,string>")
    got = {r.tech: r.version for r in tech.fingerprint(pages, *tech.rules_table(spark, catalog)).collect()}
    assert got["T0"] == "7-4" and set(got) == {f"T{i}" for i in range(10)}
    assert F is not None
