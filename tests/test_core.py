"""Core operators: scalar cases, brute force on small tables, and empty, null and clashing inputs."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fetching, pagefacts, urls
from corpusloom.functions import text as tx
from corpusloom.functions.dates import iso_utc, to_epoch
from corpusloom.functions.dom import parse
from corpusloom.operators import pages, ranking, similarity, tech, traverse
from corpusloom.operators.timestamps import normalize_timestamps
from corpusloom.plans import registry
from corpusloom.sources import store


@pytest.mark.parametrize(
    ("value", "locale", "zone", "want"),
    [
        ("2023-10-29 02:30:00", "de-DE", "Europe/Berlin", "2023-10-29T00:30:00Z"),
        ("2023-03-26 02:30", "de-DE", "Europe/Berlin", None),
        ("03/10/2022", "en-US", "America/New_York", "2022-03-10T05:00:00Z"),
        ("03/10/2022", "en-GB", "UTC", "2022-10-03T00:00:00Z"),
        ("24-03-28", "en-US", "UTC", "2024-03-28T00:00:00Z"),
        ("1611745224319", "fr-FR", None, "2021-01-27T11:00:24Z"),
        ("19 novembre 2024 à 13h54", "fr-FR", "Europe/Paris", "2024-11-19T12:54:00Z"),
        ("30. Oktober 2022, 02:08 Uhr", "de-DE", "Europe/Berlin", "2022-10-30T00:08:00Z"),
        ("2023-01-24T02:28:33.968Z", "en-US", None, "2023-01-24T02:28:33Z"),
        ("November 7, 2021 1:01 AM EST", "en-US", None, "2021-11-07T06:01:00Z"),
        ("2021-12-04 18:06 UTC+5:30", "en-IN", None, "2021-12-04T12:36:00Z"),
        ("2025-01-01 18:36:42 AEDT", "en-AU", None, "2025-01-01T07:36:42Z"),
        ("2023-02-30", "en-US", "UTC", None),
        ("2023-01-01", "en-US", None, None),
        ("Spring 2023", "en-US", "UTC", None),
        ("", "en-US", "UTC", None),
        (None, None, None, None),
    ],
)
def test_dates(value, locale, zone, want):
    e = to_epoch(value, locale, zone)
    assert (None if e is None else iso_utc(e)) == want


def test_dates_against_the_standard_library():
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    r = random.Random(1)
    for _ in range(500):
        z = r.choice(["Europe/Paris", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "UTC"])
        t = r.randrange(1_000_000_000, 1_900_000_000)
        local = datetime.fromtimestamp(t, ZoneInfo(z))
        got = to_epoch(local.strftime("%Y-%m-%dT%H:%M:%S%z"), "en-GB", None)
        assert got == t
        naive = to_epoch(local.strftime("%Y-%m-%d %H:%M:%S"), "en-GB", z)
        first = local.replace(fold=0).astimezone(timezone.utc).timestamp()
        assert naive == int(first)


def test_timestamps_operator(spark):
    cols = "article_id long, host string, datepublished string, datemodified string, article_published_time string, _h string"
    rows = [(1, "a", "2024-01-02", None, "x", "q"), (1, "a", "2024-01-02", None, "x", "q"), (2, None, "2024-01-02T00:00:00Z", "", None, None)]
    sites = spark.createDataFrame([("a", "en-US", "UTC")], "host string, locale string, time_zone string")
    got = {(r.article_id, r.field, r.utc) for r in normalize_timestamps(spark.createDataFrame(rows, cols), sites).collect()}
    assert got == {(1, "datepublished", "2024-01-02T00:00:00Z"), (1, "article_published_time", None), (2, "datepublished", "2024-01-02T00:00:00Z"), (2, "datemodified", None)}
    assert normalize_timestamps(spark.createDataFrame([], cols), sites).count() == 0


def test_chunks_and_scores(spark):
    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.sliding_chunks(F.col("t"), 3, 1)).collect()][:2] == [["a b c", "c d e"], []]
    one = spark.createDataFrame([("A b. C d? E",)], "t string")
    assert one.select(tx.sentence_chunks(F.col("t"))).first()[0] == ["A b.", "C d?", "E"]
    s = spark.createDataFrame([("Spark spark rocks",)], "t string")
    assert s.select(tx.chunk_score(F.col("t"), "spark")).first()[0] == 8.366864
    s = spark.createDataFrame([("spark is very fast",)], "t string")
    assert s.select(tx.chunk_score(F.col("t"), "spark missing")).first()[0] == 1.773825
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x spark. y"), (4, "spark " * 5000)], "doc_id int, text string")
    assert {r.doc_id for r in ranking.rank_chunks(docs, "spark").collect()} == {3, 4}


def test_reading_time(spark):
    df = spark.createDataFrame([("w " * n,) for n in (0, 100, 550)], "t string")
    assert [r[0] for r in df.select(tx.reading_minutes(F.col("t"))).collect()] == [0, 1, 2]


def test_urls(spark):
    u = "HTTP://Example.COM:80/a//b/../c/?b=2&a=1&utm_source=x#f"
    assert urls.normalize_url_text(u) == "http://example.com/a/c/?a=1&b=2&utm_source=x"
    assert urls.normalize_url_text("http://e.com/a%20b") == "http://e.com/a%2520b"
    cases = [u, "https://e.com", "https://e.com/a/?utm_source=f&x=1", "https://e.com/a?b=&c=2#t", "http://e.com/a/../b", "https://e.com/x//y", "http://e.com:8080/", "nonsense:", None, ""]
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    got = [r[0] for r in df.select(urls.url_key(F.col("u"))).collect()]
    assert got == [None if c is None else urls.normalize_url_text(c, drop_tracking=True) for c in cases]
    scope = spark.createDataFrame([("https://a.e.com/",)], "u string")
    assert scope.select(urls.same_scope(F.col("u"), "e.com")).first()[0] is False
    assert scope.select(urls.same_scope(F.col("u"), "e.com", True)).first()[0] is True
    s = spark.createDataFrame([("https://e.com/async-browser",)], "u string")
    assert s.select(urls.url_score(F.col("u"), "async browser")).first()[0] == 3.0
    assert s.select(urls.matches(F.col("u"), ["*async*"]), urls.matches(F.col("u"), []), urls.matches(F.col("u"), ["("])).first()[:] == (True, True, False)


def test_budget(spark):
    rows = [(i, p) for i, p in enumerate(["/docs/a", "/docs/b", "/x", "/docs/c", "/y"])]
    df = spark.createDataFrame(rows, "i int, path string")
    assert [r.path for r in ranking.admit(df, {"*": 3, "/docs": 1}, ["i"]).orderBy("i").collect()] == ["/docs/a", "/x", "/y"]


def test_block_and_retry(spark):
    df = spark.createDataFrame([(503, "x"), (200, "  "), (200, "<title>Just a moment...</title>"), (200, "<p>hcaptcha</p>"), (404, "<p>ok</p>"), (None, None)], "s int, h string")
    assert [r[0] for r in df.select(fetching.block_reason(F.col("s"), F.col("h"))).collect()] == ["http_status:503", "empty_body", "body_marker:just a moment", "body_marker:captcha", None, "empty_body"]
    scale = spark.createDataFrame([(90.0, 10.0), (50.0, 50.0), (70.0, 70.0)], "c double, m double")
    assert [tuple(r[0]) for r in scale.select(fetching.autoscale(F.lit(4), F.col("c"), F.col("m"))).collect()] == [(3, "decrease"), (5, "increase"), (4, "keep")]


def test_simhash(spark):
    df = spark.createDataFrame([("abc",), ("hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(similarity.simhash_hex(similarity.simhash(F.col("t")))).collect()] == ["d8bb14d833d59559", "fbded63dcd4efedf", None, None]
    b = df.limit(2).select(similarity.bands(similarity.simhash(F.col("t")))).collect()[1][0]
    assert [(x.band, x.value) for x in b] == [(0, 65247), (1, 52558), (2, 54845), (3, 64478)]


def _simhash_md5(t):
    t = " ".join(t.lower().split())
    grams = [t] if len(t) < 4 else [t[i : i + 4] for i in range(len(t) - 3)]
    hs = [int(hashlib.md5(g.encode()).hexdigest()[:16], 16) for g in grams]
    v = sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hs) >= 0)
    return v - (1 << 64) if v >= 1 << 63 else v


def _documents(spark, path, texts):
    rows = [(i, t, None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_simhash_md5_of_all_documents(spark, tmp_path):
    r = random.Random(5)
    texts = ["ab", "Hello  World", " ".join(r.choice(["one", "Two", "thrée", "😀"]) for _ in range(600)), "", None]
    got = {x.doc_id: x.fp for x in registry.queries()["simhash_md5"](spark, _documents(spark, tmp_path, texts)).collect()}
    assert got == {i: _simhash_md5(t) if t else None for i, t in enumerate(texts)}


def test_long_texts_count_whole(spark, tmp_path):
    r = random.Random(6)
    text = "".join(r.choice("abcdefghij") for _ in range(6_000)) + "".join(r.choice("klmnopqrst") for _ in range(50_000))
    d = _documents(spark, tmp_path, [text])
    grams = [text[i : i + 4] for i in range(len(text) - 3)]
    hs = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
    blake = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) >= len(hs))
    run = lambda q: registry.queries()[q](spark, d).collect()
    assert run("simhash_blake2b")[0].simhash == f"{blake:016x}"
    assert run("simhash_md5")[0].fp == _simhash_md5(text)
    assert {x.gram: x.n for x in run("ngram_counts")} == Counter(grams)
    assert similarity._blake_simhash(text, max_tokens=5_000) == similarity._blake_simhash(text[:5_003])


def test_neardup_pairs_and_leaders(spark):
    r = random.Random(3)
    fps = [r.getrandbits(63) for _ in range(40)]
    fps += [f ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) for f in fps[:30]] + fps[:5]
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    pairs = similarity.neardup_pairs(df, "id", "fp")
    got = {(x.id_a, x.id_b, x.distance) for x in pairs.collect()}
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    ids = sorted(first.values())
    want = {(a, b, (fps[a] ^ fps[b]).bit_count()) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    assert got == want
    near = {}
    for a, b, d in want:
        near.setdefault(b, []).append((d, a))
    kept, lead = set(), {}
    for i in ids:
        c = [x for x in near.get(i, []) if x[1] in kept]
        lead[i] = min(c)[1] if c else i
        if not c:
            kept.add(i)
    assert {x.id: x.leader for x in similarity.leaders(pairs, spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()} == lead


def _greedy(fps):
    kept, lead = [], {}
    for i, f in enumerate(fps):
        c = [((f ^ fps[k]).bit_count(), k) for k in kept if f is not None and (f ^ fps[k]).bit_count() <= 3]
        lead[i] = min(c)[1] if c else i
        if not c and f is not None:
            kept.append(i)
    return lead


def test_leaders_with_copies_among_the_nodes(spark):
    r = random.Random(4)
    fps = [0, 0b111, 0b1111, 0b111, None, None]  # the copy of 1 is nearer to 2, which comes after 1
    base = [r.getrandbits(63) for _ in range(30)]
    rest = base + [f ^ (1 << r.randrange(8)) ^ (1 << r.randrange(8)) for f in base * 3] + [base[0]] * 40
    r.shuffle(rest)
    fps += rest
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    assert {x.id: x.leader for x in similarity.neardup_leaders(df, "id", "fp").collect()} == _greedy(fps)


@pytest.mark.parametrize(("n", "at_driver"), [(56, 0), (500, 100_000), (60, 20)])
def test_leaders_of_a_long_chain(spark, n, at_driver):
    pairs = spark.createDataFrame([(i, i + 1, 2) for i in range(n - 1)], "id_a long, id_b long, distance int")
    got = {x.id: x.leader for x in similarity.leaders(pairs, spark.range(n), "id", at_driver=at_driver).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_leaders_raise_at_a_bound(spark):
    pairs = spark.createDataFrame([(i, i + 1, 2) for i in range(9)], "id_a long, id_b long, distance int")
    with pytest.raises(RuntimeError):
        similarity.leaders(pairs, spark.range(10), "id", max_rounds=2, at_driver=0)


def test_neardup_queries_attach_copies(spark, tmp_path):
    d = _documents(spark, tmp_path, ["one text of some length", "another thing", "one text of  some length", None, "One text of some length"])
    assert {tuple(x) for x in registry.queries()["simhash_neardup_pairs"](spark, d).collect()} == {(0, 2, 0), (0, 4, 0)}
    assert {tuple(x) for x in registry.queries()["neardup_leaders"](spark, d).collect()} == {(0, 0), (1, 1), (2, 0), (3, 3), (4, 0)}


HTML = """<html lang="en"><head><title>My Post</title><link rel="canonical" href="/c"><meta name="description" content="d"></head><body>
<nav><a href="/n">N</a></nav><article><h1>My Post</h1><p>One long paragraph, with commas, that says enough to be scored as text for the article. It goes on.</p>
<p>Another <a href="/b#x">link</a> paragraph.<p>nested</article><form action="/s"><input name="q" value="v"><select name="o"><option value="1">A</option></select></form>
<script>window.__INITIAL_STATE__={"a":{"b":"}"}};</script><a rel="next" href="/?page=2">next</a><a href="mailto:x@y.example">m</a></body></html>"""


def test_contacts_text_has_phones(spark, tmp_path):
    texts = ["Call +44 (0)20 7946-0958 or a@b.example, again +44 020 79460958.", "12 34 5678\u00a09, 12-34", None, ""]
    got = {tuple(x) for x in registry.queries()["contacts_text"](spark, _documents(spark, tmp_path, texts)).collect()}
    assert got == {(0, "email", "a@b.example"), (0, "phone", "+4402079460958"), (1, "phone", "123456789")}
    assert "123456789" == pagefacts.phone_digits(pagefacts.PHONE.findall(texts[1])[0])


def test_search_union_has_whole_tables(spark, tmp_path):
    u = "https://e.example/"
    pages_ = [(i, f"{u}{i}") for i in range(1, 8)] + [(7, f"{u}7")]
    spark.createDataFrame(pages_, "page_id long, url string").write.parquet(str(tmp_path / "page_store.parquet"))
    spark.createDataFrame([(1, f"{u}5?utm_source=x"), (5, f"{u}new"), (6, f"{u}new"), (8, None)], "article_id long, url string").write.parquet(str(tmp_path / "article_meta.parquet"))
    got = {tuple(x) for x in registry.queries()["search_union_dedupe"](spark, str(tmp_path)).collect()}
    assert got == {(0, i, f"{u}{i}") for i in range(1, 8)} | {(1, 5, f"{u}new"), (1, 8, None)}


def test_page_facts(spark):
    u = "https://e.example/"
    d = parse(HTML)
    assert pagefacts.metadata(d, u) == {"title": "My Post", "description": "d", "image": "", "canonical_url": "https://e.example/c"}
    assert pagefacts.links(d, u) == ["https://e.example/n", "https://e.example/b", "https://e.example/?page=2"]
    assert pagefacts.contacts(d, u)["emails"] == ["x@y.example"]
    assert pagefacts.forms(d, u)[0]["preview"] == "https://e.example/s?q=v&o="
    assert pagefacts.app_state(d)["states"][0]["parsed"] and pagefacts.app_state(d)["frameworks"] == ["redux"]
    assert "One long paragraph" in pagefacts.article(HTML)["text"]
    assert pagefacts.next_page_score("https://e.com/story?page=2", "next", ["next"], "https://e.com/story") == 145.0
    assert pagefacts.page_number("https://e.com/story/2") == 2
    df = spark.createDataFrame([(1, u, HTML, 5), (2, None, None, 6), (3, u, "", 7), (4, u, "<p>" * 3000, 8)], "page_id long, url string, html string, error int")
    rows = pages.page_facts(df, list(pages.FIELDS)).collect()
    assert len(rows) == 4 and rows[0].error is None


def test_selectors():
    d = parse('<ul><li class="a x">1<li>2</ul><div id=i><p data-k="Val">3</p></div>')
    assert [n.text() for n in d.select("div > p")] == ["3"]
    assert [n.text() for n in d.select("[data-k='val' i], .a")] == ["1 2", "3"]
    assert d.select_one("#i p").get("data-k") == "Val"


def test_feeds_sitemaps_robots():
    assert pagefacts.feed_document("<rss><channel><title>T</title><item><link>u</link></item></channel></rss>")["feed_format"] == "rss"
    assert pagefacts.feed_document("<html>")["feed_format"] is None
    assert pagefacts.sitemap_urls("<urlset><url><loc>a</loc></url></urlset>") == (["a"], [])
    assert pagefacts.sitemap_urls("<broken") == ([], [])
    assert pagefacts.robots("User-agent: *\nDisallow: /x", "me", ["https://e/x/1", "https://e/y"])[0] == [False, True]


def test_tech(spark):
    assert tech.compile_rule(r"jquery[.-]([\d.]+)\;version:\1\;confidence:50") == (r"jquery[.-]([\d.]+)", "jquery", 50, r"\1")
    cat = {"technologies": {"J": {"scripts": [r"jquery[.-]([\d.]+)\;version:\1"], "implies": "K"}, "K": {}, "S": {"headers": {"Server": "nginx"}}}}
    df = spark.createDataFrame([(1, "https://e/", '<script src="/jquery-3.1.js"></script>', {"server": "nginx"}), (2, None, None, None)], "page_id long, url string, html string, headers map<string,string>")
    got = {(r.page_id, r.tech, r.confidence, r.version) for r in tech.fingerprint(df, *tech.rules_table(spark, cat)).collect()}
    assert got == {(1, "J", 100, "3.1."), (1, "K", 100, ""), (1, "S", 100, "")} or got == {(1, "J", 100, "3.1"), (1, "K", 100, ""), (1, "S", 100, "")}


def test_traverse(spark):
    keys = [chr(97 + i) for i in range(8)]
    nodes = spark.createDataFrame([(k,) for k in keys], "key string")
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "a"), ("b", 1, "d"), ("d", 0, "e"), ("e", 0, "f"), ("c", 0, "zz")], "src string, pos int, dst string")
    got = traverse.traverse(nodes, edges, ["a"], 10, 3).orderBy("seq").collect()
    assert [(r.key, r.depth) for r in got] == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert traverse.traverse(nodes, edges, ["a"], 2, 3).count() == 2


def test_store(spark, tmp_path):
    w = spark.createDataFrame([("u", "m", 1.0, "a"), ("u", "m", 2.0, "b"), ("v", None, 1.0, None)], "url string, mode string, fetched_at double, page_data string")
    p = str(tmp_path / "cache")
    store.cache_upsert(spark, p, w)
    store.cache_upsert(spark, p, spark.createDataFrame([("u", "m", 3.0, "c")], w.schema))
    assert {(r.url, r.page_data) for r in spark.read.parquet(p).collect()} == {("u", "c"), ("v", None)}
    f = store.flatten(spark.createDataFrame([(("x", True), [1, 2], None)], "a struct<b:string,e:boolean>, c array<int>, d string")).first().asDict()
    assert f == {"a.b": "x", "a.e": "True", "c": "[1,2]", "d": ""}
    assert w.select(store.render_template("{{ url }}/{{mode}}!")).collect()[0][0] == "u/m!"


def test_streams(spark, tmp_path):
    from corpusloom.streaming import events

    rows = spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0,0,i*10) AS ts, 'e' AS event_type FROM (SELECT explode(array(0,1,2,20)) AS i)")
    rows.write.parquet(str(tmp_path / "in"))
    assert sorted(r.events for r in events.quiet_gap_sessions(rows).collect()) == [1, 3]
    st = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.first_events(st, ["user_id"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 1
