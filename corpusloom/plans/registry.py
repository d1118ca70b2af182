"""Every query of the core by name, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import fetching, urls
from corpusloom.functions import text as tx
from corpusloom.operators import pages as pg
from corpusloom.operators import ranking, search, similarity, tech, traverse
from corpusloom.operators.timestamps import normalize_timestamps
from corpusloom.plans import oracles
from corpusloom.plans.catalog import CATALOG, SCHEMA
from corpusloom.session import load, materialize
from corpusloom.sources import store
from corpusloom.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages once each: the first delivery of a page_id."""
    return load(spark, d, "page_store").dropDuplicates(["page_id"])


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    x = normalize_timestamps(load(spark, d, "article_meta"), load(spark, d, "sites"))
    return x.where("resolved").select("article_id", "field", "utc").distinct()


@query
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(tx.sentence_chunks(F.col("text"))).alias("index", "chunk"))


@query
def sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(tx.sliding_chunks(F.col("text"), 120, 30)).alias("index", "chunk"))


@query
def rank_chunks_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_chunks(load(spark, d, "documents"), "the report of", "sliding", 40, 10, 3)


@query
def research_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select((F.col("doc_id") - 1).alias("source_rank"), "text")
    return ranking.merge_chunks(ranking.rank_chunks(docs, "the archive", "sliding", 40, 10, 5, id_col="source_rank"), 10)


@query
def reading_time(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", tx.reading_minutes(F.col("text")).alias("minutes"))


@query
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.explode(tx.ngrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = urls.url_parts(F.col("url"))
    return load(spark, d, "page_store").select("url").distinct().select("url", p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"), p["query"].alias("query"))


@query
def url_dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_store").select("url").distinct().select("url", urls.url_key(F.col("url")).alias("url_key"))


@query
def url_first_seen(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_store").select("page_id", "url").distinct().withColumn("url_key", urls.url_key(F.col("url")))
    return ranking.first_seen(x, ["url_key"], ["page_id"]).select("url_key", "page_id", "url")


@query
def url_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_store").select("page_id", "url").distinct().where(urls.same_scope(F.col("url"), "example", True, ["https://indigo-page.test/x", "delta-weekly.test"]))


@query
def url_pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_store").select("page_id", "url").distinct().where(urls.matches(F.col("url"), ["*/blog/*", r"-\d{6}$", "utm_("]))


@query
def url_score_best_first(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_store").select("url").distinct().withColumn("score", urls.url_score(F.col("url"), "blog notes-on"))
    return x.orderBy(F.desc("score"), "url").limit(100)


@query
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_store").select("page_id", "url", "final_url").distinct()
    return x.select("page_id", urls.canonical_key(F.col("url"), F.col("final_url")).alias("url_key"))


@query
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_store").select("page_id", "url").distinct().withColumn("path", urls.url_parts(F.col("url"))["path"])
    return ranking.admit(x, {"/blog": 40, "/guides": 25, "/p": 60, "*": 300}, ["page_id", "url"]).select("page_id", "path")


@query
def path_delay(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_store").select("page_id", "url").distinct().withColumn("path", urls.url_parts(F.col("url"))["path"])
    return x.select("page_id", "path", ranking.path_delay(F.col("path"), {"/blog": 500, "/blog/notes": 900, "*": 100}, 50).alias("delay_ms"))


@query
def host_stats(spark: SparkSession, d: str) -> DataFrame:
    x = _pages(spark, d)
    return x.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("status_code") >= 400).alias("failed"), F.round(F.avg("elapsed_ms"), 3).alias("avg_ms"), F.countDistinct("url").alias("urls"))


@query
def block_reason(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_store")
    return x.select("page_id", fetching.block_reason(F.col("status_code"), F.col("html"), F.col("headers")["server"]).alias("reason")).where("reason is not null").distinct()


@query
def retry_status(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_store").select("page_id", "status_code").distinct().select("page_id", fetching.should_retry(F.col("status_code")).alias("retry"))


@query
def page_md5(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_store").where("html is not null").select("page_id", F.md5("html").alias("md5")).distinct()


@query
def grep_body(spark: SparkSession, d: str) -> DataFrame:
    return tech.grep(load(spark, d, "page_store"), "cookie-bar", r"og:image").select("page_id").distinct()


@query
def html_content_type(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_store").select("page_id", "content_type").distinct()
    return x.select("page_id", F.coalesce(F.lower("content_type").rlike("html|xhtml|xml|svg"), F.lit(False)).alias("is_html"))


@query
def revalidation_headers(spark: SparkSession, d: str) -> DataFrame:
    h = store.revalidation_headers(F.col("headers"))
    x = load(spark, d, "page_store").select("page_id", h["if-none-match"].alias("if_none_match"), h["if-modified-since"].alias("if_modified_since"))
    return x.where("if_none_match is not null or if_modified_since is not null").distinct()


@query
def contacts_text(spark: SparkSession, d: str) -> DataFrame:
    e = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), 0))
    kinds = F.create_map(F.lit("email"), e, F.lit("phone"), tx.phones(F.col("text")))
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.explode(kinds).alias("kind", "v")).select("doc_id", "kind", F.explode("v").alias("value"))


@query
def simhash_md5(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", similarity.simhash_md5(F.col("text")).alias("fp"))


@query
def simhash_blake2b(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", similarity.simhash_hex(similarity.simhash(F.col("text"))).alias("simhash"))


@query
def simhash_neardup_pairs(spark: SparkSession, d: str) -> DataFrame:
    fp = load(spark, d, "documents").select("doc_id", similarity.simhash(F.col("text")).alias("fp"))
    return similarity.neardup_links(fp, "doc_id", "fp")


@query
def neardup_leaders(spark: SparkSession, d: str) -> DataFrame:
    fp = load(spark, d, "documents").select("doc_id", similarity.simhash(F.col("text")).alias("fp"))
    return similarity.neardup_leaders(fp, "doc_id", "fp")


@query
def exact_dup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query
def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    t, u = F.array_distinct(tx.tokens(F.col("title"))), F.array_distinct(tx.tokens(F.col("text")))
    x = load(spark, d, "documents").where("title is not null")
    return x.select("doc_id", F.round(F.size(F.array_intersect(t, u)) / F.greatest(F.lit(1), F.size(F.array_union(t, u))), 6).alias("jaccard"))


@query
def auto_throttle(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(fetching.throttle_ms(F.col("value"), 10, 5000).alias("delay_ms"))


@query
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(8)).alias("attempt"))
    return x.select("event_id", fetching.backoff_ms(F.col("attempt")).alias("backoff_ms"))


@query
def autoscale_decision(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(9)).cast("int").alias("cur"), (F.pmod("event_id", F.lit(101)) * 1.0).alias("cpu"), (F.pmod(F.col("event_id") * 7, F.lit(101)) * 1.0).alias("mem"))
    a = fetching.autoscale(F.col("cur"), F.col("cpu"), F.col("mem"))
    return x.select("event_id", a["value"].alias("value"), a["action"].alias("action"))


@query
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_cache").select("cache_id", "url", "mode", "fetched_at").distinct()
    return store.cache_latest(x, tie="cache_id").select("url", "mode", "cache_id", "fetched_at")


@query
def cache_fresh(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_cache").select("cache_id", "fetched_at").distinct()
    now = F.lit(1760400900.0)
    return x.select("cache_id", store.fresh(F.col("fetched_at"), now, 900).alias("fresh"))


@query
def cache_json_fields(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "page_cache").select("cache_id", "page_data").distinct()
    j = F.try_parse_json("page_data")
    return x.select("cache_id", j.alias("j")).where("j is not null").select("cache_id", F.try_variant_get("j", "$.final_url", "string").alias("final_url"), F.try_variant_get("j", "$.status_code", "int").alias("status_code"))


@query
def json_field_select(spark: SparkSession, d: str) -> DataFrame:
    return store.select_fields(load(spark, d, "events").select("event_id", "props"), ["k"], "props").select("event_id", F.col("k").alias("k"))


@query
def dataset_flatten(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select("event_id", F.struct("event_type", F.struct("user_id").alias("who")).alias("e"))
    y = store.flatten(x)
    return y.select("event_id", F.col("`e.event_type`").alias("e_event_type"), F.col("`e.who.user_id`").alias("e_who_user_id"))


@query
def quiet_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.quiet_gap_sessions(x, gap="6 hours").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")


@query
def search_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Two providers: the stored pages, then the addresses of the article metadata."""
    x = load(spark, d, "page_store").select(F.col("page_id").alias("ord"), F.col("url").alias("link")).distinct()
    y = load(spark, d, "article_meta").select(F.col("article_id").alias("ord"), F.col("url").alias("link")).distinct()
    return search.union_providers([x, y]).select("source", "ord", "link")


@query
def search_attach_left_join(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "article_meta").select("article_id", F.col("url").alias("link")).distinct()
    p = _pages(spark, d).groupBy("final_url").agg(F.min("page_id").alias("page_id"))
    return search.attach_pages(x, p).select("article_id", "link", "page_id")


@query
def author_names(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "article_meta").select("author").where("author is not null").distinct()
    n = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("author", r"(?i)^\s*by\s+", ""), r"\|.*$", ""), r"[\[(].*$", ""), r"\d+\s*$", ""))
    return x.select("author", n.alias("name"))


def _facts(name: str, *fields: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pg.page_facts(_pages(spark, d), list(fields))

    run.__name__ = name
    return query(run)


@query
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    x = pg.page_facts(_pages(spark, d), ["metadata"])
    return x.select("page_id", *[F.col(f"metadata.{c}").alias(c) for c in ("title", "description", "image", "canonical_url")])


@query
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges (page_id, pos, link), scope and patterns applied after the kernel."""
    x = pg.page_facts(_pages(spark, d), ["links"])
    return x.select("page_id", F.posexplode("links").alias("pos", "link"))


for _name, _fields in {
    "page_resources": ("resources",),
    "page_text": ("text",),
    "page_markdown_render": ("markdown",),
    "article_content": ("article",),
    "article_metadata": ("article_metadata",),
    "page_signature": ("signature",),
    "tag_pattern": ("tag_pattern",),
    "forms": ("forms",),
    "contacts_html": ("contacts",),
    "app_state": ("app_state",),
    "feed_candidates": ("feed_candidates",),
    "next_page": ("next_pages",),
    "content_links": ("content_links",),
    "clean_html": ("clean_html",),
    "feed_spider_links": ("feed_spider_links",),
    "search_results": ("search_results",),
    "sitemap_hints": ("sitemap_hints",),
}.items():
    _facts(_name, *_fields)


@query
def structured_extract(spark: SparkSession, d: str) -> DataFrame:
    return pg.structured(_pages(spark, d), SCHEMA)


@query
def feed_documents(spark: SparkSession, d: str) -> DataFrame:
    return pg.feed_documents(_pages(spark, d))


@query
def tech_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return tech.fingerprint(_pages(spark, d).select("page_id", "url", "html", "headers"), *tech.rules_table(spark, CATALOG))


@query
def tech_search(spark: SparkSession, d: str) -> DataFrame:
    return tech.search_catalog(spark, CATALOG, "server")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the links on the stored pages, and the pages (page_id, key) themselves."""
    p = _pages(spark, d)
    keys = materialize(p.select("page_id", "host", urls.url_key(F.col("url")).alias("key")).where("key is not null"))
    links = pg.page_facts(p, ["links"]).select("page_id", F.posexplode("links").alias("pos", "link"))
    nodes, edges = traverse.link_graph(links, keys)
    return nodes, materialize(edges), keys


@query
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    """The link graph within hosts, by url keys."""
    return _graph(spark, d)[1].select("src", "dst")


@query
def retry_after(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", fetching.retry_after_ms(F.col("headers")).alias("wait_ms"))


@query
def fragments_stripped(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_store").select("page_id", urls.strip_fragment(F.col("url")).alias("url")).distinct()


@query
def merged_headers(spark: SparkSession, d: str) -> DataFrame:
    """Stored headers with two of a client put over them."""
    extra = F.create_map(F.lit("accept"), F.lit("text/html"), F.lit("server"), F.lit("own"))
    m = store.merge_headers(F.col("headers"), extra)
    return _pages(spark, d).select("page_id", F.size(m).alias("n"), m["accept"].alias("accept"), m["server"].alias("server"))


@query
def template_rows(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", store.render_template("{{ host }}/{{mode}}-{{ status_code }}.txt").alias("name"))


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return streams.windowed_counts(x).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query
def event_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a user with the events of that user in the ten minutes after it, itself among them."""
    x = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    y = x.select("user_id", "ts", F.col("event_id").alias("finish_id"))
    return streams.pair_events(x, y, key="user_id").select("event_id", "finish_id")


@query
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fixed set of rules lets an agent fetch every stored page."""
    text = "User-agent: *\nDisallow: /news/\nCrawl-delay: 2\n"
    x = load(spark, d, "page_store").select("host", "url").distinct()
    rules = x.select("host").distinct().select("host", F.lit(text).alias("text"))
    return pg.allowed_by_robots(x, rules).select("url", "allowed", "delay").distinct()


@query
def pagination_chain(spark: SparkSession, d: str) -> DataFrame:
    """The pages that continue every stored page, at most three."""
    p = _pages(spark, d)
    keys = materialize(p.select("page_id", urls.url_key(F.col("url")).alias("key")).where("key is not null"))
    nxt = pg.page_facts(p, ["next_pages"]).select("page_id", F.explode("next_pages").alias("n")).select("page_id", urls.url_key(F.col("n.url")).alias("dst"), F.col("n.score").alias("score"))
    edges = nxt.join(keys, "page_id").select(F.col("key").alias("src"), "dst", "score").where("dst is not null")
    return traverse.follow_pagination(keys.select("key"), edges, keys.select("key").distinct(), 3)


@query
def site_traversal(spark: SparkSession, d: str) -> DataFrame:
    """What is reached from every host's first stored page, three links deep."""
    nodes, edges, keys = _graph(spark, d)
    seeds = keys.groupBy("host").agg(F.min_by("key", F.struct("page_id", "key")).alias("key")).select("key")
    return traverse.traverse(nodes, edges, seeds, max_depth=3).select("key", "depth")


@query
def map_site(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, keys = _graph(spark, d)
    reached = traverse.traverse(nodes, edges, keys.select("key"), max_pages=2000, max_depth=2, strategy="best", query="notes", batch=1000)
    p = _pages(spark, d).select(urls.url_key(F.col("url")).alias("key"), "url", F.regexp_extract("html", r"<title>([^<]*)", 1).alias("title"), F.lit("").alias("description"))
    return traverse.map_site(reached, p, "notes", 50)


@query
def scrape(spark: SparkSession, d: str) -> DataFrame:
    """A stored page as one result: status, facts, content as markdown, content links and block reason."""
    p = _pages(spark, d)
    facts = pg.page_facts(p, ["metadata", "content_links", "markdown"]).drop("url")
    reason = fetching.block_reason(F.col("status_code"), F.col("html"), F.col("headers")["server"])
    return p.select("page_id", "url", "final_url", "status_code", "mode", reason.alias("block_reason")).join(facts, "page_id")


@query
def query_page(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of every page's content for a question."""
    text = pg.page_facts(_pages(spark, d), ["text"]).select("page_id", "text")
    return ranking.rank_chunks(text, "mirror harbour ledger", "sliding", k=3, id_col="page_id")


@query
def research_pages(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks over the pages that a search of the addresses ranks first."""
    p = _pages(spark, d).where("html is not null")
    top = p.select("page_id", "url", "html", urls.url_score(F.col("url"), "notes guides").alias("score")).orderBy(F.desc("score"), "page_id").limit(20)
    rank = materialize(top.select("page_id", F.row_number().over(Window.orderBy(F.desc("score"), "page_id")).alias("source_rank")))
    text = pg.page_facts(p.join(F.broadcast(rank), "page_id"), ["text"]).select("page_id", "text").join(rank, "page_id")
    return search.research(text.select("source_rank", "text"), "mirror harbour ledger")


@query
def feeds_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Feed addresses of every host over all of its pages: best score, pages that name it, and whether it is stored as a feed."""
    c = pg.page_facts(_pages(spark, d), ["feed_candidates"]).select("page_id", F.explode("feed_candidates").alias("c")).select("page_id", "c.url", "c.score")
    c = c.withColumn("key", urls.url_key(F.col("url"))).where("key is not null")
    stored = pg.feed_documents(_pages(spark, d)).select(urls.url_key(F.col("url")).alias("key"), "feed_format").groupBy("key").agg(F.min("feed_format").alias("feed_format"))
    one = c.groupBy("key").agg(F.min("url").alias("url"), F.max("score").alias("score"), F.count_distinct("page_id").alias("pages"))
    return one.join(stored, "key", "left").select(urls.url_parts(F.col("key"))["host"].alias("host"), "url", "score", "pages", "feed_format")


@query
def prefix_rules(spark: SparkSession, d: str) -> DataFrame:
    """The longest of a table's path prefixes that every page's path begins with."""
    p = _pages(spark, d).select("page_id", urls.url_parts(F.col("url"))["path"].alias("path"))
    rules = spark.createDataFrame([("/p",), ("/posts",), ("/docs/",), ("/news/",), ("/n",)], "prefix string")
    return ranking.longest_prefix(p, rules).select("page_id", "prefix")


@query
def traversal_bench_stats(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select(F.pmod("user_id", F.lit(4)).alias("concurrency"), "value")
    return x.groupBy("concurrency").agg(F.count("*").alias("samples"), F.round(F.avg("value"), 4).alias("avg_seconds"), F.min("value").alias("min_seconds"), F.max("value").alias("max_seconds"), F.round(F.median("value"), 4).alias("median_seconds"))


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in _ALL}


