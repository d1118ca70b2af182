"""Page tables to fact tables: the document of each page is parsed once, and only the fields asked for are made."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import pagefacts as P
from corpusloom.functions.dom import parse
from corpusloom.operators.arrow import map_rows

_FIELD = "struct<tag:string,type:string,name:string,id:string,placeholder:string,required:boolean,value:string,options:array<string>>"

#: Field name -> (Spark type, function of html, url and the parsed document).
FIELDS: dict[str, tuple[str, Callable]] = {
    "metadata": ("struct<title:string,description:string,image:string,canonical_url:string>", lambda h, u, d: P.metadata(d(), u)),
    "links": ("array<string>", lambda h, u, d: P.links(d(), u)),
    "resources": ("array<string>", lambda h, u, d: P.resources(d(), u)),
    "text": ("string", lambda h, u, d: P.render(h, "text")),
    "markdown": ("string", lambda h, u, d: P.render(h, "markdown")),
    "clean_html": ("string", lambda h, u, d: P.content_root(h).html()),
    "article": ("struct<text:string,excerpt:string,score:double,candidate_count:int,fallback_used:boolean>", lambda h, u, d: P.article(h)),
    "article_metadata": (
        "struct<title:string,description:string,site_name:string,authors:array<string>,author:string,date_published:string,date_modified:string,section:string,keywords:array<string>,canonical_url:string,image:string,language:string,reading_time_minutes:int>",
        lambda h, u, d: P.article_metadata(h, P.article(h)["text"]),
    ),
    "content_links": ("array<string>", lambda h, u, d: P.content_links(h, u)),
    "feed_spider_links": ("array<string>", lambda h, u, d: P.feed_spider_links(d(), u)),
    "search_results": ("array<struct<title:string,link:string,displayed_url:string,description:string,sitelinks:array<struct<title:string,link:string>>>>", lambda h, u, d: P.search_results(d())),
    "sitemap_hints": ("array<string>", lambda h, u, d: P.sitemap_hints(d(), u)),
    "signature": ("string", lambda h, u, d: P.signature(parse(h))),
    "tag_pattern": ("string", lambda h, u, d: P.tag_pattern(d())),
    "forms": (f"array<struct<index:int,action:string,method:string,enctype:string,fields:array<{_FIELD}>,preview:string>>", lambda h, u, d: P.forms(d(), u)),
    "contacts": ("struct<emails:array<string>,phones:array<string>,socials:map<string,array<string>>,link_count:int>", lambda h, u, d: P.contacts(d(), u)),
    "app_state": ("struct<json_ld:array<string>,states:array<struct<name:string,parsed:boolean,raw:string>>,frameworks:array<string>>", lambda h, u, d: P.app_state(d())),
    "feed_candidates": ("array<struct<url:string,score:int,sources:array<string>,type:string,title:string>>", lambda h, u, d: P.feed_candidates(d(), u)),
    "next_pages": ("array<struct<url:string,score:double>>", lambda h, u, d: P.next_pages(d(), u)),
}


def page_facts(pages: DataFrame, fields: list[str], id_col: str = "page_id") -> DataFrame:
    """(id, url, fields..., error): facts of each page. Null html counts as empty, and a null url as ""; a page that fails has nulls and its error.

    Only id, url and html leave the JVM, whatever other columns there are.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, url string, " + ", ".join(f"`{f}` {FIELDS[f][0]}" for f in fields) + ", error string"
    fns = [FIELDS[f][1] for f in fields]

    def one(rid, url, html):  # noqa: ANN001, ANN202
        doc = []

        def tree():  # noqa: ANN202
            if not doc:
                doc.append(parse(html))
            return doc[0]

        try:
            return [(rid, url, *[f(html or "", url or "", tree) for f in fns], None)]
        except Exception as e:  # a bad page is a row, never a failed job
            return [(rid, url, *[None] * len(fns), f"{type(e).__name__}: {e}"[:200])]

    return map_rows(pages.select(id_col, "url", "html"), schema, one)


def structured(pages: DataFrame, schema: dict, id_col: str = "page_id") -> DataFrame:
    """(id, url, item, data): one row an extracted item, data its fields as JSON. Pages without matches give no rows with a baseSelector."""
    kind = pages.schema[id_col].dataType.simpleString()

    def one(rid, url, html):  # noqa: ANN001, ANN202
        return [(rid, url, i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(P.extract(parse(html), url or "", schema))]

    return map_rows(pages.select(id_col, "url", "html"), f"{id_col} {kind}, url string, item int, data string", one)


def feed_documents(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, feed_format, title, entry_count, entry_urls) of pages that are feeds; others give no rows."""
    kind = pages.schema[id_col].dataType.simpleString()

    def one(rid, url, html, ct):  # noqa: ANN001, ANN202
        f = P.feed_document(html, ct)
        return [(rid, url, f["feed_format"], f["title"], f["entry_count"], f["entry_urls"])] if f["feed_format"] else []

    likely = F.ltrim("html").rlike(r"^(<\?xml|<rss|<feed|<rdf|\{)")
    return map_rows(pages.where(likely).select(id_col, "url", "html", "content_type"), f"{id_col} {kind}, url string, feed_format string, title string, entry_count int, entry_urls array<string>", one)


def sitemap_pages(sitemaps: DataFrame, roots: list[str], limit: int = 1000, depth: int = 5) -> DataFrame:
    """(url, depth): addresses listed by the root sitemaps and those they name, first level first, up to limit. sitemaps: (url, xml)."""

    def one(url, xml):  # noqa: ANN001, ANN202
        pages, more = P.sitemap_urls(xml)
        return [(url, pages, more)]

    parsed = map_rows(sitemaps.select("url", "xml"), "url string, pages array<string>, more array<string>", one).dropDuplicates(["url"]).persist()
    spark = sitemaps.sparkSession
    level, seen, out = spark.createDataFrame([(r,) for r in roots], "url string"), None, None
    for d in range(depth + 1):
        hit = parsed.join(level.distinct(), "url", "left_semi")
        found = hit.select(F.explode("pages").alias("url"), F.lit(d).alias("depth"))
        out = found if out is None else out.unionByName(found)
        seen = level if seen is None else seen.unionByName(level)
        level = hit.select(F.explode("more").alias("url")).distinct().join(seen, "url", "left_anti")
        if level.isEmpty():
            break
    return out.groupBy("url").agg(F.min("depth").alias("depth")).orderBy("depth", "url").limit(limit)


def allowed_by_robots(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls (host, url) with allowed and delay by the robots text of their host; hosts without one allow all."""
    joined = urls.join(robots.select("host", F.col("text").alias("_r")), "host", "left")

    def one(host, url, text):  # noqa: ANN001, ANN202
        ok, delay, _ = P.robots(text, agent, [url or ""])
        return [(host, url, ok[0], delay)]

    return map_rows(joined.select("host", "url", "_r"), "host string, url string, allowed boolean, delay double", one)
