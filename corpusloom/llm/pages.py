"""The page tables of the project in one form: (kind, id, host, source)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_JSON_HTML = re.compile(r'"html"\s*:\s*"')


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def html_pages(page_store: DataFrame) -> DataFrame:
    return page_store.select(F.lit("html").alias("kind"), F.col("page_id").alias("id"), F.coalesce("host", host_of()).alias("host"), F.col("html").alias("source"))


def markdown_pages(page_markdown: DataFrame) -> DataFrame:
    return page_markdown.select(F.lit("markdown").alias("kind"), F.col("page_id").alias("id"), F.coalesce("host", host_of()).alias("host"), F.col("markdown").alias("source"))


def cache_pages(page_cache: DataFrame) -> DataFrame:
    return page_cache.select(F.lit("page_data").alias("kind"), F.col("cache_id").alias("id"), host_of().alias("host"), F.col("page_data").alias("source"))


def page_source(kind: str, source: str | None) -> tuple[str, str | None]:
    """(html or markdown, text) of a page; the html of page_data is taken from its JSON, and is None where that is no JSON object."""
    if kind != "page_data":
        return kind, source
    if not source:
        return "html", None
    try:
        data = json.loads(source)
    except ValueError:
        return "html", None
    html = data.get("html") if isinstance(data, dict) else None
    return "html", html if isinstance(html, str) else None
