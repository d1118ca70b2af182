"""Queries of the operators for training data, and what of them SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, errorpages, leakage, lines, names, neardup, packing, pii, residue
from corpusloom.llm.pages import cache_pages, html_pages, markdown_pages
from corpusloom.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose main bodies share at least 0.6 of their runs of three words."""
    pages = markdown_pages(load(spark, d, "page_markdown")).unionByName(cache_pages(load(spark, d, "page_cache")))
    members, links = neardup.near_duplicates(pages, threshold=0.6, width=3, min_words=40)
    return neardup.duplicate_pairs(members, links).select(F.col("kind").alias("field"), "id_a", "id_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a record: its class of equal bodies and the number of classes within 0.8 by runs of five words."""
    pages = markdown_pages(load(spark, d, "page_markdown")).unionByName(cache_pages(load(spark, d, "page_cache")))
    return neardup.duplicate_classes(*neardup.near_duplicates(pages, threshold=0.8, width=5)).select(F.col("kind").alias("field"), "id", "class_id", "links")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(names.name_variants(load(spark, d, "article_meta")))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row a spelling of a host: the entity it belongs to."""
    return names.name_variants(load(spark, d, "article_meta"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = html_pages(load(spark, d, "page_store")).unionByName(markdown_pages(load(spark, d, "page_markdown")))
    return boilerplate.boilerplate_positions(pages).select(F.col("kind").alias("field"), F.col("id").alias("page_id"), "pos")


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page alone."""
    pages = html_pages(load(spark, d, "page_store")).unionByName(markdown_pages(load(spark, d, "page_markdown")))
    return boilerplate.main_content(pages).select(F.col("kind").alias("field"), F.col("id").alias("page_id"), "title", "text")


def _all_pages(spark: SparkSession, d: str) -> DataFrame:
    return html_pages(load(spark, d, "page_store")).unionByName(markdown_pages(load(spark, d, "page_markdown"))).unionByName(cache_pages(load(spark, d, "page_cache")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.markup_residue(_all_pages(spark, d)).select(F.col("kind").alias("field"), F.col("id").alias("rec_id"), "markup")


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every record with the kinds of markup found in it."""
    return residue.clean_documents(_all_pages(spark, d)).select(F.col("kind").alias("field"), F.col("id").alias("rec_id"), "text", F.array_join("markup", ",").alias("markup"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(load(spark, d, "page_markdown")).select("host", "line_key")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every record without the repeated lines of its host."""
    return lines.strip_repeated_lines(load(spark, d, "page_markdown"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    x = errorpages.unusable_pages(errorpages.signed_pages(load(spark, d, "page_store"), load(spark, d, "page_markdown")))
    return x.select(F.col("kind").alias("field"), F.col("id").alias("page_id"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold ten consecutive words of an item, or all words of a shorter one."""
    return leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "benchmark")).where("equal").select("doc_id", "item_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text in a container of 4096 tokens, whole unless it alone exceeds that."""
    return packing.pack(packing.token_sizes(load(spark, d, "documents")), 4096)


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of every piece, in its container."""
    docs = load(spark, d, "documents")
    return packing.container_texts(docs, packing.pack(packing.token_sizes(docs), 4096))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(load(spark, d, "documents"))


def p10_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in the place of its mentions."""
    return pii.personal_data(load(spark, d, "documents"), redact=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"

_P6 = r"""
WITH rec AS (SELECT DISTINCT page_id, host, markdown FROM page_markdown),
total AS (SELECT host, count(DISTINCT page_id) AS total FROM rec GROUP BY host),
l AS (SELECT DISTINCT page_id, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS line_key
      FROM (SELECT page_id, host, unnest(string_split(markdown, chr(10))) AS line FROM rec)),
n AS (SELECT host, line_key, count(*) AS n FROM l WHERE line_key <> '' GROUP BY host, line_key)
SELECT n.host, n.line_key FROM n JOIN total USING (host) WHERE n.n >= 5 AND n.n >= 0.1 * total.total
"""

_P9 = r"""
WITH item AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM item WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM iw),
sizes AS (SELECT DISTINCT n FROM ig),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM doc, sizes WHERE len(w) >= n),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dw)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _P6, "p9_found": _P9}
