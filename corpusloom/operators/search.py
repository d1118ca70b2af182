"""Results of several providers: union with first-come keys, pages attached, research over the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.urls import url_key
from corpusloom.operators.ranking import merge_chunks, rank_chunks


def union_providers(parts: list[DataFrame], cap: int | None = None, link_col: str = "link") -> DataFrame:
    """Rows of the providers in order, equal url keys once by the first; rows without a link all stay. parts: (ord, link, ...)."""
    all_ = None
    for i, p in enumerate(parts):
        x = p.withColumn("source", F.lit(i))
        all_ = x if all_ is None else all_.unionByName(x, allowMissingColumns=True)
    k = all_.withColumn("url_key", url_key(F.col(link_col)))
    w = Window.partitionBy("url_key").orderBy("source", "ord")
    one = k.where(F.col("url_key").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").unionByName(k.where(F.col("url_key").isNull()))
    return one.orderBy("source", "ord").limit(cap) if cap is not None else one


def attach_pages(results: DataFrame, pages: DataFrame, link_col: str = "link", url_col: str = "final_url") -> DataFrame:
    """results left-joined to pages by the exact final address."""
    return results.join(pages, results[link_col] == pages[url_col], "left")


def research(sources: DataFrame, query: str, per_source: int = 5, k: int = 10) -> DataFrame:
    """The best chunks over ranked sources (source_rank, text)."""
    return merge_chunks(rank_chunks(sources, query, "sliding", k=per_source, id_col="source_rank"), k)
