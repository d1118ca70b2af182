"""Top chunks of documents, merges of sources, first-seen rows, admission by path budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def rank_chunks(docs: DataFrame, query: str, strategy: str = "sentence", size: int = 120, overlap: int = 30, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, index, score, text): the best k chunks of each document with a score above 0, ties by index.

    Scores are rounded to 6 digits; null and empty texts give no rows. Ranking needs only a document's own chunks, which
    are made and cut in one array without a shuffle.
    """
    made = F.transform(T.chunks(F.col(text_col), strategy, size, overlap), lambda c, i: F.struct((-T.chunk_score(c, query)).alias("neg"), i.alias("index"), c.alias("text")))
    best = F.slice(F.array_sort(F.filter(made, lambda x: x["neg"] < 0)), 1, max(1, k))
    return docs.select(F.col(id_col), F.explode(best).alias("x")).select(id_col, F.col("x.index").cast("int").alias("index"), (-F.col("x.neg")).alias("score"), F.col("x.text").alias("text"))


def merge_chunks(chunks: DataFrame, k: int = 10) -> DataFrame:
    """(source_rank, index, score, text): chunks of many sources, equal texts once by best rank, score raised by rank, the k best."""
    first = Window.partitionBy("text").orderBy("source_rank", "index")
    one = chunks.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    bonus = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.1) * F.col("source_rank"))
    return one.select("source_rank", "index", F.round(F.col("score") + bonus, 6).alias("score"), "text").orderBy(F.desc("score"), "source_rank", "index").limit(k)


def first_seen(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; null keys are one key. Aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in key]
    o = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), o).alias("_x")).select(*key, *[F.col("_x")[c].alias(c) for c in rest])


def longest_prefix(urls: DataFrame, prefixes: DataFrame, path_col: str = "path", prefix_col: str = "prefix") -> DataFrame:
    """urls with the longest prefix that starts their path (null for none): the prefixes of each distinct path are made and equi-joined, so no pair is compared."""
    p = prefixes.select(F.col(prefix_col).alias("_p")).where("_p <> ''").distinct()
    lengths = [r[0] for r in p.select(F.length("_p")).distinct().collect()]  # as many as the longest prefix has characters
    paths = urls.select(F.col(path_col).alias("_path")).where("_path is not null").distinct()
    cuts = F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    best = paths.select("_path", F.explode(cuts).alias("_p")).join(p, "_p").groupBy("_path").agg(F.max_by("_p", F.length("_p")).alias(prefix_col))
    return urls.join(best, F.col(path_col) == F.col("_path"), "left").drop("_path")


def admit(urls: DataFrame, budget: dict[str, int], order: list[str], path_col: str = "path") -> DataFrame:
    """Rows in order that the budget lets pass: each takes one from its longest matching prefix and one from `*`, and needs both.

    Every prefix is a raw prefix. The rank within a prefix decides first, then the rank among those left.
    """
    out = urls
    paths = sorted((p for p in budget if p != "*"), key=len, reverse=True)
    if paths:
        best = F.coalesce(*[F.when(F.startswith(F.col(path_col), F.lit(p)), F.lit(p)) for p in paths])
        limit = F.coalesce(*[F.when(F.startswith(F.col(path_col), F.lit(p)), F.lit(budget[p])) for p in paths])
        out = out.withColumn("_p", best).withColumn("_l", limit)
        w = Window.partitionBy("_p").orderBy(*order)
        free = out.where(F.col("_p").isNull())  # rows of no prefix need no rank, and are not brought together
        ranked = out.where(F.col("_p").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_l")).drop("_r")
        out = free.unionByName(ranked).drop("_p", "_l")
    if "*" in budget:
        out = out.orderBy(*order).limit(budget["*"])
    return out


def path_delay(path: Column, delays: dict[str, int], default: int = 0) -> Column:
    """Largest of the default, the delay for all, and that of the longest prefix."""
    paths = sorted((p for p in delays if p != "*"), key=len, reverse=True)
    own = F.coalesce(*[F.when(F.startswith(path, F.lit(p)), F.lit(delays[p])) for p in paths], F.lit(0))
    return F.greatest(F.lit(default), F.lit(delays.get("*", 0)), own)
