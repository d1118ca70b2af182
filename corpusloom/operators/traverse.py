"""Bounded traversal of a stored link graph, with budgets, robots, duplicate marks and a best-first order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.urls import url_key, url_parts, url_score
from corpusloom.operators.ranking import admit
from corpusloom.session import materialize


def traverse(
    nodes: DataFrame, edges: DataFrame, seeds: list[str] | DataFrame, max_pages: int | None = None, max_depth: int = 3, strategy: str = "bfs", query: str | None = None, budget: dict[str, int] | None = None, batch: int | None = None, denied: DataFrame | None = None
) -> DataFrame:
    """(key, depth, seq, blocked): pages reached from the seeds in order. nodes: (key), edges: (src, pos, dst), both of url keys; seeds: keys or a table (key).

    bfs takes a level at a time in the order of first mention; best takes by score of the query, then depth, then key.
    seq is the round, and in it the places of the links that lead to the page: it sorts as the pages were taken, without
    a sort of all of them. max_pages and batch bound what is taken in all and between two orderings (all by default).
    The budget admits addresses by path before they queue. Denied keys are rows with blocked true, and are not expanded.
    A round writes what it takes and what it finds to the shared folder, so that plans stay short and a lost executor
    costs one round.
    """
    spark = nodes.sparkSession
    score = url_score(F.col("key"), query or "") if strategy == "best" else F.lit(0.0)
    if isinstance(seeds, DataFrame):
        front = seeds.select("key").distinct().withColumn("ord", F.array(F.xxhash64("key")))
    else:
        front = spark.createDataFrame([(s, [i]) for i, s in enumerate(seeds)], "key string, ord array<long>")
    front = materialize(front.select("key", F.lit(0).alias("depth"), "ord").withColumn("score", score))
    known = materialize(nodes.select("key").distinct())
    done: list[DataFrame] = []
    queued, turn, taken = front.select("key"), 0, 0
    while max_pages is None or taken < max_pages:
        most = min(x for x in (max_pages - taken if max_pages is not None else None, batch, 1 << 62) if x is not None)
        size = front.count()
        if not size:
            break
        order = [F.desc("score"), "depth", "key"] if strategy == "best" else ["depth", "ord"]
        part = front if size <= most else materialize(front.orderBy(*order).limit(most))
        rest = front.limit(0) if size <= most else front.join(part.select("key"), "key", "left_anti")
        taken += min(size, most)
        if denied is not None:
            part = part.join(denied.select("key").distinct().withColumn("blocked", F.lit(True)), "key", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
        else:
            part = part.withColumn("blocked", F.lit(False))
        done.append(part.select("key", "depth", F.concat(F.array(F.lit(turn).cast("long")), "ord").alias("seq"), "blocked"))
        new = part.where((F.col("depth") < max_depth) & ~F.col("blocked")).select(F.col("key").alias("src"), "depth", "ord").join(edges, "src")
        new = new.groupBy(F.col("dst").alias("key")).agg((F.min("depth") + 1).cast("int").alias("depth"), F.min(F.concat("ord", F.array(F.col("pos").cast("long")))).alias("ord"))
        new = new.join(queued, "key", "left_anti").join(known, "key", "left_semi")
        if budget:
            new = admit(new.withColumn("path", url_parts(F.col("key"))["path"]), budget, ["depth", "ord"]).drop("path")
        new = materialize(new.withColumn("score", score).select("key", "depth", "ord", "score"))
        queued = queued.unionByName(new.select("key"))
        front = new if size <= most else materialize(rest.select("key", "depth", "ord", "score").unionByName(new))
        turn += 1
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "key string, depth int, seq array<long>, blocked boolean")


def link_graph(links: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (key, stored), edges (src, pos, dst)) of the links (page_id, pos, link) between pages (page_id, key) and what they name on their own hosts."""
    at = links.join(pages.select("page_id", F.col("key").alias("src")), "page_id").withColumn("dst", url_key(F.col("link")))
    at = at.where(F.col("dst").isNotNull() & (url_parts(F.col("src"))["host"] == url_parts(F.col("dst"))["host"]) & (F.col("src") != F.col("dst")))
    edges = at.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    stored = pages.select("key", F.lit(True).alias("stored")).unionByName(edges.select(F.col("dst").alias("key"), F.lit(False).alias("stored")))
    return stored.groupBy("key").agg(F.max("stored").alias("stored")), edges


def mark_duplicates(results: DataFrame) -> DataFrame:
    """results (seq, key, signature, ...) with is_duplicate_url and is_duplicate: whether an earlier row has the key, or the signature."""
    first = lambda c: results.groupBy(c).agg(F.min("seq").alias(f"_{c}"))
    x = results.join(first("key"), "key").join(first("signature"), "signature", "left")
    return x.withColumn("is_duplicate_url", F.col("seq") > F.col("_key")).withColumn("is_duplicate", F.coalesce(F.col("seq") > F.col("_signature"), F.lit(False))).drop("_key", "_signature")


def map_site(reached: DataFrame, pages: DataFrame, search: str | None = None, limit: int = 100) -> DataFrame:
    """(url, title, score): reached pages by score of the search over address, title and description, both descending."""
    text = F.concat_ws(" ", "url", "title", "description")
    return pages.join(reached.select("key").distinct(), "key", "left_semi").select("url", "title", url_score(text, search or "").alias("score")).orderBy(F.desc("score"), F.desc("url")).limit(limit)


def follow_pagination(pages: DataFrame, next_edges: DataFrame, roots: DataFrame, max_pages: int = 3) -> DataFrame:
    """(root, step, key): the chain of best next pages from each root, without repeats, at most max_pages long. next_edges: (src, dst, score)."""
    best = next_edges.groupBy("src").agg(F.max_by("dst", F.struct("score", "dst")).alias("dst"))
    chain = roots.select(F.col("key").alias("root"), F.lit(0).alias("step"), F.col("key"))
    out = last = materialize(chain)
    for i in range(1, max_pages):
        nxt = last.join(best, last["key"] == best["src"]).select("root", F.lit(i).alias("step"), F.col("dst").alias("key")).join(pages.select("key").distinct(), "key", "left_semi")
        last = materialize(nxt.join(out.select("root", "key"), ["root", "key"], "left_anti").select("root", "step", "key"))
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out
