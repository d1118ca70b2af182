"""What a host's pages have in common, counted in Spark: lines that differently titled pages repeat, and the tag paths that hold content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import BROADCAST_LIMIT, materialize

#: A key is the template's when it stands on so many differently titled pages of a host and on this share of them; or does so on so many other hosts.
MIN_TITLES, MIN_SHARE, MIN_HOSTS = 3, 0.03, 3
#: Words that double what is asked of a key: near copies of an article share long paragraphs, a template stands nearly everywhere.
LONG_WORDS = 24
#: Share of the titles that is enough for a line of any length.
MOST = 0.5
#: Weight of the neighbours in smoothing, and the part of the host's mean fused ratio that a content path reaches.
NEIGHBOUR, CUT = 0.1, 0.5
#: Part of the summed ratios of the selected nodes that the content section holds.
REGION = 0.8

#: Fields of a page for the counts.
STATS = "array<struct<leaf:long,around:array<long>,paragraph:boolean,chars:int,marks:int,nodes:int,place:double>>"


def repeated_keys(keys: DataFrame) -> DataFrame:
    """(kind, host, key) from rows (kind, host, title, keys array<long>), one row per page.

    Counts are of distinct titles, so copies of one page and rows delivered twice count once. Only hashes are shuffled,
    and a hot host is spread over (kind, host, key). The low byte of a key is its number of words by four; longer lines
    need more titles, in proportion. Null hosts are one host.
    """
    at = F.xxhash64("kind", F.coalesce("host", F.lit("\0"))).alias("at")  # three numbers a row are shuffled, no names
    flat = keys.select(at, "title", F.explode("keys").alias("key")).where("key <> 0")
    n = flat.distinct().groupBy("at", "key").agg(F.count("*").alias("n"))
    total = keys.select("kind", "host", at, "title").distinct().groupBy("kind", "host", "at").agg(F.count("*").alias("total"))
    more = 1 + F.greatest(F.lit(0.0), F.col("key").bitwiseAND(F.lit(255)) * 4.0 / LONG_WORDS - 1)
    enough = (F.col("n") >= F.least(MIN_TITLES * more, F.col("total") * MOST)) & (F.col("n") >= F.col("total") * F.least(MIN_SHARE * more, F.lit(MOST)))
    often = n.where(F.col("n") >= MIN_TITLES).join(total, "at").where(enough).select("kind", "host", "key")
    known = often.groupBy("kind", "key").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= MIN_HOSTS).select("kind", "key")
    elsewhere = n.join(known, "key").join(total.select("kind", "host", "at"), ["at", "kind"]).select("kind", "host", "key")
    return often.unionByName(elsewhere).distinct()


def content_paths(pages: DataFrame) -> DataFrame:
    """(kind, host, leaf): tag paths that hold content, from rows (kind, host, stats).

    Text and punctuation per node are aggregated by root-to-leaf path over all pages of a host, smoothed along the order
    in which the paths stand on its pages, and fused as their geometric mean. A path is selected from CUT times the host's
    mean, weighted by text. The content section is the innermost one with REGION of the ratios of all selected nodes, and a
    path is content where its own section lies there and holds a selected path, unless it is an unselected paragraph of its own
    class. Windows run over a host's distinct paths, not its pages.
    """
    s = pages.select("kind", "host", F.explode("stats").alias("s")).select("kind", "host", "s.*")
    leaf = s.groupBy("kind", "host", "leaf").agg(
        F.first("around").alias("around"), F.min("paragraph").alias("paragraph"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks"), F.sum("nodes").alias("nodes"), (F.sum("place") / F.sum("nodes")).alias("place")
    )
    leaf = materialize(leaf.withColumn("tpr", F.col("chars") / F.col("nodes")).withColumn("ppr", F.col("marks") / F.col("nodes")))
    order = Window.partitionBy("kind", "host").orderBy("place", "leaf")

    def smooth(c: str) -> F.Column:
        near = [F.lag(c).over(order), F.lead(c).over(order)]
        return (F.col(c) + NEIGHBOUR * sum(F.coalesce(x, F.lit(0.0)) for x in near)) / (1 + 2 * NEIGHBOUR)

    fused = leaf.withColumn("score", F.sqrt(smooth("tpr") * smooth("ppr")))
    mean = fused.groupBy("kind", "host").agg((F.sum(F.col("score") * F.col("chars")) / F.greatest(F.sum("chars"), F.lit(1))).alias("mean"))
    picked = fused.join(mean.select(F.col("kind").alias("_k"), F.col("host").alias("_h"), "mean"), (F.col("kind") == F.col("_k")) & F.col("host").eqNullSafe(F.col("_h"))).drop("_k", "_h")
    picked = picked.withColumn("mass", F.col("score") * F.col("nodes")).withColumn("selected", F.col("score") >= CUT * F.col("mean")).withColumn("section", F.col("around")[0])
    near = picked.where("selected").select("kind", "host", "mass", F.size("around").alias("depth"), F.posexplode("around").alias("up", "around"))
    weight = near.groupBy("kind", "host", "around").agg(F.sum("mass").alias("weight"), F.max(F.col("depth") - F.col("up")).alias("depth"))
    total = picked.where("selected").groupBy("kind", "host").agg(F.sum("mass").alias("total"))
    w = weight.alias("w").join(total.alias("t"), (F.col("w.kind") == F.col("t.kind")) & F.col("w.host").eqNullSafe(F.col("t.host")))
    region = w.where(F.col("weight") >= REGION * F.col("total")).groupBy("w.kind", "w.host").agg(F.max_by("around", F.struct("depth", "weight", "around")).alias("region"))
    inside = picked.alias("p").join(region.alias("r"), (F.col("p.kind") == F.col("r.kind")) & F.col("p.host").eqNullSafe(F.col("r.host"))).where(F.array_contains("around", F.col("region")))
    inside = inside.select("p.kind", "p.host", "leaf", "section", "selected", "paragraph", F.max("selected").over(Window.partitionBy("p.kind", "p.host", "section")).alias("holds"))
    return inside.where(F.col("holds") & (F.col("selected") | ~F.col("paragraph"))).select("kind", "host", "leaf")


def host_sets(pages: DataFrame) -> DataFrame:
    """(kind, host, freq array<long>, content array<long>) from pages with title, keys and stats. A host's lists are bounded by lines per page / MIN_SHARE and by its templates' paths, whatever its number of pages."""
    keys = repeated_keys(pages.select("kind", "host", "title", "keys")).select("kind", "host", F.col("key").alias("freq"), F.lit(None).cast("long").alias("content"))
    paths = content_paths(pages.select("kind", "host", "stats")).select("kind", "host", F.lit(None).cast("long").alias("freq"), F.col("leaf").alias("content"))
    return keys.unionByName(paths).groupBy("kind", "host").agg(F.collect_set("freq").alias("freq"), F.collect_set("content").alias("content"))


def with_sets(pages: DataFrame, sets: DataFrame) -> DataFrame:
    """pages with the lists of their (kind, host); they are broadcast only where their measured size is small."""
    sets = materialize(sets)
    lists = [c for c in sets.columns if c not in ("kind", "host")]
    size = sets.agg(F.coalesce(F.sum(sum(F.size(c) for c in lists) * 8 + 64), F.lit(0))).first()[0]
    right = sets.select(F.col("kind").alias("_kind"), F.col("host").alias("_host"), *lists)
    right = F.broadcast(right) if size <= BROADCAST_LIMIT else right
    return pages.join(right, (F.col("kind") == F.col("_kind")) & F.col("host").eqNullSafe(F.col("_host")), "left").drop("_kind", "_host")
