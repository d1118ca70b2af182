"""Lines repeated across the records of one host: found by share of records, and removed from each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.pages import host_of
from corpusloom.session import BROADCAST_LIMIT, materialize

#: A line is repeated when it stands in so many records and in this share of the records of its host.
MIN_RECORDS, MIN_SHARE = 5, 0.1


def line_key(line: F.Column) -> F.Column:
    """Words of a line, lower-cased and joined by one blank, each run of digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[^\p{L}\p{N}]+", " "))


def _records(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("id"), F.coalesce("host", host_of()).alias("host"), F.col(text_col).alias("text"))


def _keys(records: DataFrame) -> DataFrame:
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    return records.select("id", "host", F.explode(keys).alias("line_key")).where("line_key <> ''")


def _bounded(df: DataFrame, bytes_per_row: int) -> DataFrame:
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_LIMIT else df


def repeated_lines(pages: DataFrame, id_col: str = "page_id", text_col: str = "markdown", min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line_key, records, share): lines in at least min_records records and min_share of the records of their host.

    Lines are counted by 64-bit hash first, so that no text is shuffled, and (host, line) spreads a hot host; what
    passes is counted again by its text. Rows delivered twice count once. Records without text count as records of
    their host; records without host have the host of their url, and null hosts give no lines.
    """
    rec = _records(pages, id_col, text_col)
    total = rec.where(F.col("host").isNotNull()).select("host", "id").distinct().groupBy("host").agg(F.count("*").alias("total"))
    h = _keys(rec).where(F.col("host").isNotNull())
    hashed = h.select("host", F.xxhash64("line_key").alias("h"), "id").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_records)
    often = materialize(hashed.join(total, "host").where(F.col("n") >= F.col("total") * min_share).select("host", "h", "total"))
    exact = h.withColumn("h", F.xxhash64("line_key")).join(_bounded(often, 64), ["host", "h"]).select("host", "line_key", "id", "total").distinct()
    n = exact.groupBy("host", "line_key").agg(F.count("*").alias("records"), F.max("total").alias("total"))
    return n.where((F.col("records") >= min_records) & (F.col("records") >= F.col("total") * min_share)).select("host", "line_key", "records", (F.col("records") / F.col("total")).alias("share"))


def strip_repeated_lines(pages: DataFrame, id_col: str = "page_id", text_col: str = "markdown", **limits: float) -> DataFrame:
    """(id, host, text, removed): every record without the repeated lines of its host, its other lines as they stand and in order.

    A host's list is bounded by lines per record / min_share; it reaches the records by an equi-join on the host.
    Null text stays null with removed 0.
    """
    sets = repeated_lines(pages, id_col, text_col, **limits).groupBy("host").agg(F.collect_set("line_key").alias("often"))
    sets = materialize(sets)
    size = sets.agg(F.coalesce(F.sum(F.length(F.array_join("often", " "))), F.lit(0))).first()[0]
    rec = _records(pages, id_col, text_col)
    x = rec.join(F.broadcast(sets) if size <= BROADCAST_LIMIT else sets, "host", "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("often").isNull(), lines).otherwise(F.filter(lines, lambda v: ~F.array_contains("often", line_key(v))))
    return x.withColumn("kept", kept).select(F.col("id").alias(id_col), "host", F.array_join("kept", "\n").alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size("kept")).alias("removed")).dropDuplicates([id_col])
