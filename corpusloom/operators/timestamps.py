"""Date columns in mixed notations to UTC instants (method: one regex alternation, integer day arithmetic)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.dates import iso_utc, to_epoch
from corpusloom.operators.arrow import map_rows

FIELDS = ("datepublished", "datemodified", "article_published_time")


def normalize_timestamps(rows: DataFrame, sites: DataFrame, id_col: str = "article_id", fields: tuple[str, ...] = FIELDS, host_col: str = "host") -> DataFrame:
    """(id, field, raw, utc, resolved) for every non-null value of the date columns.

    utc is YYYY-MM-DDTHH:MM:SSZ, or null where the value means no single instant (text that is no date, dates out of the
    calendar, local times where the site's zone is unknown or skipped that time). A null or unknown host counts as a
    site without locale and zone. Rows delivered twice give one row. Empty tables give no rows; other columns of either
    table play no part. The sites side is one row per host; where a host is listed twice its first zone in order counts.
    """
    s = sites.groupBy(F.col("host").alias("_h")).agg(F.min("locale").alias("_l"), F.min("time_zone").alias("_z"))
    long = rows.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_h"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields])).alias("x"))
    long = long.select("_id", "_h", "x.field", "x.raw").where(F.col("raw").isNotNull()).distinct()

    def one(rid, field, raw, loc, zone):  # noqa: ANN001, ANN202
        e = to_epoch(raw, loc, zone)
        return [(rid, field, raw, None if e is None else iso_utc(e), e is not None)]

    kind = rows.schema[id_col].dataType.simpleString()
    return map_rows(long.join(s, "_h", "left").select("_id", "field", "raw", "_l", "_z"), f"{id_col} {kind}, field string, raw string, utc string, resolved boolean", one)
