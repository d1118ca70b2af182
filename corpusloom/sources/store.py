"""Stored state: the page cache with latest-wins writes, datasets by append, exports, templates."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSIENT = ("cache_hit", "cache_age_seconds", "revalidated", "cached_at", "not_modified")


def cache_latest(writes: DataFrame, keys: tuple[str, ...] = ("url", "mode"), time: str = "fetched_at", tie: str | None = None) -> DataFrame:
    """The last write of each key; of equal times the greatest tie column counts. Aggregated before the shuffle, so a hot key is one row a task."""
    rest = [c for c in writes.columns if c not in keys]
    o = F.struct(*[F.col(c) for c in (time, tie) if c])
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), o).alias("_x")).select(*keys, *[F.col("_x")[c].alias(c) for c in rest])


def _files(spark: SparkSession, path: str) -> tuple:
    """(file system, maker of paths) of a path on any storage the cluster reads."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def cache_upsert(spark: SparkSession, path: str, writes: DataFrame, **kw: str) -> None:
    """Writes into the cache table at path by a new version beside the old one, which a reader keeps until the swap. The storage is the cluster's."""
    fs, at = _files(spark, path)
    have = spark.read.parquet(path) if fs.exists(at(path)) else None
    new = cache_latest(writes if have is None else have.unionByName(writes, allowMissingColumns=True), **kw)
    new.write.mode("overwrite").parquet(path + ".new")
    if have is not None:
        fs.rename(at(path), at(path + ".old"))
    fs.rename(at(path + ".new"), at(path))
    fs.delete(at(path + ".old"), True)


def fresh(fetched_at: Column, now: Column, ttl_seconds: int | None) -> Column:
    """Whether an entry is at most ttl old; without ttl always."""
    return F.lit(True) if ttl_seconds is None else now - fetched_at <= ttl_seconds


def revalidation_headers(headers: Column) -> Column:
    """if-none-match and if-modified-since from a stored response's headers."""
    etag = F.coalesce(headers["etag"], headers["ETag"])
    last = F.coalesce(headers["last-modified"], headers["Last-Modified"])
    return F.map_filter(F.create_map(F.lit("if-none-match"), etag, F.lit("if-modified-since"), last), lambda k, v: v.isNotNull() & (v != ""))


def merge_headers(base: Column, extra: Column) -> Column:
    """Both maps, the right one winning."""
    b, e = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (base, extra))
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(e), k)), e)


def flatten(df: DataFrame) -> DataFrame:
    """All nested fields as a.b columns of text: null as "", lists as JSON, booleans as True and False."""

    def cols(schema: T.StructType, path: tuple[str, ...] = ()) -> list[Column]:
        out = []
        for f in schema.fields:
            p = (*path, f.name)
            c = F.col(".".join(f"`{x}`" for x in p))
            if isinstance(f.dataType, T.StructType):
                out.extend(cols(f.dataType, p))
                continue
            if isinstance(f.dataType, (T.ArrayType, T.MapType)):
                c = F.to_json(c)
            elif isinstance(f.dataType, T.BooleanType):
                c = F.when(c, "True").when(~c, "False")
            out.append(F.coalesce(c.cast("string"), F.lit("")).alias(".".join(p)))
        return out

    return df.select(*cols(df.schema))


def append_rows(df: DataFrame, name: str = "default", root: str = "storage/datasets") -> str:
    path = f"{root}/{name}"
    df.write.mode("append").json(path)
    return path


def load_rows(spark: SparkSession, name: str = "default", root: str = "storage/datasets") -> DataFrame:
    """Rows of a dataset; a line that is no object fails the read."""
    return spark.read.option("mode", "FAILFAST").json(f"{root}/{name}")


def export(df: DataFrame, path: str, form: str = "json") -> str:
    """json and jsonl keep the structure, anything else is CSV of flat columns with a header."""
    if form in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    else:
        flatten(df).write.mode("overwrite").option("header", True).csv(path)
    return path


def select_fields(df: DataFrame, paths: list[str], json_col: str | None = None) -> DataFrame:
    """Columns by dotted path, with list indexes; a missing one is null. With json_col the paths are read from its JSON."""
    if json_col:
        return df.select("*", *[F.get_json_object(json_col, "$." + re.sub(r"\.(\d+)", r"[\1]", p)).alias(p) for p in paths])
    out = []
    for p in paths:
        c = None
        for part in p.split("."):
            c = F.col(f"`{part}`") if c is None else (F.get(c, int(part)) if part.isdigit() else c[part])
        try:
            df.select(c)
            out.append(c.alias(p))
        except Exception:
            out.append(F.lit(None).cast("string").alias(p))
    return df.select(*out)


def render_template(template: str) -> Column:
    """Text of a template with {{ path }} replaced by that column; null as ""."""
    parts, last = [], 0
    for m in re.finditer(r"\{\{\s*([\w.]+)\s*\}\}", template):
        parts += [F.lit(template[last : m.start()]), F.coalesce(F.col(m.group(1)).cast("string"), F.lit(""))]
        last = m.end()
    return F.concat(*parts, F.lit(template[last:]))


def store_fields(df: DataFrame, path: str, host: str = "host") -> None:
    """Text files by host."""
    df.write.mode("append").partitionBy(host).text(path)


def save_state(spark: SparkSession, path: str, payload: dict) -> None:
    """A manifest beside checkpointed tables, written whole or not at all, on the cluster's storage."""
    fs, at = _files(spark, path)
    out = fs.create(at(path + ".tmp"), True)
    out.write(bytearray(json.dumps(payload).encode()))
    out.close()
    fs.delete(at(path), False)
    fs.rename(at(path + ".tmp"), at(path))


def load_state(spark: SparkSession, path: str) -> dict | None:
    fs, at = _files(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(at(path)) else None


# Words for true, and values of the cookie attribute.
_TRUE = ("1", "true", "yes", "on")
SAME_SITE = ("strict", "lax", "none")


def normalize_cookies(df: DataFrame) -> DataFrame:
    """Cookies in typed form, first of each (name, domain, path): blank names are dropped, unknown same_site is null, paths default to /."""
    x = df.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    flag = lambda c: F.lower(F.col(c).cast("string")).isin(*_TRUE)
    x = x.select(F.trim("name").alias("name"), F.coalesce("value", F.lit("")).alias("value"), F.lower(F.coalesce("domain", F.lit(""))).alias("domain"), F.when(F.coalesce("path", F.lit("")) == "", "/").otherwise(F.col("path")).alias("path"), flag("secure").alias("secure"), flag("http_only").alias("http_only"), F.when(F.lower("same_site").isin(*SAME_SITE), F.initcap("same_site")).alias("same_site"), F.col("expires").cast("double").alias("expires"), "ord")
    rest = [c for c in x.columns if c not in ("name", "domain", "path")]
    return x.groupBy("name", "domain", "path").agg(F.min_by(F.struct(*rest), "ord").alias("_x")).select("name", "domain", "path", *[F.col("_x")[c].alias(c) for c in rest])


def parse_cookie_header(header: Column) -> Column:
    return F.transform(F.filter(F.split(header, r";\s*"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("name"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
