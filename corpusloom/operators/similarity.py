"""SimHash fingerprints, banded similarity joins, and first-come leaders of near-duplicates."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import collapsed
from corpusloom.session import materialize

#: Shingles whose votes are counted at once.
VOTED_AT_ONCE = 1 << 13


@lru_cache(1 << 17)
def _blake(gram: str, size: int) -> bytes:
    return hashlib.blake2b(gram.encode(), digest_size=size).digest()


@lru_cache(1 << 17)
def _md5(gram: str, size: int) -> bytes:
    return hashlib.md5(gram.encode()).digest()[:size]


def _vote(t: str, digest: Callable[[str, int], bytes], bits: int, width: int, max_tokens: int | None) -> int | None:
    """Signed SimHash of a folded text: each shingle is hashed once and votes as often as it stands there."""
    if not t:
        return None
    counts = Counter([t] if len(t) < width else islice(map("".join, zip(*(t[i:] for i in range(width)))), max_tokens))
    size, ones, rest = bits // 8, np.zeros(bits), iter(counts.items())
    while part := list(islice(rest, VOTED_AT_ONCE)):
        m = np.unpackbits(np.frombuffer(b"".join(digest(g, size) for g, _ in part), np.uint8).reshape(len(part), size), axis=1)
        ones += np.array([n for _, n in part], np.float64) @ m.astype(np.float64)
    v = int.from_bytes(np.packbits(2 * ones >= counts.total()).tobytes(), "big")
    return v - (1 << bits) if v >= 1 << bits - 1 else v


def _blake_simhash(text: str, bits: int = 64, width: int = 4, max_length: int | None = None, max_tokens: int | None = None) -> int | None:
    return _vote(" ".join(text.lower().split())[:max_length], _blake, bits, width, max_tokens)


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    """64-bit SimHash over all runs of four characters of the whole text, hashed by blake2b, as a signed long; null for no text."""
    return pd.Series([None if t is None else _blake_simhash(t) for t in text], dtype="Int64")


def simhash_md5(text: Column, width: int = 4, max_length: int | None = None, max_tokens: int | None = None) -> Column:
    """The same votes over the first 64 bits of md5, of the text folded as in ngrams; the whole text unless a bound is given."""

    @F.pandas_udf(T.LongType())
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _vote(t, _md5, 64, width, max_tokens) for t in text], dtype="Int64")

    return run(collapsed(text, max_length))


def simhash_hex(v: Column) -> Column:
    return F.lpad(F.lower(F.hex(v)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(v: Column, max_distance: int = 3) -> Column:
    """array(struct(band, value)): max_distance + 1 runs of bits from the low end; two values within the distance share a run."""
    n = max_distance + 1
    sizes = [64 // n + (i < 64 % n) for i in range(n)]
    at, out = 0, []
    for i, s in enumerate(sizes):
        out.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(v, at).bitwiseAND(F.lit((1 << s) - 1 if s < 63 else -1)).alias("value")))
        at += s
    return F.array(*out)


def block_keys(v: Column, max_distance: int = 3) -> Column:
    """array of keys: the value is cut into twice max_distance parts, and a key is any max_distance of them together.

    Two values within the distance differ in max_distance parts at most, so that they share a key. A key holds half of
    the bits, against a quarter in bands, and its buckets stay small where a table grows.
    """
    n = 2 * max_distance
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in part) for part in combinations(range(n), n - max_distance)]
    return F.array(*[F.xxhash64(v.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)), F.lit(k)) for k, m in enumerate(masks)])


def neardup_pairs(df: DataFrame, id_col: str, fp_col: str, max_distance: int = 3) -> DataFrame:
    """(id_a, id_b, distance) with id_a < id_b: representatives of different fingerprints within the distance.

    Rows of one fingerprint are one representative (the least id), so copies never meet; null fingerprints have no pairs.
    """
    reps = df.where(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("id"))
    b = reps.select("id", "fp", F.explode(block_keys(F.col("fp"), max_distance) if max_distance else F.array("fp")).alias("key"))
    x, y = b.alias("x"), b.alias("y")
    p = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    d = distance(F.col("x.fp"), F.col("y.fp"))
    return p.where(d <= max_distance).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), d.alias("distance")).distinct()


def _in_order(left: list[Row], ids: DataFrame) -> DataFrame:
    """(id, decided) of open ids, from all their earlier neighbours that are not near ones: (id, before, state of before) in left."""
    before: dict = {}
    for i, b, bs in left:
        before.setdefault(i, []).append((b, bs))
        if bs == "open":
            before.setdefault(b, [])
    kept: dict = {}
    for i in sorted(before):
        kept[i] = not any(bs == "leader" or kept[b] for b, bs in before[i])
    rows = [(i, "leader" if k else "near") for i, k in kept.items()]
    return ids.sparkSession.createDataFrame(rows, T.StructType([ids.schema["id"], T.StructField("decided", T.StringType())]))


def leaders(pairs: DataFrame, nodes: DataFrame, id_col: str, max_rounds: int | None = None, at_driver: int = 100_000) -> DataFrame:
    """(id, leader): the result of taking ids in order and keeping each that is near no kept one; a near id gets its nearest kept one, ties to the least.

    Each round decides all ids whose earlier neighbours are decided, at least the least open one; rounds are
    checkpointed to the shared folder and go on until none is open. A chain decides one id a round, so once no more
    than at_driver pairs of open ids with leaders or open ids are left, the driver takes these in order. Over max_rounds it raises.
    """
    e = materialize(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("before"), "distance"))
    state = materialize(nodes.select(F.col(id_col).alias("id")).distinct().join(e.select("id").distinct().withColumn("has", F.lit(True)), "id", "left").select("id", F.when(F.col("has").isNull(), F.lit("leader")).otherwise(F.lit("open")).alias("state")))
    rounds = 0
    while not state.where("state = 'open'").isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"leaders: ids are still open after {max_rounds} rounds")
        rounds += 1
        seen = e.join(state.select(F.col("id").alias("before"), F.col("state").alias("bs")), "before").groupBy("id").agg(F.max(F.col("bs") == "leader").alias("any_leader"), F.min(F.col("bs") == "near").alias("all_near"))
        state = materialize(state.join(seen, "id", "left").select("id", F.when(F.col("state") != "open", F.col("state")).when(F.col("any_leader"), "near").when(F.col("all_near"), "leader").otherwise("open").alias("state")))
        open_ = state.where("state = 'open'").select("id")
        left = e.join(open_, "id").join(state.where("state != 'near'").toDF("before", "bs"), "before").select("id", "before", "bs").limit(at_driver + 1).collect() if at_driver else []
        if 0 < len(left) <= at_driver:
            state = materialize(state.join(_in_order(left, open_), "id", "left").select("id", F.coalesce("decided", "state").alias("state")))
    kept = state.where("state = 'leader'").select(F.col("id").alias("before"))
    to = e.join(kept, "before").groupBy("id").agg(F.min_by("before", F.struct("distance", "before")).alias("leader"))
    return state.join(to, "id", "left").select("id", F.when(F.col("state") == "leader", F.col("id")).otherwise(F.col("leader")).alias("leader"))


def neardup_links(df: DataFrame, id_col: str, fp_col: str, max_distance: int = 3) -> DataFrame:
    """(id_a, id_b, distance): neardup_pairs of the representatives, and at distance 0 each representative with each of its copies."""
    rows = materialize(df.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp")).distinct())  # a filter here would compute the fingerprints twice
    reps = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id_a"))
    copies = rows.join(reps, "fp").where("id_a < id").select("id_a", F.col("id").alias("id_b"), F.lit(0).alias("distance"))
    return neardup_pairs(rows, "id", "fp", max_distance).unionByName(copies)


def neardup_leaders(df: DataFrame, id_col: str, fp_col: str, max_distance: int = 3) -> DataFrame:
    """(id, leader) of every row, as leaders over all rows: a copy is never kept, so the representatives alone decide who is.

    A copy of a kept representative gets it; any other copy gets the nearest kept one before the copy, which may come
    after the representative. Kept ones are more than the distance apart, so few are near one fingerprint. A row
    without a fingerprint is its own leader.
    """
    rows = materialize(df.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp")).distinct())
    reps = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    pairs = materialize(neardup_pairs(rows, "id", "fp", max_distance))
    kept = materialize(leaders(pairs, reps, "rep").where("id = leader").select(F.col("id").alias("kept")))
    both = pairs.select("id_a", "id_b", "distance").union(pairs.select("id_b", "id_a", "distance")).toDF("rep", "kept", "distance").union(kept.select("kept", "kept", F.lit(0)))
    near = both.join(kept, "kept").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("distance", "kept"))).alias("near"))
    first = F.get(F.filter("near", lambda x: x["kept"] <= F.col("id")), F.lit(0))["kept"]
    return rows.join(reps.join(near, "rep"), "fp", "left").select("id", F.when(F.col("fp").isNull(), F.col("id")).otherwise(first).alias("leader"))
