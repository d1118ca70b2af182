"""Test passages inside documents: SimHash of item-sized windows, multi-index Hamming blocks, then exact comparison of shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.operators.arrow import map_rows
from corpusloom.session import materialize

#: Words of a window; a shorter item is one window of its own length.
WINDOW = 10
#: Windows within this Hamming distance are compared; with RADIUS + 1 blocks at least one block of such a pair is equal.
RADIUS = 1
#: Slots of the bitmap that keeps windows from the shuffle, and slots of one of its rows as Spark aggregates them.
SLOTS, BUCKET = 1 << 22, 1 << 15
#: Words simhashed at once.
CHUNK = 1 << 15

_M = 0x9E3779B97F4A7C15
_ALNUM: np.ndarray | None = None


def _alnum() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(i).isalnum() for i in range(0x32000)), np.bool_, 0x32000)
    return _ALNUM


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of its text): words are the longest runs of letters and digits, lower-cased."""
    joined = "\n".join(texts).lower()
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _alnum()
    ok = table[np.minimum(cp, len(table) - 1)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power = np.empty(int((end - start).max()), np.uint64)
    power[0] = 1
    if len(power) > 1:
        power[1:] = np.uint64(0x100000001B3)
        power = np.cumprod(power, dtype=np.uint64)
    chars = cp[ok].astype(np.uint64) + np.uint64(7)
    first = np.concatenate(([0], np.cumsum(end - start)[:-1]))
    place = np.arange(len(chars)) - np.repeat(first, end - start)
    h = np.add.reduceat(chars * power[place], first) + (end - start).astype(np.uint64)
    lengths = np.fromiter((len(t) + 1 if t.isascii() else len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    text = np.searchsorted(np.cumsum(lengths), start, side="right")
    return _mix(h), text


def window_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Ordered hash of every run of n words."""
    m = len(h) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(n):
        out = out * np.uint64(_M) + h[i : i + max(m, 0)]
    return _mix(out)


def window_simhash(h: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every run of n words, from its shingles of two words, each with the weight of its occurrences."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    s = _mix(h[:-1] * np.uint64(3) + h[1:]) if n > 1 else h
    k = max(n - 1, 1)
    out = np.empty(m, np.uint64)
    for lo in range(0, m, CHUNK):
        hi = min(m, lo + CHUNK)
        bits = np.unpackbits(s[lo : hi + k - 1].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = bits[: hi - lo].copy()
        for i in range(1, k):
            votes += bits[i : i + hi - lo]
        out[lo:hi] = np.packbits(votes > k // 2, axis=1).view("<u8").ravel()
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray, shingle: int) -> float:
    """Weighted Jaccard of two windows' runs of shingle words: every run has the number of its occurrences for its weight."""
    k = min(shingle, len(a), len(b))
    if not k:
        return 0.0
    x, n = np.unique(window_keys(a, k), return_counts=True)
    y, m = np.unique(window_keys(b, k), return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (int(n.sum()) + int(m.sum()) - both)


def _slots(values: np.ndarray, block: int) -> np.ndarray:
    return (_mix(values * np.uint64(_M) + np.uint64(block + 1)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _blocks(fp: np.ndarray, radius: int) -> list[np.ndarray]:
    """The fingerprint in radius + 1 parts: two fingerprints within the radius agree in one of them at least."""
    width = 64 // (radius + 1)
    return [(fp >> np.uint64(b * width)) & np.uint64((1 << (width if b < radius else 64 - b * width)) - 1) for b in range(radius + 1)]


def item_index(benchmark: DataFrame, window: int, radius: int) -> DataFrame:
    """(n, block, value, slot, fp, words, item_id): the items' windows of n words under each part of their fingerprint, as a table."""

    def one(item, text):  # noqa: ANN001, ANN202
        h, _ = word_hashes([text or ""])
        n = min(window, len(h))
        if item is None or not n:
            return []
        fp = window_simhash(h, n)
        out = []
        for b, v in enumerate(_blocks(fp, radius)):
            s = _slots(v, b).tolist()
            out.extend((n, b, value, s[i], f, h[i : i + n].tobytes(), item) for i, (value, f) in enumerate(zip(v.view(np.int64).tolist(), fp.view(np.int64).tolist())))
        return out

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return materialize(map_rows(items, "n int, block int, value long, slot long, fp long, words binary, item_id long", one).distinct())


def _slot_maps(index: DataFrame) -> dict[int, np.ndarray]:
    """For each window length the slots that the index uses, as bits: at most window lengths x SLOTS / 8 bytes, however many items there are."""
    slot = F.col("slot") + 1
    rows = index.groupBy("n", F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    maps: dict[int, np.ndarray] = {}
    for r in rows.toLocalIterator():
        m = maps.setdefault(r["n"], np.zeros(SLOTS, np.bool_))
        at = (r["bucket"] - 1) * BUCKET
        m[at : at + BUCKET] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")[:BUCKET].view(np.bool_)
    return maps


def _document_windows(docs: DataFrame, maps: dict[int, np.ndarray], radius: int) -> DataFrame:
    """(doc_id, n, block, value, fp, words): windows of the documents whose part of the fingerprint may be in the index."""
    shared = docs.sparkSession.sparkContext.broadcast({n: np.packbits(m) for n, m in maps.items()})
    st = T._parse_datatype_string("doc_id long, n int, block int, value long, fp long, words binary")
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = {n: np.unpackbits(m).view(np.bool_) for n, m in shared.value.items()}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in b.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (size < 1 << 21 or hi == lo):
                    size += len(texts[hi])
                    hi += 1
                h, text = word_hashes(texts[lo:hi])
                for n, slots in used.items():
                    m = len(h) - n + 1
                    if m <= 0:
                        continue
                    whole = text[:m] == text[n - 1 :]
                    sim = window_simhash(h, n)
                    for block, v in enumerate(_blocks(sim, radius)):
                        w = np.flatnonzero(slots[_slots(v, block)] & whole)
                        if not len(w):
                            continue
                        _, first = np.unique(np.stack([text[w].astype(np.uint64), window_keys(h, n)[w]]), axis=1, return_index=True)
                        w = w[first]
                        words = h[w[:, None] + np.arange(n)]
                        cols = [pa.array(ids[lo:hi][text[w]]), pa.array(np.full(len(w), n, np.int32)), pa.array(np.full(len(w), block, np.int32)), pa.array(v[w].view(np.int64)), pa.array(sim[w].view(np.int64)), pa.array([x.tobytes() for x in words], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, schema=arrow)
                lo = hi

    return docs.mapInArrow(run, st)


def leaked_items(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, radius: int = RADIUS, least: float = 1.0, shingle: int = 2) -> DataFrame:
    """(doc_id, item_id, similarity, equal): documents with a window like a window of an item, or like the whole item where it is shorter than a window.

    Windows are candidates when their SimHashes lie within the radius; the parts of the fingerprints are an equi-join key,
    so that none within it is missed. similarity is the best weighted similarity of their runs of shingle words, of at
    least least; equal says that some window has the item's words in the item's order. The index of the items is a
    table and is never held whole by a task: what is sent to all is a bitmap of bounded size, which only keeps windows
    from the shuffle. Null and empty texts and items without words match nothing; texts are processed whole; a doc_id
    that is repeated gives its items once.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    index = item_index(benchmark, window, radius)
    seen = _document_windows(docs, _slot_maps(index), radius)
    right = index.select("n", "block", "value", F.col("fp").alias("item_fp"), F.col("words").alias("item_words"), "item_id")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    width = 64 // (radius + 1)
    first = F.lit(True)  # a pair is compared under the first part in which it agrees
    for b in range(radius):
        part = F.shiftrightunsigned(apart, b * width).bitwiseAND(F.lit((1 << width) - 1))
        first = first & ((F.col("block") <= b) | (part != 0))
    pairs = seen.join(right, ["n", "block", "value"]).where((F.bit_count(apart) <= radius) & first)

    def compared(doc_id, item_id, words, item_words):  # noqa: ANN001, ANN202
        a, b = np.frombuffer(words, np.uint64), np.frombuffer(item_words, np.uint64)
        equal = words == item_words
        s = 1.0 if equal else weighted_similarity(a, b, shingle)
        return [(doc_id, item_id, s, equal)] if s >= least else []

    out = map_rows(pairs.select("doc_id", "item_id", "words", "item_words"), "doc_id long, item_id long, similarity double, equal boolean", compared)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("equal").alias("equal"))
