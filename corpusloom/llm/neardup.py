"""Near-duplicate bodies by HyperMinHash: compressed registers are banded, Jaccard is estimated with collision correction, then verified."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.hostlines import host_sets, with_sets
from corpusloom.llm.layouts import hidden, page_layouts
from corpusloom.llm.leakage import window_keys, word_hashes
from corpusloom.operators.arrow import map_rows
from corpusloom.session import BROADCAST_LIMIT, materialize

#: Registers of a signature and rows of a band: a pair of Jaccard 0.6 shares a band with probability 0.988, of 0.7 with 0.9999, of 0.8 with 1 - 5e-8.
REGISTERS, ROWS = 128, 4
#: Bodies of a band that are joined at once; larger bands are compared block by block.
BLOCK = 256
#: Mantissa bits kept beside the leading-zero count of a register.
MANTISSA = 10
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct 32-bit hashes of the runs of width words, sorted; words: their 32-bit hashes."""
    if len(words) < width:
        return np.empty(0, np.uint32)
    return np.unique((window_keys(words.astype(np.uint64), width) >> np.uint64(32)).astype(np.uint32))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: of each bucket's least hash, the leading zeros and the MANTISSA bits after them.

    Each bucket has its own permutation, so that short texts leave none empty.
    """
    x = shingles ^ (shingles >> np.uint32(15))
    y = x[None, :] * _A[:, None]
    y += _B[:, None]
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x85EBCA6B)
    least = y.min(axis=1).astype(np.uint64)
    lead = np.clip(31 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))).astype(np.int64), 0, 31)
    mant = ((least << (lead + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return ((lead.astype(np.uint64) << np.uint64(MANTISSA)) | mant).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard from two signatures; registers that agree by chance are taken off.

    Least hashes of n and m elements are near exponential, so two different ones share leading zeros and mantissa with
    probability about 0.72 * 2^-MANTISSA * nm / (n + m)^2 * 2.
    """
    chance = 1.44 * n * m / (n + m) ** 2 / (1 << MANTISSA)
    same = float(np.count_nonzero(a == b)) / len(a)
    return max(0.0, (same - chance) / (1 - chance))


def _bands(registers: str) -> F.Column:
    """Keys of the bands of stored registers, computed where they are exploded."""
    return F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(F.substring(registers, i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i, F.col("kind")))


def page_words(pages: DataFrame) -> DataFrame:
    """Each page's layout with 32-bit hashes of its words and their number in each block: the only pass over the sources."""

    def words(page, form):  # noqa: ANN001, ANN202
        w, at = word_hashes([b.text for b in page.blocks])
        counts = np.bincount(at, minlength=len(page.blocks)).astype(np.int32)
        return counts.tobytes(), zlib.compress(w.astype(np.uint32).tobytes(), 1)

    return page_layouts(pages, "counts binary, words binary", words)


def _registers(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.col("body").alias(side), F.col("size").alias(f"n{side}"), F.col("registers").alias(f"r{side}"))


def _candidates(reps: DataFrame, least: float) -> DataFrame:
    """(a, b): bodies with a < b that share a band of registers and whose estimate reaches least.

    Bands of up to BLOCK bodies are joined by themselves, with 16 bytes a row, and the registers of the pairs found are
    compared. A larger band is cut into blocks of about BLOCK bodies by their hash; its blocks carry their registers, and
    each pair of blocks is one row of work, compared in numpy, so that no task holds a band and only what passes is emitted.
    """
    bands = reps.select("body", F.explode(_bands("registers")).alias("h"))
    n = materialize(bands.groupBy("h").agg(F.count("*").alias("c"), F.min("body").alias("a"), F.max("body").alias("b")).where("c > 1"))
    two = n.where("c = 2").select("a", "b")
    some, large = n.agg(F.count_if(F.col("c").between(3, BLOCK)), F.count_if(F.col("c") > BLOCK)).first()
    wanted = n.where(F.col("c").between(3, BLOCK)).select("h")
    more = bands.join(F.broadcast(wanted) if some * 48 <= BROADCAST_LIMIT else wanted, "h", "left_semi")
    x, y = more.alias("x"), more.alias("y")
    many = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.body") < F.col("y.body"))).select(F.col("x.body").alias("a"), F.col("y.body").alias("b"))
    few = two.unionByName(many).distinct().join(_registers(reps, "a"), "a").join(_registers(reps, "b"), "b")

    def near(a, b, na, nb, ra, rb):  # noqa: ANN001, ANN202
        if min(na, nb) < least * max(na, nb):
            return []
        return [(a, b)] if estimate(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16), na, nb) >= least else []

    few = map_rows(few.select("a", "b", "na", "nb", "ra", "rb"), "a long, b long", near)
    if not large:
        return few
    hot = bands.join(n.where(F.col("c") > BLOCK).select("h", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "h")
    hot = hot.withColumn("part", F.pmod(F.xxhash64("body"), F.col("parts")).cast("int")).join(reps.select("body", "size", "registers"), "body")
    block = hot.groupBy("h", "part").agg(F.array_sort(F.collect_list(F.struct("body", "size", "registers"))).alias("rows"))
    block = block.select("h", "part", F.col("rows.body").alias("ids"), F.col("rows.size").alias("sizes"), F.col("rows.registers").alias("regs"))
    p, q = block.alias("p"), block.alias("q")
    work = p.join(q, (F.col("p.h") == F.col("q.h")) & (F.col("p.part") <= F.col("q.part"))).select("p.ids", "p.sizes", "p.regs", F.col("q.ids").alias("ids2"), F.col("q.sizes").alias("sizes2"), F.col("q.regs").alias("regs2"))

    def blocks(ids, sizes, regs, ids2, sizes2, regs2):  # noqa: ANN001, ANN202
        r2 = np.frombuffer(b"".join(regs2), np.uint16).reshape(len(ids2), REGISTERS)
        ids2, m = np.array(ids2), np.array(sizes2, np.float64)
        out = []
        for i, n, r in zip(ids, sizes, regs):
            chance = 1.44 * n * m / (n + m) ** 2 / (1 << MANTISSA)
            j = ((r2 == np.frombuffer(r, np.uint16)).mean(axis=1) - chance) / (1 - chance)
            for k in ids2[(j >= least) & (np.minimum(n, m) >= least * np.maximum(n, m))].tolist():
                if i != k:
                    out.append((min(i, k), max(i, k)))
        return out

    return few.unionByName(map_rows(work, "a long, b long", blocks)).distinct()


def near_duplicates(pages: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (kind, id, body) gives each record the class of its exact body; links (kind, a, b, jaccard) joins classes.

    Registers are stored with each body, banded, and compared by the collision-corrected estimate; only what passes it
    with a slack of four standard errors has its whole shingle sets compared. Copies of one body are one class and are
    never paired with each other, however many there are. Links are listed with a < b. Records without a body of
    min_words words (or of one run of width words) are in neither; an empty table gives empty results.
    """
    words = materialize(page_words(pages))
    known = with_sets(words.drop("keys", "stats", "title"), host_sets(words.select("kind", "host", "title", "keys", "stats")))
    cols = ("cells", "counts", "words", "freq", "content")

    def body(kind, cells, counts, words, freq, content):  # noqa: ANN001, ANN202
        shown = ~np.array(hidden(kind, cells, freq, content), np.bool_)
        w = np.frombuffer(zlib.decompress(words), np.uint32)
        return w[np.repeat(shown, np.frombuffer(counts, np.int32))] if len(shown) else w

    def signed(kind, rid, *rest):  # noqa: ANN001, ANN202
        w = body(kind, *rest)
        if len(w) < max(min_words, width):
            return []
        s = shingle_hashes(w, width)
        return [(kind, rid, xxhash.xxh3_64_intdigest(kind.encode() + w.tobytes()) - (1 << 63), len(s), signature(s).tobytes())]

    bodies = materialize(map_rows(known.select("kind", "id", *cols), "kind string, id long, body long, size int, registers binary", signed))
    members = bodies.select("kind", "id", "body").distinct()
    reps = bodies.dropDuplicates(["body"])
    pairs = materialize(_candidates(reps, threshold - 4 * (threshold * (1 - threshold) / REGISTERS) ** 0.5))
    wanted = pairs.select(F.col("a").alias("body")).unionByName(pairs.select(F.col("b").alias("body"))).distinct()
    wanted = materialize(bodies.groupBy("body").agg(F.min(F.struct("kind", "id")).alias("at")).join(wanted, "body").select("body", "at.*"))

    def shingled(kind, rid, key, *rest):  # noqa: ANN001, ANN202
        return [(kind, key, shingle_hashes(body(kind, *rest), width).tobytes())]

    chosen = known.join(F.broadcast(wanted) if wanted.count() * 64 <= BROADCAST_LIMIT else wanted, ["kind", "id"]).select("kind", "id", "body", *cols)
    sets = materialize(map_rows(chosen, "kind string, body long, shingles binary", shingled).dropDuplicates(["body"]))
    left = sets.select("kind", F.col("body").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("body").alias("b"), F.col("shingles").alias("sb"))

    def compared(kind, a, b, sa, sb):  # noqa: ANN001, ANN202
        x, y = np.frombuffer(sa, np.uint32), np.frombuffer(sb, np.uint32)
        both = len(np.intersect1d(x, y, assume_unique=True))
        j = both / (len(x) + len(y) - both)
        return [(kind, a, b, j)] if j >= threshold else []

    full = pairs.join(left, "a").join(right, "b").select("kind", "a", "b", "sa", "sb")
    return members, map_rows(full, "kind string, a long, b long, jaccard double", compared)


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id_a, id_b) with id_a < id_b: all pairs of records whose bodies are equal or linked.

    The result itself has a row for each pair, which is what it is asked for; a hot class is split by the join's skew handling.
    """
    m = members.select("kind", "id", "body")
    same = m.alias("x").join(m.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.body") == F.col("y.body")) & (F.col("x.id") < F.col("y.id")))
    same = same.select(F.col("x.kind").alias("kind"), F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    a = m.select("kind", F.col("id").alias("p"), F.col("body").alias("a"))
    b = m.select("kind", F.col("id").alias("q"), F.col("body").alias("b"))
    across = links.select("kind", "a", "b").join(a, ["kind", "a"]).join(b, ["kind", "b"])
    return same.unionByName(across.select("kind", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")))


def duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, class_id, links): one row a record, with its class of equal bodies and the number of other classes its body is linked to."""
    ends = links.select("kind", F.col("a").alias("body")).unionByName(links.select("kind", F.col("b").alias("body")))
    n = ends.groupBy("kind", "body").agg(F.count("*").alias("links"))
    return members.join(n, ["kind", "body"], "left").select("kind", "id", F.col("body").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
