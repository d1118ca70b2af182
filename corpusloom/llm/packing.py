"""Filling containers of fixed capacity: a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.operators.arrow import map_rows
from corpusloom.session import materialize

#: Items of a block, islands of a block, individuals of an island, and generations before and after migration at least.
BLOCK, ISLANDS, POPULATION, GENERATIONS = 4000, 2, 6, 6
#: Generations without a better packing after which an island that is above the lower bound stops.
PATIENCE = 60
#: Containers filled to less are opened again in a further round of blocks, until what is left is one block.
GOOD = 0.995
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoding(path: str):  # noqa: ANN202
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): size of every text in tokens of the byte-level tokenizer at the path; null and empty texts have 0."""
    st = T._parse_datatype_string("doc_id long, tokens int")
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int32())], schema=arrow)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, st)


class Packing:
    """Containers as lists of item numbers, with their loads."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]) -> None:
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> float:
        """Mean of squared fills: full containers beside empty room beat evenly filled ones."""
        return sum((x / capacity) ** 2 for x in self.loads) / max(1, len(self.loads))


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Puts items, largest first, each into the container that it leaves least room in; opens containers as needed."""
    free = sorted((capacity - x, k) for k, x in enumerate(loads))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
            loads[k] += sizes[i]
            insort(free, (room - sizes[i], k))
        else:
            bins.append([i])
            loads.append(sizes[i])
            insort(free, (capacity - sizes[i], len(bins) - 1))


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """b's well-filled containers are injected whole into a; a's containers with the same items go, and what they held besides is best-fitted."""
    order = sorted(range(len(b.bins)), key=lambda k: -b.loads[k])
    take = [k for k in order[: max(1, len(order) * 2 // 3)] if rng.random() < 0.5]
    inside = {i for k in take for i in b.bins[k]}
    bins, loads = [list(b.bins[k]) for k in take], [b.loads[k] for k in take]
    displaced: list[int] = []
    for items, load in zip(a.bins, a.loads):
        if inside.isdisjoint(items):
            bins.append(list(items))
            loads.append(load)
        else:
            displaced.extend(i for i in items if i not in inside)
    best_fit(bins, loads, displaced, sizes, capacity)
    return Packing(bins, loads)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """The emptiest containers and a few others are dissolved and their items best-fitted again."""
    n = len(p.bins)
    gone = set(sorted(range(n), key=lambda k: p.loads[k])[: max(1, n // 20)]) | {rng.randrange(n) for _ in range(max(1, n // 20))}
    bins = [list(x) for k, x in enumerate(p.bins) if k not in gone]
    loads = [x for k, x in enumerate(p.loads) if k not in gone]
    best_fit(bins, loads, [i for k in gone for i in p.bins[k]], sizes, capacity)
    return Packing(bins, loads)


def evolve(sizes: list[int], capacity: int, seed: int, start: list[list[int]], generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """Best packing of an island; start: packings of other islands, as the container number of every item.

    An island goes on beyond its generations while it is above the lower bound of containers and still gets better.
    """
    rng = random.Random(seed)
    pool: list[Packing] = []
    for s in start:
        bins: list[list[int]] = [[] for _ in range(max(s, default=-1) + 1)]
        for i, k in enumerate(s):
            bins[k].append(i)
        bins = [x for x in bins if x]
        pool.append(Packing(bins, [sum(sizes[i] for i in x) for x in bins]))
    while len(pool) < population:
        items = list(range(len(sizes)))
        bins, loads = [], []
        if len(pool) % 2 and len(items) > 2:  # a random part first, for variety
            rng.shuffle(items)
            part = items[: len(items) // 3]
            for i in part:
                if loads and loads[-1] + sizes[i] <= capacity:
                    bins[-1].append(i)
                    loads[-1] += sizes[i]
                else:
                    bins.append([i])
                    loads.append(sizes[i])
            items = items[len(items) // 3 :]
        best_fit(bins, loads, items, sizes, capacity)
        pool.append(Packing(bins, loads))
    key = lambda p: (-len(p.bins), p.fitness(capacity))
    pool.sort(key=key, reverse=True)
    bound = math.ceil(sum(sizes) / capacity)
    done = stale = 0
    while len(sizes) > 1 and generations and (done < generations or len(pool[0].bins) > bound and stale < PATIENCE):
        done, stale, best = done + 1, stale + 1, key(pool[0])
        a, b = rng.sample(range(len(pool)), 2)
        child = crossover(pool[min(a, b)], pool[max(a, b)], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        pool.append(child)
        pool.sort(key=key, reverse=True)
        pool.pop()
        if key(pool[0]) > best:
            stale = 0
    return pool[0]


def _assignment(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, items in enumerate(p.bins):
        for i in items:
            out[i] = k
    return out


def _pack_round(items: DataFrame, total: int, capacity: int, turn: int) -> DataFrame:
    """(turn, block, doc_id, piece, size, bin, load): one round of blocks, each evolved by its islands, before and after they exchange their elites."""
    blocks = max(1, math.ceil(total / BLOCK))
    b = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(blocks)).cast("int"))
    rows = b.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("size", "doc_id", "piece"))).alias("items"))
    rows = materialize(rows)
    states = rows.select("block", F.col("items.size").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")).repartition(min(blocks * ISLANDS, 2000), "block", "island")

    def first(block, sizes, island):  # noqa: ANN001, ANN202
        return [(block, island, _assignment(evolve(sizes, capacity, hash((turn, block, island)), []), len(sizes)))]

    elites = materialize(map_rows(states, "block int, island int, elite array<int>", first))
    guests = elites.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("island", "elite"))).alias("elites"))
    again = states.join(guests, "block").select("block", "sizes", "island", F.col("elites.elite").alias("elites"))

    def second(block, sizes, island, found):  # noqa: ANN001, ANN202
        own = [found[island], *found[:island], *found[island + 1 :]]
        p = evolve(sizes, capacity, hash((turn, block, island, 1)), own)
        return [(block, island, len(p.bins), p.fitness(capacity), _assignment(p, len(sizes)))]

    done = map_rows(again, "block int, island int, bins int, fitness double, plan array<int>", second)
    best = done.groupBy("block").agg(F.max_by("plan", F.struct(-F.col("bins"), "fitness", -F.col("island"))).alias("plan"))
    out = rows.join(best, "block").select("block", F.explode(F.arrays_zip("items", "plan")).alias("x")).select(F.lit(turn).alias("turn"), "block", "x.items.doc_id", "x.items.piece", "x.items.size", F.col("x.plan").alias("bin"))
    load = out.groupBy("block", "bin").agg(F.sum("size").alias("load"))
    return materialize(out.join(load, ["block", "bin"]))


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(doc_id, piece, size, container, load, first): every item whole in one container of at most capacity, an item over it in pieces.

    first is the number of the item's tokens before the piece. All pieces of a large item but the last fill containers
    of their own. Items are hashed into blocks of about BLOCK items, so that no size or id is hot; what stands in
    containers below GOOD goes through further rounds, mixed anew, until it is one block or no container gets fuller.
    Null sizes count as 0, and items of size 0 are put beside others. A repeated id is one item. Ties are settled by id.
    """
    s = sizes.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.greatest(F.coalesce(F.max(size_col), F.lit(0)), F.lit(0)).cast("int").alias("n"))
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    pieces = s.withColumn("pieces", n).select("doc_id", "n", "pieces", F.explode(F.sequence(F.lit(1), "pieces")).alias("piece"))
    items = materialize(pieces.select("doc_id", "piece", F.when(F.col("piece") < F.col("pieces"), F.lit(capacity)).otherwise(F.col("n") - (F.col("pieces") - 1) * capacity).cast("int").alias("size")))
    full = items.where(F.col("size") == capacity).select("doc_id", "piece", "size", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"), F.col("size").cast("long").alias("load"))
    rest, out = items.where(F.col("size") < capacity), full
    turn, total, before = 0, rest.count(), -1
    while total:
        done = _pack_round(rest, total, capacity, turn)
        last = total <= BLOCK or total == before
        kept = done if last else done.where(F.col("load") >= GOOD * capacity)
        out = out.unionByName(kept.select("doc_id", "piece", "size", F.concat_ws("-", "turn", "block", "bin").alias("container"), "load"))
        if last:
            break
        rest = done.where(F.col("load") < GOOD * capacity).select("doc_id", "piece", "size")
        turn, before, total = turn + 1, total, rest.count()
    return out.withColumn("first", ((F.col("piece") - 1) * F.lit(capacity)).cast("long"))


def container_texts(documents: DataFrame, packed: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, piece, text): the text of every piece in its container; the pieces of a document joined give its text again.

    A cut falls on the token's place, moved back to the start of a character where a token ends inside one. Null texts
    have empty pieces.
    """
    want = packed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "first", "size", "container"))).alias("pieces"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["doc_id"])

    def cut(doc_id, text, pieces):  # noqa: ANN001, ANN202
        if len(pieces) == 1:
            return [(pieces[0]["container"], doc_id, 1, text or "")]
        enc = _encoding(tokenizer)
        ids = enc.encode_ordinary(text or "")
        raw, ends = (text or "").encode(), [0]
        for t in ids:
            ends.append(ends[-1] + len(enc.decode_single_token_bytes(t)))
        bounds = []
        for p in pieces:
            at = ends[min(p["first"], len(ids))]
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at -= 1
            bounds.append(at)
        bounds.append(len(raw))
        return [(p["container"], doc_id, p["piece"], raw[a:b].decode()) for p, a, b in zip(pieces, bounds, bounds[1:])]

    return map_rows(texts.join(want, "doc_id"), "container string, doc_id long, piece int, text string", cut, ["doc_id", "text", "pieces"])
