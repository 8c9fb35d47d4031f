"""Texts of varying length in containers of fixed capacity (problem 7): a grouping genetic algorithm on islands.

Texts are spread over blocks of a bounded size by a hash of their id; each block is packed by several islands,
each with a population of packings. Crossover injects whole well-filled containers of one parent into the
other, drops the containers that held the same texts, exchanges one or two texts of the others for displaced
ones that fill them better, and best-fits what is left; mutation dissolves some containers and puts their texts
back in the same way. Between rounds the elites migrate to the next island of the block; rounds end when no
block has gained a container. Each block's best packing stands; its worst-filled containers are dissolved,
pooled with those of other blocks, and packed again in the same way, level by level, until one block is left,
so that unused space doesn't grow with the number of blocks.

A text longer than the capacity, and no other, is split: into full containers and one rest that is packed as
a text of its own. Every text is placed, whatever its size.

Scale: a block is a few thousand numbers in one task, all blocks and islands run side by side, and only
sizes and packings move, never texts. Python is needed here: a packing is built item by item.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderite.session import stored

BLOCK_ITEMS = 4_000
ISLANDS, ROUNDS, OFFSPRING, POPULATION = 2, 4, 30, 6
#: Blocks whose worst containers are pooled, and the share of a block's containers that is dissolved.
POOL, DISSOLVED = 16, 0.06

Packing = list[list[int]]


def best_fit(bins: Packing, fills: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Puts each item, largest first, into the container it leaves least room in; opens one if none has room."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            b = len(bins)
            bins.append([i])
            fills.append(sizes[i])
        else:
            b = room.pop(at)[1]
            bins[b].append(i)
            fills[b] += sizes[i]
        insort(room, (capacity - fills[b], b))


def fitness(bins: Packing, sizes: list[int], capacity: int) -> float:
    """Mean squared fill: it prefers full containers beside emptier ones to evenly filled ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def exchange(bins: Packing, fills: list[int], free: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Swaps one or two texts of containers for one or two free ones that leave less room; returns what is free then.

    Each swap fills its container better and frees smaller texts, which are easier to place.
    """
    pool = sorted((sizes[i], i) for i in free)
    order = [b for b in range(len(bins)) if fills[b] < capacity]
    rng.shuffle(order)
    for b in order:
        if not pool:
            break
        held = bins[b]
        picks = [(i,) for i in held] + [(held[0], i) for i in held[1:]] if len(held) > 1 else [(i,) for i in held]
        best, room = None, capacity - fills[b]
        for out in picks:
            freed = sum(sizes[i] for i in out)
            most = freed + room
            at = bisect_left(pool, (most + 1, -1)) - 1  # the largest free text that fits
            if at >= 0 and pool[at][0] > freed and (best is None or pool[at][0] - freed > best[0]):
                best = (pool[at][0] - freed, out, (at,))
            low, high = 0, len(pool) - 1
            while low < high:  # the two free ones that fit best together
                both = pool[low][0] + pool[high][0]
                if both > most:
                    high -= 1
                    continue
                if both > freed and (best is None or both - freed > best[0]):
                    best = (both - freed, out, (low, high))
                low += 1
            if best and best[0] == room:
                break
        if best:
            gain, out, taken = best
            moved = [pool[k][1] for k in taken]
            for k in sorted(taken, reverse=True):
                pool.pop(k)
            bins[b] = [i for i in held if i not in out] + moved
            fills[b] += gain
            for i in out:
                insort(pool, (sizes[i], i))
    return [i for _, i in pool]


def placed(bins: Packing, free: list[int], sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """bins with the free texts put back: by exchange while that fills containers, the rest by best fit."""
    fills = [sum(sizes[i] for i in x) for x in bins]
    best_fit(bins, fills, exchange(bins, fills, free, sizes, capacity, rng), sizes, capacity)
    return bins


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """a with some of the best-filled containers of b, whole; texts they displace are put back."""
    by_fill = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    good = by_fill[: max(1, len(by_fill) // 2)]
    injected = rng.sample(good, max(1, len(good) // 3))
    taken = {i for x in injected for i in x}
    bins, displaced = [list(x) for x in injected], []
    for x in a:
        if taken.isdisjoint(x):
            bins.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return placed(bins, displaced, sizes, capacity, rng)


def mutate(a: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """a with its worst-filled and some other containers dissolved and their texts put back."""
    by_fill = sorted(a, key=lambda x: sum(sizes[i] for i in x))
    few = max(2, len(a) // 40)
    opened = [*range(min(few, len(a))), *rng.sample(range(len(a)), min(few, len(a)))]
    gone = set(opened)
    return placed([list(x) for k, x in enumerate(by_fill) if k not in gone], [i for k in gone for i in by_fill[k]], sizes, capacity, rng)


def evolve(sizes: list[int], capacity: int, population: list[Packing], offspring: int, rng: random.Random) -> list[Packing]:
    """The population after some offspring, best first; stops where no packing can have fewer containers."""
    least = math.ceil(sum(sizes) / capacity)
    while len(population) < POPULATION:
        # the first is best-fit decreasing; the others place some texts in random order before
        bins: Packing = []
        fills: list[int] = []
        head = rng.sample(range(len(sizes)), len(sizes) * len(population) // (3 * POPULATION))
        for i in head:
            if fills and fills[-1] + sizes[i] <= capacity:
                bins[-1].append(i)
                fills[-1] += sizes[i]
            else:
                bins.append([i])
                fills.append(sizes[i])
        first = set(head)
        best_fit(bins, fills, [i for i in range(len(sizes)) if i not in first], sizes, capacity)
        population.append(bins)
        if len(bins) == least:
            break
    score = {id(p): fitness(p, sizes, capacity) for p in population}
    for _ in range(offspring):
        population.sort(key=lambda p: (len(p), -score[id(p)]))
        if len(population[0]) == least or len(population) < 2:
            break
        a, b = rng.sample(population[: max(2, len(population) // 2 + 1)], 2)
        child = crossover(a, b, sizes, capacity, rng) if rng.random() < 0.5 else mutate(population[0], sizes, capacity, rng)
        population[-1] = child
        score[id(child)] = fitness(child, sizes, capacity)
    return sorted(population, key=lambda p: (len(p), -fitness(p, sizes, capacity)))


def _labels(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(p):
        for i in items:
            out[i] = b
    return out


def _bins(labels: list[int]) -> Packing:
    out: Packing = [[] for _ in range(max(labels) + 1)]
    for i, b in enumerate(labels):
        out[b].append(i)
    return out


def _island_round(number: int, offspring: int):
    """Evolves island rows: (container, capacity, block, island, sizes, elites) -> the same with new elites."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                rng = random.Random(f"{r['container']}/{r['block']}/{r['island']}/{number}")
                ranked = evolve(r["sizes"], r["capacity"], [_bins(e) for e in r["elites"]], offspring, rng)
                r["elites"] = [_labels(p, len(r["sizes"])) for p in ranked[:2]]
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return run


_ISLAND = "container string, capacity bigint, block bigint, island int, sizes array<int>, elites array<array<int>>"


def pack_blocks(items: DataFrame, islands: int = ISLANDS, rounds: int = ROUNDS, offspring: int = OFFSPRING) -> DataFrame:
    """(container, capacity, block, doc_id, part, tokens, bin): each block of items packed by its islands.

    items: container, capacity, block, doc_id, part, tokens; a block has a bounded number of them.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col("tokens").cast("int").alias("size"), "doc_id", "part")), asc=False)
    blocks = stored(items.groupBy("container", "capacity", "block").agg(ordered.alias("held")))
    state = blocks.select("container", "capacity", "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("held.size").alias("sizes"), F.array().cast("array<array<int>>").alias("elites"))
    # islands are little data and much work: a fixed number of tasks keeps the optimizer from joining them to few
    lanes = 3 * items.sparkSession.sparkContext.defaultParallelism
    fewest = None
    for number in range(rounds):
        state = stored(state.repartition(lanes, "container", "block", "island").mapInArrow(_island_round(number, offspring), _ISLAND))
        # one number: how many containers the best packings of all blocks have
        best_of = state.groupBy("container", "block").agg(F.min(F.array_max(F.get("elites", F.lit(0)))).alias("n"))
        bins = best_of.agg(F.sum("n").alias("n")).first()["n"]
        if bins == fewest or number == rounds - 1:
            break
        fewest = bins
        # each island takes the next one's best along with its own
        ring = state.withColumn("from", F.pmod(F.col("island") + 1, F.lit(islands)))
        sent = state.select("container", "block", F.col("island").alias("from"), F.slice("elites", 1, 1).alias("guests"))
        state = ring.join(sent, ["container", "block", "from"]).select("container", "capacity", "block", "island", "sizes", F.concat("elites", "guests").alias("elites"))
    used = F.array_max(F.get("elites", F.lit(0)))
    best = state.groupBy("container", "block").agg(F.min_by(F.get("elites", F.lit(0)), F.struct(used, "island")).alias("labels"))
    placed = blocks.join(best, ["container", "block"]).select("container", "capacity", "block", F.explode(F.arrays_zip("held", "labels")).alias("x"))
    return placed.select("container", "capacity", "block", "x.held.doc_id", "x.held.part", F.col("x.held.size").cast("bigint").alias("tokens"), F.col("x.labels").alias("bin"))


def pack(sizes: DataFrame, containers: DataFrame, block_items: int = BLOCK_ITEMS, **effort: int) -> DataFrame:
    """(container, bin_id, doc_id, part, token_start, token_end): where each text, or part of one, goes.

    sizes: doc_id, tokens; containers: container, capacity_tokens. Tokens token_start <= t < token_end are the
    part. Texts without tokens take no room and have no row, nor have rows without doc_id; containers with no
    positive capacity are left out. A doc_id that comes twice is two texts of one name (part goes on counting).
    """
    kinds = containers.where("container IS NOT NULL AND capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    twins = sizes.where("doc_id IS NOT NULL AND tokens > 0").groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("copies"))
    texts = twins.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    # a row for each kind of container is all that is collected; every text goes into each kind
    each = [F.struct(F.lit(r["container"]).alias("container"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in kinds.orderBy("container").collect()]
    none = F.array().cast("array<struct<container:string,capacity:bigint>>")
    every = texts.select("*", F.explode(F.array(*each) if each else none).alias("_kind")).select("doc_id", "tokens", "copy", "_kind.*")
    full = F.floor(F.col("tokens") / F.col("capacity"))
    rest = F.col("tokens") - full * F.col("capacity")
    whole = every.where("tokens >= capacity").select("container", "capacity", "doc_id", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("part"))
    split = whole.select("container", F.concat_ws("-", F.lit("full"), "doc_id", "copy", "part").alias("bin_id"), "doc_id", F.concat_ws(".", "copy", "part").alias("part"), (F.col("part") * F.col("capacity")).alias("token_start"), ((F.col("part") + 1) * F.col("capacity")).alias("token_end"))
    loose = stored(every.where(rest > 0).select("container", "capacity", "doc_id", F.concat_ws(".", "copy", full).alias("part"), rest.alias("tokens"), (full * F.col("capacity")).alias("token_start")))
    counted = loose.groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()  # one number for each kind of container
    blocks = {r["container"]: max(1, math.ceil(r["n"] / block_items)) for r in counted}
    if not blocks:
        return split
    items = loose.select("container", "capacity", "doc_id", "part", "tokens", F.pmod(F.xxhash64("doc_id", "part"), _per_kind(blocks)).alias("block"))
    level, left, done = 0, max(blocks.values()), []
    while True:
        packed = stored(pack_blocks(items, **effort))
        fill = packed.groupBy("container", "block", "bin").agg(F.sum("tokens").alias("held"))
        named = F.concat_ws("-", F.lit(str(level)), "block", "bin").alias("bin_id")
        if left == 1:
            done.append(packed.select("container", "doc_id", "part", named))
            break
        # a block has a bounded number of containers, so has each partition of this window
        worst = F.percent_rank().over(Window.partitionBy("container", "block").orderBy("held", "bin"))
        opened = fill.select("container", "block", "bin", (worst <= DISSOLVED).alias("opened"))
        marked = stored(packed.join(opened, ["container", "block", "bin"]))
        done.append(marked.where("NOT opened").select("container", "doc_id", "part", named))
        # as many blocks as keep the opened texts bounded, but fewer than before, so that one is left in the end
        freed = {r["container"]: r["n"] for r in marked.where("opened").groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks = {k: max(1, min(math.ceil(freed.get(k, 0) / block_items), math.ceil(n / POOL))) for k, n in blocks.items()}
        items = marked.where("opened").select("container", "capacity", "doc_id", "part", "tokens", F.pmod(F.xxhash64("block", "bin"), _per_kind(blocks)).alias("block"))
        left, level = max(blocks.values()), level + 1
    binned = done[0]
    for d in done[1:]:
        binned = binned.unionByName(d)
    placed = binned.join(loose.select("container", "doc_id", "part", "tokens", "token_start"), ["container", "doc_id", "part"])
    return split.unionByName(placed.select("container", "bin_id", "doc_id", "part", "token_start", (F.col("token_start") + F.col("tokens")).alias("token_end")))


def _per_kind(numbers: dict[str, int]) -> Column:
    """A number for each kind of container, as a literal map."""
    return F.create_map(*[F.lit(x) for k, n in numbers.items() for x in (k, n)])[F.col("container")]


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, bins, tokens, fewest_bins, fill): fewest_bins is what the tokens need at least."""
    kinds = containers.groupBy("container").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    bins = packed.groupBy("container", "bin_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held"))
    total = bins.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("held").alias("tokens")).join(kinds, "container")
    return total.select("container", "capacity", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest_bins"), (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("fill"))


def placement_faults(packed: DataFrame, sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, texts, overfull, torn, lost): the texts placed, and how often a packing breaks its rules.

    overfull: containers beyond their capacity; torn: texts in parts though they fit whole; lost: texts whose parts
    don't cover each of their tokens once. sizes: unique doc_id, tokens.
    """
    kinds = containers.groupBy("container").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    over = packed.groupBy("container", "bin_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held")).join(kinds, "container").groupBy("container").agg(F.count_if(F.col("held") > F.col("capacity")).alias("overfull"))
    # parts cover a text once if they reach its end, are as long together, and each begins where another ends
    parts = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("token_end") - F.col("token_start")).alias("held"), F.max("token_end").alias("end"), F.min("token_start").alias("start"), F.sum("token_start").alias("starts"), F.sum("token_end").alias("ends"))
    met = sizes.where("tokens > 0").select("doc_id", "tokens").join(parts, "doc_id", "left").join(kinds, "container", "left")
    whole = (F.col("held") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("start") == 0) & (F.col("ends") - F.col("starts") == F.col("tokens"))
    each = met.groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("torn"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("lost"))
    return each.join(over, "container").select("container", "texts", "overfull", "torn", "lost")
