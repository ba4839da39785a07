"""Filling containers of fixed capacity: bin completion by branch and bound.

Items are spread over blocks by hash; a block is packed in one task. There the largest item left is placed first and its
undominated completions are tried, the fullest first; branches whose waste already rules out fewer containers than the
incumbent are cut. The first incumbent is best-fit decreasing, and a block whose incumbent meets the lower bound is done.
Three bounds keep the search short, each a parameter that None lifts: completions kept of one container, nodes of their
enumeration, and nodes of the search per item. Without bounds the search of a block is exhaustive and its result optimal.

The emptiest container of each block, unless it is nearly full, is packed again in the next round, until one block holds
all items. No other container of a block is at most half full. A block needs enough items for several containers. Where the items of a round are so small
that it would not have them, they are first put together into bundles that stay well below a container and travel as one
item from then on, so every round leaves a small part of its tokens only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Defaults: items of a block; completions kept of one container; nodes of their enumeration; nodes of the search per item.
BLOCK_ITEMS = 2000
COMPLETIONS = 8
ENUMERATED = 200
NODES_PER_ITEM = 2
#: Containers that a block's items should fill at least; a container is nearly full if less than this part is free; items of which bundles are made in one task.
BLOCK_CONTAINERS = 4
NEARLY_FULL = 16
BUNDLED_ITEMS = 50_000
#: Limits of one call; more are an error.
MAX_LIMITS = 1000


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by the total, and by items that cannot share one (for every threshold)."""
    s = np.sort(np.asarray(sizes, np.int64))
    total = int(s.sum())
    best = -(-total // capacity)
    cum = np.r_[0, np.cumsum(s)]
    for k in np.unique(np.r_[0, s[s <= capacity // 2]]):
        big = int((s > capacity - k).sum())
        i, j, m = np.searchsorted(s, k), np.searchsorted(s, capacity // 2, "right"), np.searchsorted(s, capacity - k, "right")
        mid, small = int(m - j), int(cum[j] - cum[i])
        free = mid * capacity - int(cum[m] - cum[j])
        best = max(best, big + mid + max(0, -(-(small - free) // capacity)))
    return int(best)


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    rooms: list[tuple[int, int]] = []  # (room left, container), ascending
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(rooms, (s, -1))
        if i == len(rooms):
            bins.append([s])
            room, b = capacity - s, len(bins) - 1
        else:
            room, b = rooms.pop(i)
            bins[b].append(s)
            room -= s
        if room:
            insort(rooms, (room, b))
    return bins


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the items of b can be put into places of the sizes of a (found by first fit, so some cases are missed)."""
    rooms = sorted(a, reverse=True)
    for x in b:
        for i, r in enumerate(rooms):
            if x <= r:
                rooms[i] -= x
                break
        else:
            return False
    return True


def completions(sizes: list[int], room: int, kept_most: int | None = COMPLETIONS, enumerated: int | None = ENUMERATED) -> list[list[int]]:
    """Undominated sets of the ascending sizes that fit into the room, the fullest first.

    With bounds the enumeration takes at most so many nodes, ends at a set that fills the room, and the fullest so many
    sets are kept. None lifts a bound; with enumerated None all sets are looked at.
    """
    found: list[tuple[int, list[int]]] = []
    nodes = 0

    def go(hi: int, left: int, chosen: list[int]) -> bool:
        nonlocal nodes
        i = bisect_right(sizes, left, 0, hi)
        if not i:
            found.append((left, chosen))
            return not left and (enumerated is not None or len(chosen) == 1)  # one item that fills the room dominates all sets
        while i > 0:
            nodes += 1
            s = sizes[i - 1]
            if go(i - 1, left - s, [*chosen, s]) or enumerated is not None and nodes > enumerated:
                return True
            i = bisect_left(sizes, s, 0, i)
        return False

    go(len(sizes), room, [])
    found.sort(key=lambda x: x[0])
    kept: list[list[int]] = []
    for _, c in found:
        if not any(dominates(k, c) for k in kept):
            kept.append(c)
            if len(kept) == kept_most:
                break
    return kept


def bin_completion(sizes: list[int], capacity: int, kept_most: int | None = COMPLETIONS, enumerated: int | None = ENUMERATED, nodes_per_item: int | None = NODES_PER_ITEM) -> list[list[int]]:
    """Containers of at most the capacity that together hold all sizes, each positive and at most the capacity.

    None lifts a bound of the search; without any the number of containers is the least possible.
    """
    if not sizes:
        return []
    best = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    total, budget = sum(sizes), float("inf") if nodes_per_item is None else nodes_per_item * len(sizes)
    left, waste = sorted(sizes), 0
    stack: list[tuple[int, list[list[int]], int, int]] = []  # (largest item, its completions, the next one, waste before)
    bins: list[list[int]] = []
    while len(best) > bound and budget > 0:
        if left:
            top = left.pop()
            stack.append((top, completions(left, capacity - top, kept_most, enumerated), 0, waste))
        elif len(bins) < len(best):
            best = [list(b) for b in bins]
        budget -= 1
        while stack:  # the next completion, or back to the container before
            top, options, k, before = stack.pop()
            if len(bins) > len(stack):  # undo the completion tried last
                for s in bins.pop()[1:]:
                    insort(left, s)
            if k < len(options):
                now = before + capacity - top - sum(options[k])
                if now + total <= (len(best) - 1) * capacity:
                    for s in options[k]:
                        del left[bisect_left(left, s)]
                    bins.append([top, *options[k]])
                    stack.append((top, options, k + 1, before))
                    waste = now
                    break
            insort(left, top)  # all others waste more
        else:
            break
    return best


def _pack_block(round_no: int, search: dict[str, int | None]):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        name, block = key[0].as_py(), key[1].as_py()
        capacity = t["capacity"][0].as_py()
        size, uid = t["size"].to_numpy(), t["uid"].to_numpy()
        by_size = defaultdict(list)
        for i in np.lexsort((uid, size))[::-1]:
            by_size[int(size[i])].append(i)
        at, label, open_ = [], [], []
        for k, b in enumerate(sorted(bin_completion(size.tolist(), capacity, **search), key=sum)):
            for s in b:
                at.append(by_size[s].pop())
                label.append(f"r{round_no}b{block}c{k}")
                open_.append(k == 0 and sum(b) * NEARLY_FULL <= capacity * (NEARLY_FULL - 1))
        return pa.table({"limit_name": [name] * len(at), "capacity": [capacity] * len(at), "uid": uid[at], "size": size[at], "container_id": label, "open": open_})

    return run


def _bundled(units: DataFrame, limits: dict[str, int], block_items: int, round_no: int) -> tuple[DataFrame, DataFrame]:
    """(units, members): the units of these limits, small ones put together, and (limit_name, bundle, uid) of what is in a bundle.

    A unit is small below capacity / k, where k is the number of items of a block divided by BLOCK_CONTAINERS; a bundle is
    closed when it reaches that size, so it stays below twice of it. All is done by running sums over BUNDLED_ITEMS units.
    """
    k = max(2, block_items // BLOCK_CONTAINERS)
    small = F.col("limit_name").isin(list(limits)) & (F.col("size") * k < F.col("capacity"))
    groups = F.create_map(*[F.lit(x) for name, n in limits.items() for x in (name, -(-n // BUNDLED_ITEMS))])
    crumbs = units.where(small).withColumn("part", F.pmod(F.xxhash64("uid", F.lit(-1 - round_no)), groups[F.col("limit_name")]))
    before = F.sum("size").over(Window.partitionBy("limit_name", "part").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    closed = F.floor(F.coalesce(before, F.lit(0)) / F.ceil(F.col("capacity") / k)).cast("long")
    placed = materialize(crumbs.withColumn("bundle", F.concat(F.lit(f"b{round_no}p"), "part", F.lit("n"), closed)), f"bundles-{round_no}")
    sums = placed.groupBy("limit_name", "capacity", F.col("bundle").alias("uid")).agg(F.sum("size").alias("size"))
    return units.where(~small).unionByName(sums), placed.select("limit_name", "bundle", "uid")


def pack(
    items: DataFrame, key: str, size: str, limits: DataFrame, block_items: int = BLOCK_ITEMS, completions: int | None = COMPLETIONS, enumerated: int | None = ENUMERATED, nodes_per_item: int | None = NODES_PER_ITEM
) -> DataFrame:
    """(limit_name, container_id, key, part_no, token_start, token_end, n_tokens) for every item and limit.

    limits: (limit_name, max_tokens), a few rows. An item above the limit is split: full containers of its own, then a
    rest that is packed as any other; only such items have more than one part. Each row of items is an item, also if its
    key is NULL or repeated. Items of size 0 or NULL take no room: one row with a NULL container. Limits that are NULL or
    below 1 are left out. Without items or limits there are no rows. The blocks hash a row number of the written items,
    so no key can fill a block. completions, enumerated and nodes_per_item bound the search in a block; None lifts a
    bound, and without any a block's containers are as few as possible. A block has 4 * BLOCK_CONTAINERS items at least.
    Other columns are not read.
    """
    if block_items < 1 or any(x is not None and x < 1 for x in (completions, enumerated, nodes_per_item)):
        raise ValueError("block_items and the bounds of the search must be positive")
    block_items = max(block_items, 4 * BLOCK_CONTAINERS)
    spark = items.sparkSession
    search = {"kept_most": completions, "enumerated": enumerated, "nodes_per_item": nodes_per_item}
    whole = materialize(items.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("total")), "items")
    caps = limits.where("max_tokens >= 1").select("limit_name", F.col("max_tokens").cast("long")).distinct().limit(MAX_LIMITS + 1).collect()
    if len(caps) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    settings = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("long").alias("capacity")) for n, c in caps]) if caps else F.array().cast("array<struct<limit_name:string,capacity:bigint>>")
    each = whole.select("*", F.explode(settings).alias("x")).select("id", "key", "total", "x.limit_name", "x.capacity")
    full = each.where("total > 0").select("limit_name", "capacity", "id", F.explode(F.sequence(F.lit(0), F.expr("(total - 1) div capacity"))).alias("part_no"), "key", "total")
    sized = full.withColumn("size", F.least(F.col("capacity"), F.col("total") - F.col("part_no") * F.col("capacity")))
    todo = materialize(sized.where("size < capacity").select("limit_name", "capacity", F.col("id").cast("string").alias("uid"), "size"), "rests")  # one rest of an item at most
    schema = "limit_name string, capacity long, uid string, size long, container_id string, open boolean"
    placed, bundles, round_no = [], [], 0
    while stats := [r for r in todo.groupBy("limit_name", "capacity").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).collect()]:  # a row a limit
        tiny = {r["limit_name"]: r["n"] for r in stats if r["n"] > block_items and r["n"] * r["capacity"] * BLOCK_CONTAINERS > block_items * r["total"]}
        if tiny:
            todo, members = _bundled(todo, tiny, block_items, round_no)
            bundles.append(members)
            todo = materialize(todo, f"units-{round_no}")
            stats = todo.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n")).collect()
        blocks = F.create_map(*[F.lit(x) for r in stats for x in (r["limit_name"], -(-r["n"] // block_items))])[F.col("limit_name")]
        block = F.pmod(F.xxhash64("uid", F.lit(round_no)), blocks).cast("int")
        packed = materialize(todo.withColumn("block", block).groupBy("limit_name", "block").applyInArrow(_pack_block(round_no, search), schema), f"packed-{round_no}")
        again = F.col("open") & (blocks > 1)
        placed.append(packed.where(~again).select("limit_name", "uid", "container_id"))
        todo, round_no = packed.where(again).drop("container_id", "open"), round_no + 1
    at = reduce(DataFrame.unionByName, placed) if placed else spark.createDataFrame([], "limit_name string, uid string, container_id string")
    for members in reversed(bundles):  # what is in a bundle is where the bundle is
        inside = at.withColumnRenamed("uid", "bundle").join(members, ["limit_name", "bundle"]).select("limit_name", "uid", "container_id")
        at = at.join(members.select("limit_name", F.col("bundle").alias("uid")).distinct(), ["limit_name", "uid"], "left_anti").unionByName(inside)
    rest = at.select("limit_name", F.col("uid").try_cast("long").alias("id"), F.col("container_id").alias("own"))
    parts = sized.join(rest, ["limit_name", "id"], "left")
    container = F.when(F.col("size") < F.col("capacity"), F.col("own")).otherwise(F.concat(F.lit("d"), "id", F.lit("p"), "part_no"))
    out = parts.select("limit_name", container.alias("container_id"), F.col("key").alias(key), "part_no", (F.col("part_no") * F.col("capacity")).alias("token_start"), (F.col("part_no") * F.col("capacity") + F.col("size")).alias("token_end"), F.col("size").alias("n_tokens"))
    zero = F.lit(0).cast("long")
    empty = each.where("total <= 0").select("limit_name", F.lit(None).cast("string").alias("container_id"), F.col("key").alias(key), zero.alias("part_no"), zero.alias("token_start"), zero.alias("token_end"), zero.alias("n_tokens"))
    return out.unionByName(empty)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, max_tokens, n_containers, n_tokens, least_containers, fill): least by the total of tokens alone."""
    per = packed.where("container_id IS NOT NULL").groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    total = per.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    j = total.join(limits.select("limit_name", F.col("max_tokens").cast("long").alias("max_tokens")).distinct(), "limit_name")
    return j.select("limit_name", "max_tokens", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("max_tokens")).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens"))).alias("fill"))
