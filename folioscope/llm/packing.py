"""Problem 6: fill containers of fixed capacity with texts, wasting as little room as possible.

Martello and Toth's reduction.  Items are taken from the largest down.  If some set of at most three items with the
item in it dominates every other set that could share its container, that set is fixed for good: the instance shrinks
and no optimal packing is lost.  This is repeated until nothing more is fixed.  What is left is packed in two ways, of
which the one with fewer containers is taken: best-fit, largest first; and by relaxation, where the smallest items are
set aside until dominance decides about the largest, and then fill, best-fit, the room that is left.

The items are dealt by the hash of their key into blocks of bounded size, each one Spark group; a block wastes at most
its last containers, a vanishing share.  Whole-container parts of texts over the capacity never enter a block.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

#: Items of one block; bounds a task's memory.
BLOCK_ITEMS = 20_000
#: Windows are configuration: their number is checked before they enter the plan as constants.
MAX_WINDOWS = 1000


class SizeBag:
    """A multiset of sizes with order queries; at most ``capacity`` different sizes."""

    def __init__(self, sizes: dict[int, int]) -> None:
        self.count = dict(sizes)
        self.sizes = sorted(sizes)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def put(self, size: int) -> None:
        if size not in self.count:
            self.count[size] = 0
            self.sizes.insert(bisect_left(self.sizes, size), size)
        self.count[size] += 1

    def largest(self, at_most: int) -> int | None:
        """The largest size within ``at_most``."""
        at = bisect_right(self.sizes, at_most)
        return self.sizes[at - 1] if at else None

    def smallest(self, n: int) -> list[int]:
        """Up to ``n`` smallest items."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.count[size])
            if len(out) == n:
                break
        return out


def _best_pair(bag: SizeBag, room: int) -> tuple[int, int]:
    """The largest sum of two items within ``room``, and the largest that the smaller of two such items can be."""
    sizes, low, high = bag.sizes, 0, bisect_right(bag.sizes, room) - 1
    best = smaller = 0
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and bag.count[sizes[low]] < 2):
            high -= 1
        else:
            best, smaller = max(best, total), max(smaller, sizes[low])
            low += 1
    return best, smaller


def dominating_set(bag: SizeBag, item: int, capacity: int) -> list[int] | None:
    """The items that share the container of ``item`` (already taken from ``bag``) in a set dominating all others.

    One set dominates another if the items of the other can be grouped so that each group is at most as large as an
    item of its own.  None if no set of at most three items is proven to dominate.
    """
    room = capacity - item
    mate = bag.largest(room)
    if mate is None or mate == 0:
        return []  # nothing else fits
    if mate == room:
        return [mate]  # a full container: whatever else would share it could take the mate's place
    least = bag.smallest(3)
    if len(least) < 2 or least[0] + least[1] > room:
        return [mate]  # at most one more fits, the largest is best
    if len(least) < 3 or sum(least) > room:  # at most two more fit
        best, smaller = _best_pair(bag, room)
        if mate >= best:
            return [mate]  # one item as large as any two that fit
        bag.take(mate)
        second = bag.largest(room - mate)
        bag.put(mate)
        if second is not None and second >= smaller:
            return [mate, second]  # the largest that fits, with one no smaller than the lesser of any pair
    return None


def reduce(bag: SizeBag, capacity: int) -> list[list[int]]:
    """The containers that dominance fixes, taken from ``bag``; a fixed set can make further ones dominate."""
    containers: list[list[int]] = []
    found = -1
    while found < len(containers):
        found = len(containers)
        item = bag.largest(capacity)
        while item is not None:
            bag.take(item)
            mates = dominating_set(bag, item, capacity)
            if mates is None:  # stays in the instance: later sets have to dominate those with it, too
                bag.put(item)
                item = bag.largest(item - 1)
                continue
            for mate in mates:
                bag.take(mate)
            containers.append([item, *mates])
            item = bag.largest(item)
    return containers


def relax(bag: SizeBag, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Containers for all but the smallest items of ``bag``, which are set aside, largest first.

    The instance is relaxed by its smallest item until dominance decides about its largest one, and so on.
    """
    containers: list[list[int]] = []
    aside: list[int] = []
    while (item := bag.largest(capacity)) is not None:
        bag.take(item)
        while (mates := dominating_set(bag, item, capacity)) is None:
            least = bag.sizes[0]
            bag.take(least)
            aside.append(least)
        for mate in mates:
            bag.take(mate)
        containers.append([item, *mates])
    return containers, aside[::-1]


def best_fit(items: list[int], capacity: int, containers: list[list[int]] | None = None) -> list[list[int]]:
    """``items`` put, one after the other, where the least room is left, in ``containers`` or new ones."""
    out = [list(c) for c in containers or []]
    open_by_room: dict[int, list[list[int]]] = defaultdict(list)
    for container in out:
        if sum(container) < capacity:
            open_by_room[capacity - sum(container)].append(container)
    rooms = sorted(open_by_room)
    for item in items:
        at = bisect_left(rooms, item)
        if at == len(rooms):
            container, room = [], capacity
            out.append(container)
        else:
            room = rooms[at]
            container = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(at)
        container.append(item)
        left = room - item
        if left:
            if not open_by_room[left]:
                rooms.insert(bisect_left(rooms, left), left)
            open_by_room[left].append(container)
    return out


def pack(sizes: dict[int, int], capacity: int) -> list[tuple[list[int], bool]]:
    """Containers for a multiset of sizes between 1 and ``capacity``: the sizes in each, and whether it was fixed."""
    bag = SizeBag(sizes)
    fixed = reduce(bag, capacity)
    undecided = [size for size in reversed(bag.sizes) for _ in range(bag.count[size])]
    relaxed, aside = relax(SizeBag(bag.count), capacity)
    rest = min(best_fit(aside, capacity, relaxed), best_fit(undecided, capacity), key=len)
    return [(c, True) for c in fixed] + [(c, False) for c in rest]


ASSIGNED = (
    "window_id int, capacity long, container string, doc_id long, part int, first_token long, tokens long, fixed boolean"
)


def _pack_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    window, block = key[0], key[1]
    capacity = int(rows["capacity"].iloc[0])
    rows = rows.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
    waiting: dict[int, list[int]] = defaultdict(list)
    for at, size in enumerate(rows["tokens"]):
        waiting[int(size)].append(at)
    empty = waiting.pop(0, [])
    number, fixed = [0] * len(rows), [False] * len(rows)
    for order, (sizes, sure) in enumerate(pack({s: len(x) for s, x in waiting.items()}, capacity)):
        for size in sizes:
            at = waiting[size].pop()
            number[at], fixed[at] = order, sure
    for at in empty:
        number[at], fixed[at] = 0, True  # texts without a token take no room
    return rows.assign(
        window_id=window, container=[f"{block}-{n}" for n in number], fixed=fixed
    )[[c.split()[0] for c in ASSIGNED.split(", ")]]


def fill_containers(sized: DataFrame, windows: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Assign every document to containers of every window.

    ``sized`` has doc_id and tokens; ``windows`` has window_id and capacity_tokens and is a short configuration table.
    One row per document (or part of one) and window: window_id, capacity, container, doc_id, part, first_token,
    tokens, fixed (by dominance).  A document is in parts only if it alone exceeds the capacity: whole containers and a
    rest, which is packed like a document.  Documents without a token (null or empty text) take no room and still get
    a container.  Rows repeating a doc_id are one document (the largest); rows without a doc_id and windows without a
    positive capacity are left out; no window or no document gives no rows.
    """
    documents = cut_lineage(
        sized.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
    )
    blocks = max(1, -(-documents.count() // block_items))
    capacities = (
        windows.where("window_id is not null and capacity_tokens > 0")
        .select(F.col("window_id").cast("int"), F.col("capacity_tokens").cast("long").alias("capacity"))
        .distinct()
        .limit(MAX_WINDOWS + 1)
        .collect()
    )
    if len(capacities) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows: a configuration table is expected")
    if not capacities:
        return documents.sparkSession.createDataFrame([], ASSIGNED)
    window = F.array(
        *(F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, c in capacities)
    )
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    each = (
        documents.select("*", F.inline(window))
        .withColumn("whole", F.when(F.col("tokens") > F.col("capacity"), whole).otherwise(0))
        .withColumn("rest", F.col("tokens") - F.col("whole") * F.col("capacity"))
    )
    whole = each.where("whole > 0").select(
        "window_id",
        "capacity",
        F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("part"),
        "doc_id",
    ).select(
        "window_id",
        "capacity",
        F.format_string("whole-%d-%d", "doc_id", "part").alias("container"),
        "doc_id",
        "part",
        (F.col("part") * F.col("capacity")).alias("first_token"),
        F.col("capacity").alias("tokens"),
        F.lit(True).alias("fixed"),
    )
    rest = each.where("whole = 0 or rest > 0").select(
        "window_id",
        "capacity",
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"),
        "doc_id",
        F.col("whole").cast("int").alias("part"),
        (F.col("whole") * F.col("capacity")).alias("first_token"),
        F.col("rest").alias("tokens"),
    )
    return rest.groupBy("window_id", "block").applyInPandas(_pack_block, ASSIGNED).unionByName(whole)


def packing_report(assigned: DataFrame) -> DataFrame:
    """Per window: documents, tokens, containers, the least number any packing needs by volume, and the share filled."""
    per = assigned.groupBy("window_id", "capacity", "container").agg(
        F.sum("tokens").alias("tokens"), F.count_if("fixed").alias("fixed"), F.count("*").alias("parts")
    )
    return per.groupBy("window_id", "capacity").agg(
        F.sum("parts").alias("parts"),
        F.sum("tokens").alias("tokens"),
        F.count("*").alias("containers"),
        F.ceil(F.sum("tokens") / F.col("capacity")).alias("least_containers"),
        F.round(F.sum("tokens") / (F.count("*") * F.col("capacity")), 6).alias("filled"),
        F.sum("fixed").alias("fixed_parts"),
        F.max("tokens").alias("fullest"),
    )
