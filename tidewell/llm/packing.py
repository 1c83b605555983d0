"""Items of varying length into containers of fixed capacity: best-fit decreasing per shard.

Items are spread over shards of about ``SHARD_ROWS`` items by a hash of their id, so no task's work grows
with the corpus, and a shard's last, half-filled containers are the only price: a few in many thousand.
Within a shard items come in decreasing size, and each goes into the open container with the least
sufficient room. A segment tree over remaining capacities says in logarithmic time which room that is.

An item larger than the capacity is cut: each full piece fills a container of its own, and the rest is
packed like an item. Defined cases: an item of size 0 or null takes a place but no room; equal sizes go
by id; ids may repeat; a null id is an id like another; an empty table gives an empty result; other
columns aren't read; a negative size is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.shipping import ship

ship(__name__)

SHARD_ROWS = 20_000
SCHEMA = "id bigint, piece int, size bigint, container bigint, place int, start bigint"


class RoomTree:
    """Which remaining capacities occur among open containers; the least one from a given size on, in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, size: int) -> int:
        """The least room of at least ``size``, or -1."""
        i, count = self.leaves + size, self.count
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not count[i]:
                        i += 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(sizes: Iterable[int], capacity: int) -> list[tuple[int, int, int]]:
    """(container, place, start) of each size, in the order given; no size may exceed the capacity."""
    tree, open_, used, items, out = RoomTree(capacity), [[] for _ in range(capacity + 1)], [], [], []
    for size in sizes:
        room = tree.least(size)
        if room < 0:
            box, room = len(used), capacity
            used.append(0)
            items.append(0)
        else:
            box = open_[room].pop()
            tree.add(room, -1)
        out.append((box, items[box], used[box]))
        items[box] += 1
        used[box] += size
        open_[room - size].append(box)
        tree.add(room - size, 1)
    return out


def _shard_packer(capacity: int):
    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base, out, rest, boxes = int(key[0]) << 32, [], [], 0
        rows = rows.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        for id_, size in zip(rows["id"].tolist(), rows["size"].tolist(), strict=True):
            full, left = (divmod(size, capacity) if size > capacity else (0, size))
            for piece in range(full):
                out.append((id_, piece, capacity, base | boxes, 0, 0))
                boxes += 1
            if left or not full:
                rest.append((left, id_, full))
        rest.sort(key=lambda x: -x[0])
        for (size, id_, piece), (box, place, start) in zip(rest, best_fit((x[0] for x in rest), capacity), strict=True):
            out.append((id_, piece, size, base | (boxes + box), place, start))
        made = pd.DataFrame(out, columns=["id", "piece", "size", "container", "place", "start"])
        return made.astype({"id": "Int64", "piece": "int32", "place": "int32"})

    return pack_shard


def pack(items: DataFrame, capacity: int, id_col: str = "id", size_col: str = "size", shard_rows: int = SHARD_ROWS, rows: int | None = None) -> DataFrame:
    """id, piece, size, container, place (within the container, from 0), start (offset in the container).

    ``rows``: the number of items where it is known; else they are counted.
    """
    if capacity < 1 or shard_rows < 1:
        raise ValueError("capacity and shard_rows must be positive")
    shards = max(1, math.ceil((items.count() if rows is None else rows) / shard_rows))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    src = items.select(F.col(id_col).cast("bigint").alias("id"), F.when(size < 0, F.raise_error(F.lit("negative size"))).otherwise(size).alias("size"))
    src = src.withColumn("shard", F.pmod(F.xxhash64("id", "size"), F.lit(shards)).cast("int"))
    return src.groupBy("shard").applyInPandas(_shard_packer(capacity), SCHEMA)
