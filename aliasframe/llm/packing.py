"""Items into containers of one capacity: bounded-space online packing.

Each partition keeps at most ``windows`` open containers. An item goes where it fits best; if it fits
nowhere and all windows are open, the fullest is emitted. What is open at the end of a partition is packed
again as items, over ever fewer partitions, until one task merges the last leftovers: at most ``windows``
containers of each task come there, whatever the number of items. Only sizes and ids move.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

CAPACITY, WINDOWS, FAN_IN = 2048, 64, 16
_ITEM = pa.struct([("doc_id", pa.int64()), ("piece_no", pa.int64()), ("first_token", pa.int64()), ("tokens", pa.int64())])
_ITEMS = "array<struct<doc_id:bigint,piece_no:bigint,first_token:bigint,tokens:bigint>>"
_SCHEMA = f"container_id string, open boolean, fill bigint, items {_ITEMS}"


class Packer:
    """``windows`` open containers; ``add`` returns those it closes."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.room: list[tuple[int, int]] = []  # (room left, number), sorted
        self.held: dict[int, list] = {}
        self.count = 0

    def add(self, size: int, items: list) -> list[tuple[int, list]]:
        if size > self.capacity:
            raise ValueError("an item is above the capacity")
        closed, at = [], bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, number = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                left, full = self.room.pop(0)
                closed.append((self.capacity - left, self.held.pop(full)))
            room, number = self.capacity, self.count
            self.count += 1
            self.held[number] = []
        self.held[number].extend(items)
        if room == size:
            closed.append((self.capacity, self.held.pop(number)))
        else:
            insort(self.room, (room - size, number))
        return closed

    def rest(self) -> list[tuple[int, list]]:
        out = [(self.capacity - left, self.held[number]) for left, number in self.room]
        self.room, self.held = [], {}
        return out


def _pack(capacity: int, windows: int, level: int, last: bool):
    def run(batches):
        packer, part, made = Packer(capacity, windows), TaskContext.get().partitionId(), 0

        def rows(closed, is_open):
            nonlocal made
            ids = [f"{level}-{part}-{made + i}" for i in range(len(closed))]
            made += len(closed)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array([is_open] * len(ids), pa.bool_()), pa.array([f for f, _ in closed], pa.int64()), pa.array([i for _, i in closed], pa.list_(_ITEM))],
                names=["container_id", "open", "fill", "items"],
            )

        for batch in batches:
            closed = []
            for size, items in zip(batch.column("fill").to_pylist(), batch.column("items").to_pylist(), strict=True):
                closed += packer.add(size, items)
            if closed:
                yield rows(closed, False)
        if rest := packer.rest():
            yield rows(rest, not last)

    return run


def divide(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, tokens -> items of at most ``capacity`` tokens; only a text above the capacity is divided."""
    parts = sizes.where(F.col("tokens") > 0).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("bigint"))).alias("piece_no"))
    first = F.col("piece_no") * capacity
    return parts.select("doc_id", F.col("piece_no").cast("bigint").alias("piece_no"), first.cast("bigint").alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - first).cast("bigint").alias("tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """``container_id, fill, items`` for ``sizes(doc_id, tokens)``.

    Texts without tokens (null, empty) are in no container. Equal documents are items each. Every item is
    in exactly one container and no container is above the capacity.
    """
    items = divide(sizes, capacity)
    unit = items.select(F.col("tokens").alias("fill"), F.array(F.struct("doc_id", "piece_no", "first_token", "tokens")).alias("items"))
    level, done = 0, None
    parts = None
    while True:
        got = checkpoint(unit.mapInArrow(_pack(capacity, windows, level, parts == 1), _SCHEMA))
        closed = got.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if parts == 1:
            break
        parts = max(1, got.rdd.getNumPartitions() // FAN_IN)
        unit = got.where(F.col("open")).select("fill", "items").repartition(parts, F.xxhash64(F.col("items")[0]["doc_id"])).sortWithinPartitions(F.col("fill").desc(), F.col("items")[0]["doc_id"], F.col("items")[0]["piece_no"])
        level += 1
    return done.select("container_id", "fill", "items")
