"""Problem 8: items of varying length combined into containers of fixed capacity.

Linear grouping: large items, sorted by length, fall into groups of equal cardinality; every length counts as the
largest of its group, which leaves few sizes. Configurations of those sizes are chosen by filling a container as far
as the remaining counts allow and repeating it as often as they allow; the actual items then take the places of their
group. Small items go best-fit into what is left, on histograms: as many containers of one residual as there are
items of one size are served at once.

The driver sees histograms alone (at most capacity + 1 sizes). Items take their places by exact ranks: a count per
partition and size, offsets by a running sum over partitions. No group is collected, however common one size is.

Defined results: a null text has one token (its end token) and still gets a container; only items above the capacity
are split, at code points, each part with an end token of its own; ties of one length are placed in partition order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataq.common import materialise

CAPACITY, GROUPS = 8192, 48


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc, part, size): sizes in bytes and one end token; texts above the capacity in several parts."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    fits = docs.where(size <= capacity).select(F.col(id_col).alias("doc"), F.lit(0).alias("part"), size.alias("size"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, sizes = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                raw, at, part = text.encode("utf-8", "replace"), 0, 0
                while at < len(raw):
                    to = min(len(raw), at + capacity - 1)
                    while to < len(raw) and raw[to] & 0xC0 == 0x80:
                        to -= 1
                    rows.append(i)
                    parts.append(part)
                    sizes.append(to - at + 1)
                    at, part = to, part + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32())], names=["doc", "part", "size"])

    id_type = docs.schema[id_col].dataType.simpleString()
    long = docs.where(size > capacity).select(id_col, text_col).mapInArrow(cut, f"doc {id_type}, part int, size int")
    return fits.unionByName(long)


def ranked(items: DataFrame, key: str) -> DataFrame:
    """items (materialised) with `rank`: 0, 1, ... within each value of an integer column."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            keys = b.column(b.schema.get_field_index(key)).to_pylist()
            idx = []
            for k in keys:
                idx.append(seen[k])
                seen[k] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(idx, pa.int64())], names=[*b.schema.names, "_idx"])

    local = materialise(items.withColumn("_pid", F.spark_partition_id()).mapInArrow(run, f"{fields}, _pid int, _idx bigint"))
    counts = local.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(key, "_pid", (F.sum("_n").over(W.partitionBy(key).orderBy("_pid")) - F.col("_n")).alias("_before"))
    return local.join(offsets, [key, "_pid"]).select(*items.columns, (F.col("_before") + F.col("_idx")).alias("rank"))


class LargePlan:
    """Places for large items by global rank (descending size)."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int):
        sizes = sorted(histogram, reverse=True)
        self.before = dict(zip(sizes, np.concatenate([[0], np.cumsum([histogram[s] for s in sizes])[:-1]]).astype(np.int64).tolist())) if sizes else {}
        total = sum(histogram.values())
        self.each = max(1, -(-total // groups))
        starts = np.cumsum([histogram[s] for s in sizes]) if sizes else np.zeros(0, dtype=np.int64)
        n_groups = -(-total // self.each) if total else 0
        rounded = [sizes[int(np.searchsorted(starts, g * self.each, "right"))] for g in range(n_groups)]
        left = [min(self.each, total - g * self.each) for g in range(n_groups)]
        taken = [0] * n_groups
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in range(n_groups)]  # (first slot, first container, containers)
        self.containers = 0
        while any(left):
            use = _fullest(rounded, left, capacity)
            times = min(left[g] // u for g, u in use.items())
            for g, u in use.items():
                for _ in range(u):
                    self.slots[g].append((taken[g], self.containers, times))
                    taken[g] += times
                left[g] -= u * times
            self.containers += times
        self._starts = [np.array([s[0] for s in x], dtype=np.int64) for x in self.slots]
        self._first = [np.array([s[1] for s in x], dtype=np.int64) for x in self.slots]

    def place(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        r = np.array([self.before[int(s)] for s in size], dtype=np.int64) + rank
        out = np.zeros(len(r), dtype=np.int64)
        group = r // self.each
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            slot = r[at] - g * self.each
            k = np.searchsorted(self._starts[g], slot, "right") - 1
            out[at] = self._first[g][k] + slot - self._starts[g][k]
        return out


def _fullest(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The configuration with the largest group that still has items, filled as far as the counts allow."""
    first = next(g for g, n in enumerate(left) if n)
    by = np.full(capacity + 1, -1, dtype=np.int64)  # which group was added last to reach this fill
    base = sizes[first]
    reach = np.zeros(capacity + 1, dtype=bool)
    reach[base] = True
    steps: list[tuple[int, np.ndarray]] = []
    for g in range(first, len(sizes)):
        for _ in range(min(left[g] - (g == first), (capacity - base) // sizes[g])):
            moved = np.zeros_like(reach)
            moved[sizes[g] :] = reach[: capacity + 1 - sizes[g]]
            new = moved & ~reach
            if not new.any():
                break
            by[new] = g
            reach |= new
            steps.append((g, new))
    fill = int(np.flatnonzero(reach)[-1])
    use: dict[int, int] = {first: 1}
    for g, new in reversed(steps):  # a fill first reached in a step used that step's group once
        if new[fill]:
            use[g] = use.get(g, 0) + 1
            fill -= sizes[g]
    return use


def best_fit(residuals: dict[int, int], items: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Per size, (first item rank, residual class or -1 for new containers, first rank in the class); number of new ones.

    Sizes go from large to small; each takes containers with the least residual that still holds it. Containers are
    intervals of ranks in the class they started from, so one step serves as many as both sides have.
    """
    classes: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in residuals.items() if r and n}
    order = sorted(classes)
    plan: dict[int, list[tuple[int, int, int]]] = {}
    new = 0
    for size in sorted(items, reverse=True):
        todo, at, rows = items[size], 0, []
        while todo:
            k = bisect_left(order, size)
            if k == len(order):
                per = capacity // size
                n = -(-todo // per)
                r, source, a, z = capacity, -1, new, new + n
                new += n
            else:
                r = order[k]
                source, a, z = classes[r].pop()
                if not classes[r]:
                    del classes[r]
                    order.pop(k)
            n = min(todo, z - a)
            rows.append((at, source, a))
            todo, at = todo - n, at + n
            for rest, lo, hi in ((r - size, a, a + n), (r, a + n, z)):
                if hi > lo and rest:
                    if rest not in classes:
                        classes[rest] = []
                        insort(order, rest)
                    classes[rest].append((source, lo, hi))
        plan[size] = rows
    return plan, new


def pack(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(doc, part, size, container) for every document."""
    items = materialise(pieces(docs, id_col, text_col, capacity))
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most `capacity` sizes
    large = {s: n for s, n in histogram.items() if s > capacity // 8}
    plan = LargePlan(large, capacity, groups)
    places = materialise(ranked(items, "size"))
    id_type = items.schema["doc"].dataType.simpleString()

    def put_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = plan.place(b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(c)], names=["doc", "part", "size", "container"])

    placed = materialise(places.where(f"size > {capacity // 8}").select("doc", "part", "size", "rank").mapInArrow(put_large, f"doc {id_type}, part int, size int, container bigint"))
    filled = materialise(placed.groupBy("container").agg((capacity - F.sum("size")).cast("int").alias("residual")))
    residuals = {r["residual"]: r["count"] for r in filled.groupBy("residual").count().collect()}  # at most capacity + 1
    small_plan, new = best_fit(residuals, {s: n for s, n in histogram.items() if s <= capacity // 8}, capacity)
    arrays = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in small_plan.items()}
    base = plan.containers

    def put_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            source, at = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                start, cls, first = arrays[int(s)]
                k = np.searchsorted(start, rank[mine], "right") - 1
                source[mine], at[mine] = cls[k], first[k] + rank[mine] - start[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(source.astype(np.int32)), pa.array(at)], names=["doc", "part", "size", "residual", "rank"])

    small_items = places.where(f"size <= {capacity // 8}").select("doc", "part", "size", "rank").mapInArrow(put_small, f"doc {id_type}, part int, size int, residual int, rank bigint")
    open_ones = ranked(filled, "residual")
    joined = small_items.where("residual >= 0").join(open_ones, ["residual", "rank"]).select("doc", "part", "size", "container")
    fresh = small_items.where("residual < 0").select("doc", "part", "size", (F.col("rank") + base).alias("container"))
    return placed.unionByName(joined).unionByName(fresh)
