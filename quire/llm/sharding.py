"""Sharding by minimax contiguous partition.

Atomic groups are rows with equal texts. They are put in an order, and shards are runs of that order: a binary search
finds the smallest capacity for which a greedy scan needs no more shards than there are, and the cuts follow.

The order is by size, but for the few large groups (over an eighth of an equal share, so at most eight for each shard):
each stands where it leaves room for small ones to fill the shard up. Groups of equal size form one run, and a run is
filled into shards by division. Different sizes sum up to at most the input, so their number is below sqrt(2 * bytes):
14 million for 100 TB, and far fewer in practice. The driver gets one (size, groups) row for each, never a group.

A group larger than an equal share gets a shard of its own first, and the others are balanced over the shards left; so
one giant group doesn't leave other shards empty.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import attach, numbered, table, written

SHARDS = 40
OVERHEAD = 16
#: A group over this part of an equal share is large.
LARGE_SHARE = 8

#: (size of each group, number of groups)
Runs = list[tuple[int, int]]


def shards_needed(runs: Runs, capacity: int, most: int) -> int:
    """Shards that a greedy scan fills, or most + 1 as soon as there are more."""
    used, room = 1, capacity
    for size, n in runs:
        if size > capacity:
            return most + 1
        if (fit := room // size) >= n:
            room -= n * size
            continue
        n -= fit
        each = capacity // size
        more = -(-n // each)
        used += more
        if used > most:
            return most + 1
        room = capacity - (n - (more - 1) * each) * size
    return used


def smallest_capacity(runs: Runs, shards: int) -> int:
    if not runs:
        return 0
    total = sum(s * n for s, n in runs)
    largest = max(s for s, _ in runs)
    low, high = max(largest, -(-total // shards)), largest + -(-total // shards)
    while low < high:
        mid = (low + high) // 2
        if shards_needed(runs, mid, shards) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _cut(runs: Runs, shards: int, capacity: int) -> list[tuple[int, int]]:
    """Cuts at a capacity that suffices: (run, groups of it) before which the next shard starts.

    Each shard takes the mean of what is left, to the nearest group but never over the capacity, and always enough for
    the shards behind it to hold the rest.
    """
    cuts: list[tuple[int, int]] = []
    left, at, used = sum(s * n for s, n in runs), 0, 0
    for k in range(shards - 1):
        want, load = left / (shards - k), 0
        start = (at, used)
        while at < len(runs):
            size, n = runs[at]
            fit = min(n - used, max(0, int((want - load) / size + 0.5)), (capacity - load) // size)
            load += fit * size
            used += fit
            if used < n:
                break
            at, used = at + 1, 0
        rest = _rest(runs, at, used)
        if rest and shards_needed(rest, capacity, shards - k - 1) > shards - k - 1:  # then fill it up
            at, used = start
            load = 0
            while at < len(runs):
                size, n = runs[at]
                fit = min(n - used, (capacity - load) // size)
                load += fit * size
                used += fit
                if used < n:
                    break
                at, used = at + 1, 0
        left -= load
        cuts.append((at, used))
    return cuts


def _rest(runs: Runs, at: int, used: int) -> Runs:
    return [(s, n) for s, n in [(runs[at][0], runs[at][1] - used), *runs[at + 1 :]] if n] if at < len(runs) else []


@dataclass(frozen=True)
class Plan:
    """Where groups go, by their size and their rank among groups of that size."""

    large: dict[tuple[int, int], int]  # (size, rank): shard
    starts: list[tuple[int, int]]  # of small groups: (-size, rank) from which the shard of the same place in `shards` holds
    shards: list[int]

    def shard_of(self, size: int, rank: int = 0) -> int:
        if (found := self.large.get((size, rank))) is not None:
            return found
        return self.shards[bisect.bisect_right(self.starts, (-size, rank)) - 1]

    def ranked_sizes(self) -> set[int]:
        """Sizes whose groups don't all go to one shard."""
        return {s for s, _ in self.large} | {-s for s, r in self.starts if r}


def _ordered(runs: Runs, shards: int) -> list[tuple[int, int, int]]:
    """(size, first rank, groups) in order: large groups spread, each with the small ones that fill its shard up."""
    share = sum(s * n for s, n in runs) / shards
    bins: list[tuple[int, int, list[tuple[int, int, int]]]] = [(0, k, []) for k in range(shards)]
    small = []
    for size, n in runs:
        if size <= share / LARGE_SHARE:
            small.append((size, n))
            continue
        for rank in range(n):
            load, k, held = heapq.heappop(bins)
            heapq.heappush(bins, (load + size, k, [*held, (size, rank, 1)]))
    out, at, used, left = [], 0, 0, sum(s * n for s, n in small)
    full = sorted(bins, key=lambda b: (-b[0], b[1]))
    for i, (load, _, held) in enumerate(full):
        out += held
        level = (left + sum(b[0] for b in full[i:])) / (len(full) - i)
        room = level - load if i < len(full) - 1 else left
        while at < len(small) and room > 0:
            size, n = small[at]
            take = n - used if i == len(full) - 1 else min(n - used, int(room / size + 0.5))
            if not take:
                break
            out.append((size, used, take))
            room, left, used = room - take * size, left - take * size, used + take
            if used == n:
                at, used = at + 1, 0
    return out


def minimax_plan(runs: Runs, shards: int = SHARDS) -> Plan:
    """runs: largest size first."""
    large: dict[tuple[int, int], int] = {}
    total, rest = sum(s * n for s, n in runs), list(runs)
    while rest and len(large) < shards - 1 and rest[0][0] * (shards - len(large)) >= total:  # a shard of its own
        size, n = rest[0]
        large[(size, dict(runs)[size] - n)] = len(large)
        total -= size
        rest[0:1] = [(size, n - 1)] if n > 1 else []
    own = len(large)
    taken = dict(runs)[rest[0][0]] - rest[0][1] if rest else 0
    order = [(s, r + (taken if rest and s == rest[0][0] else 0), n) for s, r, n in _ordered(rest, shards - own)]
    flat = [(s, n) for s, _, n in order]
    cuts = _cut(flat, shards - own, smallest_capacity(flat, shards - own))
    bound = total / (shards - own) / LARGE_SHARE
    starts: list[tuple[int, int]] = []
    held: list[int] = []
    shard, k = own, 0
    for i, (size, first, n) in enumerate(order):
        edges = [0]
        while k < len(cuts) and (cuts[k][0] < i or cuts[k] == (i, 0)):
            shard, k = shard + 1, k + 1
        here = [shard]
        while k < len(cuts) and cuts[k][0] == i:
            shard, k = shard + 1, k + 1
            if cuts[k - 1][1] == edges[-1]:
                here[-1] = shard
            else:
                edges.append(cuts[k - 1][1])
                here.append(shard)
        for e, h in zip(edges, here, strict=True):
            if size > bound:
                large[(size, first + e)] = h
            elif e < n and (not held or held[-1] != h):
                starts.append((-size, first + e))
                held.append(h)
    return Plan(large, starts or [(0, 0)], held or [own])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size) for every row of docs under the law `bytes`.

    size is the text's UTF-8 bytes plus 16. Rows with equal texts share a shard; null texts are as empty ones. With fewer
    groups than shards some shards are empty; an empty table gives no rows. Null and repeated doc_ids are rows like any
    other. grown_shard is null, as this law makes no promise on growth. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_key"),
        ),
        "rows",
    )
    groups = written(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("group_size")), "groups")
    runs: Runs = [(r[0], r[1]) for r in groups.groupBy("_bytes").count().orderBy(F.desc("_bytes")).toLocalIterator()]
    placed = _place(groups, minimax_plan(runs, shards))
    met = attach(rows, written(placed, "placed"), "_key", "group_size").drop("_key")
    out = numbered(written(met, "met"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size"
    )


def _place(groups: DataFrame, plan: Plan) -> DataFrame:
    """groups with their shard. Only those of sizes that go to several shards need a rank: a few hundred sizes at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["shard"] = [plan.shard_of(int(s), int(r)) for s, r in zip(b["_bytes"], b["_rank"], strict=True)]
            yield b[["_key", "group_size", "shard"]]

    ranked = sorted(plan.ranked_sizes())
    plain = groups.filter(~F.col("_bytes").isin(ranked)) if ranked else groups
    both = plain.withColumn("_rank", F.lit(0).cast("long"))
    if ranked:
        both = both.unionByName(numbered(groups.filter(F.col("_bytes").isin(ranked)), ["_bytes"], ["_key"], "_rank"))
    return both.mapInPandas(run, "_key binary, group_size long, shard int")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
