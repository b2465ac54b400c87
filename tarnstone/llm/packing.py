"""Filling fixed-capacity containers: optimal length buckets, then token-budget batches."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.runtime import materialize

#: Number of length buckets.
BUCKETS = 64
#: Items of one length that one task ranks, about; a length with more is spread over as many salts.
RANKED = 250_000

_FILLED = "item_id bigint, part_no int, from_token bigint, n_tokens bigint, bucket int, container_id bigint"


def length_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of the buckets (the last is the largest length) with the least padding, that is
    the sum over all items of their bucket's bound less their length.

    Dynamic programming over the histogram, by bucket and last length; as the best previous bound
    never falls when the last length grows, halving finds each layer in n log n steps."""
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    items = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths.astype(np.float64))])
    best = lengths * items[1:] - tokens[1:]  # one bucket up to each length
    choice = []
    for _ in range(1, buckets):
        new, back = np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            prev = np.arange(first, min(mid, last) + 1)  # the bucket before ends at length prev - 1; 0: there is none
            cost = np.where(prev > 0, best[prev - 1], 0.0) + lengths[mid] * (items[mid + 1] - items[prev]) - (tokens[mid + 1] - tokens[prev])
            at = int(np.argmin(cost))
            new[mid], back[mid] = cost[at], prev[at]
            todo += [(lo, mid - 1, first, int(prev[at])), (mid + 1, hi, int(prev[at]), last)]
        best = new
        choice.append(back)
    bounds, at = [], n - 1
    for back in reversed(choice):
        bounds.append(int(lengths[at]))
        at = int(back[at]) - 1
        if at < 0:
            break
    if at >= 0:
        bounds.append(int(lengths[at]))
    return sorted(bounds)


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> pd.DataFrame:
    """Runs of equal fillings: length, first_rank (of the items of that length), bucket,
    first_container, per_container, before (items of the first container that come before the run).

    Buckets come from the longest down. The items of a bucket, longest first, form token-budget
    batches: as many a batch as fit at the bucket's bound, so that none has to be measured. What
    a batch leaves is a rest, which only shorter buckets may fill: their items go into rests first,
    the smallest that fits before larger, and what finds none forms the bucket's own batches. So
    the bounds decide which items meet in a batch and what is a rest.

    Rests of the same size stand together in one run, so the work and the plan grow with the number
    of lengths, at most capacity, not with the number of items."""
    bounds = np.array(length_buckets(lengths, counts, buckets))
    rests: dict[int, list[tuple[int, int]]] = {}  # size -> runs of containers (first, number)
    order: list[int] = []  # the sizes that occur, ascending
    plan, used = [], 0

    def leave(room: int, first: int, number: int) -> None:
        if number <= 0 or room <= 0:
            return
        if room not in rests:
            rests[room] = []
            insort(order, room)
        rests[room].append((first, number))

    of_bucket: dict[int, list[tuple[int, int]]] = {}
    for length, count in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        of_bucket.setdefault(int(np.searchsorted(bounds, length)), []).append((length, count))
    for bucket in sorted(of_bucket, reverse=True):
        own, later = [], []  # (length, first_rank, count) for batches; rests that this bucket's own items leave
        for length, count in of_bucket[bucket]:
            if length == 0:
                plan.append((0, 0, bucket, 0, 1 << 62, 0))  # takes no room: all with container 0
                used = max(used, 1)
                continue
            rank = 0
            while rank < count and (at := bisect_left(order, length)) < len(order):
                room = order[at]
                first, number = rests[room].pop()
                if not rests[room]:
                    del rests[room], order[at]
                each = room // length
                full, some = min(number, (count - rank) // each), 0
                if full:
                    plan.append((length, rank, bucket, first, each, 0))
                    leave(room - each * length, first, full)
                    rank += full * each
                if full < number and rank < count:  # fewer than each are left: they share one container
                    some = count - rank
                    plan.append((length, rank, bucket, first + full, each, 0))
                    leave(room - some * length, first + full, 1)
                    rank, full = count, full + 1
                leave(room, first + full, number - full)
            if rank < count:
                own.append((length, rank, count - rank))
        each = capacity // int(bounds[bucket]) if own else 1
        place, filled = 0, 0  # items batched so far, tokens in the open batch
        for length, rank, count in own:
            before = place % each
            plan.append((length, rank, bucket, used + place // each, each, before))
            head = min(count, each - before) if before else 0
            filled += head * length
            if before and before + head == each:
                later.append((capacity - filled, used + place // each, 1))
                filled = 0
            full = (count - head) // each
            later.append((capacity - each * length, used + (place + head) // each, full))
            filled += (count - head - full * each) * length
            place += count
        if place % each:
            later.append((capacity - filled, used + place // each, 1))
        used += -(-place // each)
        for rest in later:
            leave(*rest)
    return pd.DataFrame(plan, columns=["length", "first_rank", "bucket", "first_container", "per_container", "before"])


def _assign(plan: pd.DataFrame):
    """A mapInPandas function from (item_id, part_no, from_token, n_tokens, rank) to containers."""
    plan = plan.sort_values(["length", "first_rank"])
    keys = (plan.length.to_numpy(np.int64) << 40) + plan.first_rank.to_numpy(np.int64)
    first, start, each, bucket, before = (plan[c].to_numpy(np.int64) for c in ("first_rank", "first_container", "per_container", "bucket", "before"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, (b.n_tokens.to_numpy(np.int64) << 40) + rank, side="right") - 1
            container = start[at] + (before[at] + rank - first[at]) // each[at]
            yield pd.DataFrame({"item_id": b.item_id, "part_no": b.part_no, "from_token": b.from_token, "n_tokens": b.n_tokens, "bucket": bucket[at].astype(np.int32), "container_id": container})

    return assign


def pack(sizes: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(item_id, part_no, from_token, n_tokens, bucket, container_id): every item of sizes (item_id
    bigint, n_tokens bigint) in containers of the capacity.

    An item larger than the capacity is cut into full parts and a rest, part_no from 0; no other is
    split. Items without tokens, and those with n_tokens null, take no room and go to container 0.
    Repeated rows of an item count once; an item_id of null is dropped; no items give no rows.

    The driver plans on the histogram of the sizes, at most capacity + 1 rows however many items
    there are, and one more for each RANKED items; ranks within a size come from two levels of
    counts, so that a size which a third of all items have is still spread over tasks."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))
    once = sizes.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max(n).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    parts = once.select("item_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    size = F.least(F.col("n") - F.col("part_no") * F.lit(capacity).cast("bigint"), F.lit(capacity).cast("bigint"))
    parts = parts.select("item_id", "part_no", (F.col("part_no") * F.lit(capacity).cast("bigint")).alias("from_token"), size.alias("n_tokens"))
    parts = materialize(parts, "packing")
    salts = F.ceil(F.count("*") / RANKED).cast("int").alias("salts")
    parts = parts.join(F.broadcast(parts.groupBy("n_tokens").agg(salts)), "n_tokens")  # at most capacity + 1 rows
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("item_id", "part_no"), F.col("salts").cast("bigint")).cast("int")).drop("salts")
    counted = parts.groupBy("n_tokens", "salt").count().collect()  # at most capacity + 1 rows and one for each RANKED items
    if not counted:
        return sizes.sparkSession.createDataFrame([], _FILLED)
    table = pd.DataFrame([tuple(r) for r in counted], columns=["n", "salt", "c"]).sort_values(["n", "salt"])
    table["offset"] = table.groupby("n").c.cumsum() - table.c
    histogram = table.groupby("n").c.sum()
    plan = plan_containers(histogram.index.to_numpy(np.int64), histogram.to_numpy(np.int64), capacity, buckets)
    wide = int(table.salt.max()) + 1
    places, offsets = table.n.to_numpy(np.int64) * wide + table.salt.to_numpy(np.int64), table.offset.to_numpy(np.int64)  # ascending
    assign = _assign(plan)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ranked() -> Iterator[pd.DataFrame]:
            for b in batches:
                b["rank"] = b["within"].to_numpy(np.int64) + offsets[np.searchsorted(places, b.n_tokens.to_numpy(np.int64) * wide + b.salt.to_numpy(np.int64))]
                yield b

        yield from assign(ranked())

    within = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("item_id", "part_no")) - 1
    return parts.withColumn("within", within).mapInPandas(place, _FILLED)


def pack_profiles(sizes: DataFrame, capacities: dict[str, int], buckets: int = BUCKETS) -> DataFrame:
    """pack for each profile, with profile_id first; the sizes are counted once for all profiles."""
    once = materialize(sizes, "sizes")
    parts = [pack(once, capacity, buckets).select(F.lit(name).alias("profile_id"), "*") for name, capacity in sorted(capacities.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
