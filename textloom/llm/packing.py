"""Filling fixed-capacity sequences with documents, by cost-balanced packing.

A document costs ``linear * n + quadratic * n**2`` (attention over its own
tokens).  Documents go in descending order to the lowest-cost sequence that still
has room; a new sequence is opened only when none has.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 20_000  # documents packed together; more documents make more shards
MAX_EXPERIMENTS = 1_000  # configurations are few; each packs every document


def pack(sizes: np.ndarray, capacity: int, *, linear: float = 1.0, quadratic: float = 1.0) -> np.ndarray:
    """Sequence number of each size (sizes are at most ``capacity``).

    Among the sequences with room, a tournament tree over the room left finds
    the cheapest.  Sequences are opened one by one: every document larger than
    half the capacity needs its own, and smaller ones fill the cheapest.
    """
    room_slots = 1 << max(1, int(capacity).bit_length())
    best = [np.inf] * (2 * room_slots)
    heaps: dict[int, list[tuple[float, int]]] = {}
    room: list[int] = []
    cost: list[float] = []
    where = np.empty(len(sizes), np.int64)

    def lift(r: int) -> None:
        heap = heaps.get(r)
        node = r + room_slots
        best[node] = heap[0][0] if heap else np.inf
        node >>= 1
        while node:
            low = min(best[2 * node], best[2 * node + 1])
            if best[node] == low:
                break
            best[node] = low
            node >>= 1

    def cheapest(need: int) -> int:
        """Room value in [need, capacity] whose cheapest sequence is the cheapest of all; -1 if none has room."""
        low, high, got, node = need + room_slots, 2 * room_slots - 1, np.inf, -1
        while low <= high:
            if low & 1:
                if best[low] < got:
                    got, node = best[low], low
                low += 1
            if not high & 1:
                if best[high] < got:
                    got, node = best[high], high
                high -= 1
            low >>= 1
            high >>= 1
        if node < 0:
            return -1
        while node < room_slots:
            node = 2 * node if best[2 * node] == best[node] else 2 * node + 1
        return node - room_slots

    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        r = cheapest(n)
        if r < 0:
            s = len(room)
            room.append(capacity)
            cost.append(0.0)
        else:
            _, s = heappop(heaps[r])
            lift(r)
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
        where[i] = s
        if room[s] > 0:
            heappush(heaps.setdefault(room[s], []), (cost[s], s))
            lift(room[s])
    return where


def _pack_shard(linear: float, quadratic: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        whole = (pdf["n_tokens"].to_numpy() // capacity).astype(np.int64)
        rest = pdf["n_tokens"].to_numpy() - whole * capacity
        # full parts of an oversized document fill sequences of their own
        row = np.repeat(np.arange(len(pdf)), whole)
        part = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        tail = np.nonzero(rest)[0]
        packed = pack(rest[tail], capacity, linear=linear, quadratic=quadratic)
        sequence = np.concatenate([packed, packed.max(initial=-1) + 1 + np.arange(len(row))])
        out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[np.concatenate([tail, row])], "part": np.concatenate([whole[tail], part]), "tokens": np.concatenate([rest[tail], np.full(len(row), capacity)])})
        out["sequence_id"] = [f"{key[1]}-{s}" for s in sequence]
        out["unused"] = capacity - out.groupby("sequence_id")["tokens"].transform("sum")
        out["experiment_id"] = key[0]
        return out[["experiment_id", "sequence_id", "doc_id", "part", "tokens", "unused"]]

    return run


def pack_documents(docs: DataFrame, experiments: DataFrame, *, linear: float = 1.0, quadratic: float = 1.0, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assignment ``(experiment_id, sequence_id, doc_id, part, tokens, unused)`` of documents to sequences.

    ``docs`` has ``doc_id, n_tokens``; ``experiments`` has ``experiment_id,
    max_sequence_length``.  A document larger than a sequence is cut into full
    parts and a rest (``part`` counts from 0); no other is cut.  ``unused`` is
    the room left in the sequence.  Documents are spread over shards of about
    ``shard_items`` by the hash of their id and each shard is packed for itself,
    so a task is bounded and only the last sequences of a shard stay open.
    Documents without tokens need no room: they come with a null sequence,
    part 0 and 0 tokens.  Null ids are left out; a repeated id counts once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
    shards = max(1, -(-own.count() // shard_items))
    lengths = experiments.select("experiment_id", F.col("max_sequence_length").cast("bigint").alias("capacity")).where("experiment_id is not null and capacity > 0")
    wanted = lengths.limit(MAX_EXPERIMENTS + 1).collect()
    if len(wanted) > MAX_EXPERIMENTS:
        raise ValueError(f"over {MAX_EXPERIMENTS} experiments in one call")
    each = F.array(*(F.struct(F.lit(r.experiment_id).alias("experiment_id"), F.lit(r.capacity).cast("bigint").alias("capacity")) for r in wanted)).cast("array<struct<experiment_id:string,capacity:bigint>>")
    rows = own.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).select("*", F.inline(each))
    schema = f"experiment_id string, sequence_id string, doc_id {kind}, part bigint, tokens bigint, unused bigint"
    packed = rows.where("n_tokens > 0").groupBy("experiment_id", "shard").applyInPandas(_pack_shard(linear, quadratic), schema)
    none = rows.where("n_tokens = 0").select("experiment_id", F.lit(None).cast("string").alias("sequence_id"), "doc_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("unused"))
    return packed.union(none)
