"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING slots. Every shard has `vnodes` points on it; the slots up to and with a point form the arc of its shard.
A row's doc_id picks its slot. A shard takes rows of its own arcs until it is full; the rest of an arc goes on clockwise to
the next point whose shard has room. Capacities are floor(load * n / shards), plus one for the first few shards if load is 1,
so with load 1 the counts of two shards differ by one at most, and most rows still lie in the shard that the ring names.

Only counts per slot (at most RING rows, whatever the input) reach the driver, which walks the ring over them. Rows that are
alike in doc_id, size and checksum are counted before any shuffle and dealt out again afterwards, so a repeated key is no
hot group. A slot's rows are ranked by (hash, doc_id, checksum, size) in one window of n / RING rows.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.llm.common import materialize

RING = 1 << 16
#: Rows that one generated chunk of equal rows holds.
CHUNK = 10_000


def points(shards: int, vnodes: int = 64, ring: int = RING) -> list[tuple[int, int]]:
    """The ring's points (slot, shard), clockwise; where two fall on a slot the first in (shard, vnode) order keeps it and the other goes on to the next free slot."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = zlib.crc32(f"{s}/{v}".encode()) * 2654435761 % (1 << 32) * ring >> 32
            while at in taken:
                at = (at + 1) % ring
            taken[at] = s
    return sorted(taken.items())


def walk(counts: list[int], ring: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, first rank, end rank, shard, first slot in the shard)."""
    room, used, out, rest = list(room), [0] * len(room), [], []

    def put(arc: int, at: int, n: int, shard: int) -> int:
        if k := min(n, room[shard]):
            out.append((arc, at, at + k, shard, used[shard]))
            room[shard] -= k
            used[shard] += k
        return k

    for arc, (_, shard) in enumerate(ring):
        if (k := put(arc, 0, counts[arc], shard)) < counts[arc]:
            rest.append((arc, k))
    for arc, at in rest:
        to = arc
        while at < counts[arc]:
            to = (to + 1) % len(ring)
            at += put(arc, at, counts[arc] - at, ring[to][1])
    return out


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 64, load: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, home): every row of docs once, `home` the shard that the ring names.

    Null text: size 16, checksum 0. Null keys share a ring slot. Equal rows get different slots. An empty table gives no rows.
    Columns of docs but key and text are not read.
    """
    spark = docs.sparkSession
    ring = points(shards, vnodes)
    bounds, owner, at = [s for s, _ in ring], [], 0
    for slot in range(RING):
        while at < len(bounds) and bounds[at] < slot:
            at += 1
        owner.append(at % len(ring))
    arcs = F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")
    body = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(F.col(key))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        h.alias("h"), F.shiftrightunsigned(h, 48).cast("int").alias("ring_slot"),
    )
    rows = materialize(rows.groupBy("ring_slot", "h", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n")))
    per_slot = [0] * RING
    for slot, n in rows.groupBy("ring_slot").agg(F.sum("n").alias("n")).collect():
        per_slot[slot] = n
    counts, start = [0] * len(ring), [0] * RING
    for slot in sorted(range(RING), key=lambda s: (s - bounds[-1] - 1) % RING):  # the first arc begins behind the last point
        start[slot] = counts[owner[slot]]
        counts[owner[slot]] += per_slot[slot]
    total = sum(counts)
    room = [int(load * total) // shards + (load > 1 or s < total % shards) for s in range(shards)]
    pieces = walk(counts, ring, room)
    first = F.split(F.lit(",".join(map(str, start))), ",").cast("array<long>")
    said = F.from_json(F.lit(json.dumps(pieces)), "array<array<long>>")
    pieces_df = F.broadcast(spark.range(1).select(F.explode(said).alias("x")).select(*[F.element_at("x", k + 1).alias(c) for k, c in enumerate(("arc", "lo", "hi", "shard", "base"))]))
    homes = F.split(F.lit(",".join(str(s) for _, s in ring)), ",").cast("array<int>")
    w = Window.partitionBy("ring_slot").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("end", F.sum("n").over(w)).select(
        "doc_id", "size", "text_crc32", F.element_at(arcs, F.col("ring_slot") + 1).alias("arc"),
        (F.element_at(first, F.col("ring_slot") + 1) + F.col("end") - F.col("n")).alias("a"), "n",
    ).withColumn("b", F.col("a") + F.col("n"))
    met = ranked.join(pieces_df, "arc").where((F.col("a") < F.col("hi")) & (F.col("b") > F.col("lo")))
    met = met.withColumn("from", F.greatest("a", "lo")).withColumn("to", F.least("b", "hi"))
    met = met.withColumn("from", F.explode(F.expr(f"sequence(from, to - 1, {CHUNK}L)"))).withColumn("to", F.least(F.col("to"), F.col("from") + CHUNK))
    met = met.withColumn("rank", F.explode(F.expr("sequence(from, to - 1)")))
    return met.select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.element_at(homes, F.col("arc") + 1).alias("home")
    )


def op1_consistent_hash_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")
