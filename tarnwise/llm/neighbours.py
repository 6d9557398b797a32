"""Nearest neighbours by a block matrix join in int8 with error bounds.

Vectors are scaled to length 1 and rounded to int8 with a scale of their own; the length of what the rounding left over is
kept. For a tile of queries and candidates the product of the int8 matrices gives every cosine up to a bound that follows
from the two lengths (Cauchy-Schwarz), so a pair whose upper bound is below the k-th best lower bound of its query cannot be
among the k nearest. The pairs that survive are computed from the original vectors in double precision, and heaps of k merge
them over the blocks. The result is exact, so its recall is 1.

Up to QUERIES query vectors are a bounded broadcast. More of them are dealt in blocks, as are the candidates, and every pair of
blocks is a group of rows in one stage: tile meets tile, and a group returns k pairs for each query at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.llm.common import lean, materialize, ship, whole_number

QUERIES, TILE = 8192, 2048
#: Candidates of one task where the queries are too many for one broadcast.
CANDIDATES = 200_000
_OUT = "query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of what rounding left over, and the lengths of the rounded rows, for rows of any length > 0."""
    big = np.abs(x).max(1, keepdims=True)
    y = x / big
    u = y / np.sqrt((y * y).sum(1, keepdims=True))
    scale = np.abs(u).max(1, keepdims=True) / 127
    q = np.rint(u / scale)
    return q.astype(np.int8), scale[:, 0], np.sqrt(((u - q * scale) ** 2).sum(1)), scale[:, 0] * np.sqrt((q * q).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, products summed from the first component to the last, so equal vectors score alike anywhere."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    with np.errstate(all="ignore"):
        out = dot / np.sqrt(aa * bb)
    odd = ~np.isfinite(out) | (aa * bb < 1e-290)
    if odd.any():  # squares beyond the doubles' range: the measure doesn't depend on the vectors' scale
        s, t = a[odd] / np.abs(a[odd]).max(1, keepdims=True), b[odd] / np.abs(b[odd]).max(1, keepdims=True)
        out[odd] = (s * t).sum(1) / np.sqrt((s * s).sum(1) * (t * t).sum(1))
    return np.clip(out, -1.0, 1.0)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding as doubles) whose vectors are neither null, empty nor zero and hold finite numbers only."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select("vec_id", x.alias("embedding")).where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: places and rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    return {int(d): (at := np.flatnonzero(size == d), flat[(start[at][:, None] + np.arange(d))]) for d in np.unique(size)}


class Block:
    """Queries of one dimension and their heaps."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.q, self.scale, self.left, self.length = quantise(rows)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """One tile. Products of int8 rows are whole numbers below 2**24 up to 1040 components, so float32 holds them exactly."""
        q, scale, left, length = quantise(rows)
        kind = np.float32 if rows.shape[1] <= 1040 else np.float64
        near = (self.q.astype(kind) @ q.astype(kind).T).astype(np.float64) * self.scale[:, None] * scale[None, :]
        wide = self.left[:, None] * length[None, :] + left[None, :] * (self.length + self.left)[:, None] + 1e-9
        own = self.ids[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - wide)
        floor = self.least
        if len(ids) > self.k and len(np.unique(ids)) == len(ids):
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        a, b = np.nonzero(~own & (near + wide >= floor[:, None]))
        for x, y, s in zip(a.tolist(), ids[b].tolist(), cosines(self.rows[a], rows[b]).tolist()):
            heap, item = self.heaps[x], (s, -y)
            same = next((h for h in heap if h[1] == -y), None)
            if same is not None:
                if item > same:
                    heap[heap.index(same)] = item
                    heapq.heapify(heap)
            elif len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        for x in np.unique(a):
            if len(self.heaps[x]) == self.k:
                self.least[x] = self.heaps[x][0][0]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest of vectors for each of queries (both vec_id, embedding), by cosine.

    Ties go to the smaller vec_id. A row with the query's own vec_id is no candidate. Rows with one vec_id are one query or one
    candidate, which is as near as the nearest of its vectors, and comes once. Vectors that usable() leaves out take no part; vectors of another dimension are no candidates.
    Ids that are no whole numbers are a TypeError. Other columns are not read.

    Up to QUERIES queries are broadcast, and the candidates stay where they are. With more, blocks of queries and blocks of
    candidates are dealt as rows of one stage, (query block, candidate block) by task.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole_number(vectors, "vec_id")
    whole_number(queries, "vec_id")
    rows = usable(vectors)
    asked = materialize(usable(queries).dropDuplicates(["vec_id", "embedding"]))
    n = asked.count()
    found = _dealt(rows, asked, n, k) if n > QUERIES else _sent(rows, asked, k)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _result(blocks: list[Block]) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        got = [(int(q), -y, s) for q, heap in zip(block.ids, block.heaps) for s, y in heap]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def _meet(mine: dict[int, list[Block]], b: pa.RecordBatch) -> None:
    ids = b.column("vec_id").to_numpy()
    for d, (at, x) in _matrix(b.column("embedding")).items():
        for s in range(0, len(at), TILE):
            for block in mine.get(d, ()):
                block.meet(ids[at[s : s + TILE]], x[s : s + TILE])


def _sent(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    own = asked.toArrow()
    ids = own.column("vec_id").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast([(ids[at], x) for at, x in _matrix(own.column("embedding")).values()] if own.num_rows else [])

    @lean("neighbours")
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {x.shape[1]: [Block(i[s : s + TILE], x[s : s + TILE], k) for s in range(0, len(i), TILE)] for i, x in shared.value}
        for b in batches:
            _meet(mine, b)
        for blocks in mine.values():
            yield from _result(blocks)

    return rows.mapInArrow(join, _OUT)


def _dealt(rows: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """Every (query block, candidate block) is a group of rows: the queries, marked, then the candidates."""
    q_blocks = -(-n // QUERIES)
    c_blocks = max(1, -(-rows.count() // CANDIDATES))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = asked.select(F.lit(0).alias("kind"), "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("i")).withColumn("j", every(c_blocks))
    c = rows.select(F.lit(1).alias("kind"), "vec_id", "embedding", F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(c_blocks)).cast("int").alias("j")).withColumn("i", every(q_blocks))
    dealt = q.unionByName(c).repartition(q_blocks * c_blocks, "i", "j").sortWithinPartitions("i", "j", "kind")

    @lean("neighbours")
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, asks = None, None, []

        def build() -> dict[int, list[Block]]:
            parts: dict[int, list] = {}
            for b in asks:
                ids = b.column("vec_id").to_numpy()
                for d, (at, x) in _matrix(b.column("embedding")).items():
                    parts.setdefault(d, []).append((ids[at], x))
            asks.clear()
            joined = {d: (np.concatenate([i for i, _ in p]), np.concatenate([x for _, x in p])) for d, p in parts.items()}
            return {d: [Block(i[s : s + TILE], x[s : s + TILE], k) for s in range(0, len(i), TILE)] for d, (i, x) in joined.items()}

        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("i", "j", "kind")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                i, j, kind = key[:, lo].tolist()
                if (i, j) != now:
                    for blocks in (mine or {}).values():
                        yield from _result(blocks)
                    now, mine = (i, j), None
                    asks.clear()
                if kind == 0:
                    asks.append(b.slice(lo, hi - lo))
                    continue
                mine = build() if mine is None else mine
                _meet(mine, b.slice(lo, hi - lo))
        for blocks in (mine or {}).values():
            yield from _result(blocks)

    return dealt.select("i", "j", "kind", "vec_id", "embedding").mapInArrow(join, _OUT)


def op8_int8_block_neighbours(spark, sf_dir: str) -> DataFrame:
    """Five nearest of all embeddings for every embedding whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


OP8_SQL = """
with v as (select vec_id, cast(embedding as double[]) e from embeddings),
pairs as (select q.vec_id query_id, c.vec_id, list_cosine_similarity(q.e, c.e) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
