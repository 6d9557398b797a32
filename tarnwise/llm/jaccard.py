r"""Exact n-gram Jaccard join as a join in a metric space.

1 - Jaccard is a metric, and two documents link at a distance of EPS = 0.25 at most. Most documents of a corpus are at distance
1 from each other and from any pivot, where no triangle inequality tells them apart; so the space is first cut by anchors.
A document's anchors are the first n - ceil(0.75 n) + 1 of its n shingles in one fixed order of all shingles; linked documents
share an anchor. Of the documents with an anchor the least one is its pivot, and all of them belong to the pivot's region: a
document lies in the region of every pivot that it shares an anchor with, so a linked pair always meets. The few shingles that
make up over a HOT-th of all are given their pivot, a document that has them, before anchors are sent: documents that have
one as an anchor need not meet in one task to learn their region.

A sieve drops the documents of a region that can't link with any other of it: their counts of shingles by hash class, a thirtieth
of the size of their sets, bound the distance from below. What is left falls into parts that can't link with each other; a part
that several regions have is taken once, and only now are the sets sent to the tasks.

Each part is joined exactly: four of its documents are pivots of smaller regions; a document goes to that of its nearest
pivot, and to every other whose distance is within 2 EPS of the nearest (a linked document's nearest pivot can't be further
away). That recurs until regions are small or don't shrink; then pairs are compared, but for those whose distances to a pivot
differ by more than EPS and those known to be connected. A region over LARGE shingles is dealt out as blocks: every pair of
blocks is a task of bounded size, so no region is held in one task and none is capped.

The fixed order puts shingles last that are frequent within batches of documents, by a bitmap of fixed size; otherwise the
longest come first, as five long words hardly meet by chance in another document, and equally long ones follow by their hashes.
The order decides how much work there is, never the result. Documents with equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwise.llm.common import LOWER, bitmap, in_bitmap, lean, materialize, mix, ship, slices, whole_number, word_hashes

N, PERCENT = 5, 75
EPS = 1 - PERCENT / 100
#: Shingles and documents in one side of a task; bytes of texts of an in-batch count, its least count, and the least sum of such counts of a frequent shingle.
LARGE, MEMBERS, BATCH, OFTEN, FREQUENT = 1_000_000, 1_000, 8 << 20, 4, 24
BITS = 22
#: A key with over a SHARE-th of all rows is hot: there are fewer than SHARE of them, so their lookup rows may be broadcast at any size of the corpus.
SHARE = 1000
#: A shingle that makes up over a HOT-th of all shingles of all documents is hot; there are fewer than HOT of them.
HOT = 100_000


def shingles(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: 58 bits of a hash below 6 bits of 63 - length, so the longest come first."""
    h, sizes, counts = word_hashes([(x or "").encode().translate(LOWER) for x in texts])
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k] if len(roll) else roll
        total = np.concatenate([[0], np.cumsum(sizes)])
        long = np.minimum(63, total[n:] - total[:-n]) if len(roll) else np.zeros(0, np.int64)
        roll = mix(roll) >> np.uint64(6) | (63 - long).astype(np.uint64) << np.uint64(58)
        out, at = [], 0
        for c in counts.tolist():
            if c >= n:
                out.append(np.unique(roll[at : at + c - n + 1]))
            elif c:
                x = np.uint64(c)
                for w in h[at : at + c]:
                    x = x * np.uint64(0xC2B2AE3D27D4EB4F) + w
                out.append(mix(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
    return out


def digest(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order, as two signed longs."""
    with np.errstate(over="ignore"):
        return int(x.sum(dtype=np.uint64).astype(np.int64)), int(mix(x ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64).astype(np.int64))


def levels(n: int) -> int:
    """Binary logarithm of the number of a document's hash classes, four to eight shingles in each."""
    return max(3, (n // 4).bit_length() - 1)


def signature(x: np.ndarray) -> bytes:
    """How many shingles are in each hash class, 255 at most."""
    k = 1 << levels(len(x))
    return np.minimum(np.bincount((x & np.uint64(k - 1)).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes()


def sieve(sizes: list[int], signatures: list[bytes]) -> np.ndarray:
    """Parts of some documents: -1 for one that can't link with another of them; documents that may link are in the same part.

    Hash classes are pivots of the symmetric-difference metric: |x - y| + |y - x| is no less than the sum over all classes of
    the difference of the two counts, and is (|x| + |y|) / 7 at most where the Jaccard similarity is 0.75 or more.
    """
    order = np.argsort(sizes, kind="stable")
    n = np.array(sizes)[order]
    level = [levels(k) for k in n.tolist()]
    own = [np.frombuffer(signatures[k], np.uint8).astype(np.int16) for k in order.tolist()]
    half = [h.reshape(2, -1).sum(0) for h in own]
    part, alone = np.arange(len(n)), np.ones(len(n), bool)
    stop = np.searchsorted(n, n * 100 // PERCENT, "right")
    for k, (size, lev, to) in enumerate(zip(n.tolist(), level, stop.tolist())):
        for lo in range(k + 1, to, 512):
            most = min(to, lo + 512)
            others = np.stack([own[j] if level[j] == lev else half[j] for j in range(lo, most)])
            near = lo + np.flatnonzero(7 * np.abs(others - own[k]).sum(1, dtype=np.int64) <= size + n[lo:most])
            if len(near):
                alone[near] = alone[k] = False
                for p in np.unique(part[near][part[near] != part[k]]):
                    part[part == p] = part[k]
    back = np.empty(len(n), np.int64)
    back[order] = np.where(alone, -1, part)
    return back


@lean("jaccard")
def _sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, i, j, node, n, signature) of one task after another; the parts that the sieve leaves, each under a number that follows from its nodes."""
    now, rows, out = None, [], []

    def close() -> None:
        if len(rows) > 1:
            part = sieve([r[1] for r in rows], [r[2] for r in rows])
            for p in np.unique(part[part >= 0]):
                own = [rows[k] for k in np.flatnonzero(part == p)]
                key = xxhash.xxh3_64_intdigest(np.sort(np.array([r[0] for r in own])).tobytes()) - (1 << 63)
                out.extend((key, r[0], r[1]) for r in own)
        rows.clear()

    def flush() -> pa.RecordBatch:
        cols = zip(*out) if out else ([], [], [])
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["pivot", "node", "n"])
        out.clear()
        return got

    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in ("pivot", "i", "j", "node", "n", "signature")}
        for key, row in zip(zip(cols["pivot"], cols["i"], cols["j"]), zip(cols["node"], cols["n"], cols["signature"])):
            if key != now:
                close()
                now = key
            rows.append(row)
        if len(out) > 50_000:
            yield flush()
    close()
    yield flush()


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row of each key. Its column `weight` is no less than the number of rows with the key, and sums to total at most.

    Rows of hot keys meet their broadcast lookup row where they lie, so a shuffled key has a SHARE-th of all rows at most.
    """
    bar = total / SHARE
    hot = F.broadcast(table.where(F.col("weight") > bar).drop("weight"))
    rest = rows.join(hot, on, "left_anti").join(table.where(F.col("weight") <= bar).drop("weight"), on, how)
    return rows.join(hot, on).unionByName(rest)


def placed(cells: DataFrame) -> DataFrame:
    """cells (pivot, node, n) with task numbers i <= j. A region's blocks hold about LARGE shingles or MEMBERS documents; block k meets every block, alone it meets itself."""
    load = cells.groupBy("pivot").agg(F.ceil(F.greatest(F.sum(F.col("n").cast("long")) / LARGE, F.count("*") / MEMBERS)).cast("int").alias("blocks"), F.count("*").alias("weight"))
    dealt = looked_up(cells, load, ["pivot"], cells.count()).withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("pivot", "node", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))


@lean("jaccard")
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, n, hi, lo, signature) and of shingles that are frequent here (s, c, m: the least document that has it)."""
    names = ["doc_id", "n", "hi", "lo", "signature", "s", "c", "m"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
        for lo, hi in slices([x or "" for x in texts], BATCH):
            sets = shingles(texts[lo:hi])
            keys = [digest(x) for x in sets]
            distinct = {k: x for k, x in zip(keys, sets)}
            s, c = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            s, c = s[c >= OFTEN], c[c >= OFTEN]
            m = np.zeros(len(s), np.int64)
            for key in sorted(distinct, key=lambda k: -k[1]) if len(s) else ():
                at = np.minimum(np.searchsorted(s, distinct[key]), len(s) - 1)
                m[at[s[at] == distinct[key]]] = key[1]
            docs = [ids[lo:hi], [len(x) for x in sets], [k[0] for k in keys], [k[1] for k in keys], [signature(x) for x in sets]]
            pad = [None] * len(s)
            cols = [*(x + pad for x in docs), *([None] * (hi - lo) + x.tolist() for x in (s.view(np.int64), c, m))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=names)


def spread(s: np.ndarray, node: np.ndarray, size: np.ndarray, hot: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
    """Anchors as rows (s, node, n, pivot). Those in hot (sorted) have their pivot already, once a document, and a key of their own, so that no key is hot."""
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    known = hot[at] == s if len(hot) else np.zeros(len(s), bool)
    some = np.unique(np.stack([pivots[at[known]], node[known], size[known]], 1), axis=0) if known.any() else np.zeros((0, 3), np.int64)
    own = mix(mix(some[:, 0].view(np.uint64)) ^ some[:, 1].view(np.uint64)).view(np.int64) if len(some) else some[:, 0]
    cols = [np.concatenate(x) for x in ((s[~known], own), (node[~known], some[:, 1]), (size[~known], some[:, 2].astype(np.int32)))]
    pivot = pa.array(np.concatenate([node[~known], some[:, 0]]), mask=np.arange(len(cols[0])) < np.count_nonzero(~known))
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pivot], names=["s", "node", "n", "pivot"])


class Region:
    """Documents of one task: sorted shingle sets; joined() gives each document the least connected one."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets, self.root = ids, sets, list(range(len(ids)))
        self.size = np.array([len(x) for x in sets])

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            if self.ids[x] > self.ids[y]:
                x, y = y, x
            self.root[y] = x

    def shared(self, x: int, others: list[int]) -> np.ndarray:
        """Sizes of the intersections of x with each of the others."""
        own, flat = self.sets[x], np.concatenate([self.sets[y] for y in others])
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        hit = np.concatenate([[0], np.cumsum(own[at] == flat)])
        end = np.cumsum(self.size[others])
        return hit[end] - hit[end - self.size[others]]

    def link(self, x: int, others: list[int]) -> np.ndarray:
        """Unites x with those it links with; the distances."""
        both = self.shared(x, others)
        union = self.size[x] + self.size[others] - both
        for y in np.flatnonzero(100 * both >= PERCENT * union):
            self.union(x, others[y])
        return 1 - both / union

    def pairs(self, docs: list[int], far: np.ndarray | None = None) -> None:
        """Compares all pairs that are not ruled out. far: distances [pivot, place in docs]."""
        order = np.argsort(self.size[docs], kind="stable")
        for k, o in enumerate(order[:-1].tolist()):
            x = docs[o]
            rest = order[k + 1 :]
            rest = rest[100 * self.size[x] >= PERCENT * self.size[np.array(docs)[rest]]]
            if far is not None and len(rest):
                rest = rest[(np.abs(far[:, rest] - far[:, o : o + 1]) <= EPS + 1e-9).all(0)]
            root = self.find(x)
            others = [docs[r] for r in rest.tolist() if self.find(docs[r]) != root]
            for lo in range(0, len(others), 512):
                self.link(x, others[lo : lo + 512])

    def join(self, docs: list[int]) -> None:
        if len(docs) < 2 or len({self.find(x) for x in docs}) == 1:
            return
        if len(docs) <= 16:
            return self.pairs(docs)
        by_size = np.array(docs)[np.argsort(self.size[docs], kind="stable")]
        pivots = by_size[np.linspace(0, len(docs) - 1, 4).astype(int)].tolist()
        far = np.stack([self.link(p, docs) for p in pivots])
        near = far.min(0)
        regions = [[docs[k] for k in np.flatnonzero(far[q] - near <= 2 * EPS + 1e-9)] for q in range(len(pivots)) if (far[q] == near).any()]
        if max(map(len, regions)) > 0.8 * len(docs):
            return self.pairs(docs, far)
        for r in regions:
            self.join(r)
        return None

    def joined(self) -> list[tuple[int, int]]:
        self.join([k for k in range(len(self.ids)) if len(self.sets[k])])
        return [(self.ids[k], self.ids[r]) for k in range(len(self.ids)) if (r := self.find(k)) != k]


@lean("jaccard")
def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task after another, by (pivot, i, j)."""
    now, ids, sets, out = None, [], [], []

    def close() -> None:
        out.extend(Region(ids, sets).joined())
        ids.clear()
        sets.clear()

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        out.clear()
        return got

    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in ("pivot", "i", "j")))
        for key, doc, raw in zip(keys, b.column("doc_id").to_pylist(), b.column("shingles")):
            if key != now:
                close()
                now = key
            ids.append(doc)
            sets.append(np.frombuffer(raw.as_py(), np.uint64))
        if len(out) > 50_000:
            yield flush()
    close()
    yield flush()


def connected(edges: DataFrame) -> DataFrame:
    """Rows (doc_id, component): every document in an edge (a, b) and the least one it is connected with, by large-star and small-star rounds."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).withColumn("m", F.least("u", "m"))
        large = looked_up(both, least, ["u"], 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        small = looked_up(large, low, ["u"], 2 * now[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = materialize(small)
    return edges.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("component"))


def components(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles int, component_id), one for each row of docs (doc_id, text).

    Null and empty texts, and texts without a word, have no shingles and are linked with nothing. Rows with the same doc_id are
    one document that has the links of each of its texts. A null doc_id is linked with nothing; its component is null. Ids that
    are no whole numbers are a TypeError.
    Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    whole_number(docs, "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = materialize(rows.mapInArrow(_profile, "doc_id long, n int, hi long, lo long, signature binary, s long, c long, m long"))
    known = profile.where("n is not null").select("doc_id", "n", "hi", "lo", "signature")
    frequent = materialize(profile.where("c is not null").groupBy("s").agg(F.sum("c").alias("c"), F.min("m").alias("m")).where(F.col("c") >= FREQUENT))
    late = spark.sparkContext.broadcast(bitmap(frequent, "s", BITS))
    bar = (known.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) / HOT
    table = frequent.where(F.col("c") > bar).select("s", "m").toPandas().sort_values("s")
    hot = spark.sparkContext.broadcast((table["s"].to_numpy(np.int64), table["m"].to_numpy(np.int64)))

    @lean("jaccard")
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices([x or "" for x in texts]):
                s, node, size = [], [], []
                for x in shingles(texts[lo:hi]):
                    key = digest(x)
                    if not len(x) or key in seen:
                        continue
                    seen.add(key)
                    last = in_bitmap(late.value, x)
                    most = len(x) - -(-PERCENT * len(x) // 100) + 1
                    first = x[~last][:most]
                    if len(first) < most:
                        first = np.concatenate([first, x[last][: most - len(first)]])
                    s.append(first)
                    node.append(np.full(most, key[1]))
                    size.append(np.full(most, len(x), np.int32))
                if s:
                    yield spread(np.concatenate(s).view(np.int64), np.concatenate(node), np.concatenate(size), *hot.value)

    found = rows.where("doc_id is not null").mapInArrow(anchors, "s long, node long, n int, pivot long")
    met = found.selectExpr("node", "n", "pivot", "min(node) over (partition by s) least", "max(node) over (partition by s) last").where("pivot is not null or least <> last")
    cells = materialize(met.selectExpr("coalesce(pivot, least) pivot", "node", "n").distinct())
    seen = known.where("n > 0 and doc_id is not null")
    signed = seen.groupBy(F.col("lo").alias("node"), "hi", "n").agg(F.min("signature").alias("signature")).drop("hi")
    tested = placed(cells).join(signed, "node").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").select("pivot", "i", "j", "node", "n", "signature")
    cells = materialize(tested.mapInArrow(_sieved, "pivot long, node long, n int").distinct())
    reps = materialize(seen.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")))
    wanted = reps.join(cells.select(F.col("node").alias("lo")).distinct(), "lo", "left_semi").select("rep")
    asked = spark.sparkContext.broadcast(bitmap(wanted, "rep", BITS))

    @lean("jaccard")
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, tuple[int, int]]] = set()
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            at = np.flatnonzero(in_bitmap(asked.value, ids))
            if not len(at):
                continue
            some = b.take(pa.array(at))
            texts, ids = some.column("text").to_pylist(), ids[at]
            for lo, hi in slices([x or "" for x in texts]):
                new = {key: x for doc, x in zip(ids[lo:hi].tolist(), shingles(texts[lo:hi])) if (key := (doc, digest(x))) not in seen}
                seen.update(new)
                cols = [pa.array([k[0] for k in new], pa.int64()), pa.array([k[1][1] for k in new], pa.int64()), pa.array([x.tobytes() for x in new.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "shingles"])

    held = rows.where("doc_id is not null").mapInArrow(sets, "doc_id long, node long, shingles binary")
    tasks = placed(cells).join(held, "node").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "doc_id").select("pivot", "i", "j", "doc_id", "shingles")
    links = tasks.mapInArrow(_regions, "a long, b long")
    known, total = known.drop("signature"), known.count()
    full, empty = known.where("n > 0 and doc_id is not null"), known.where("n = 0 or doc_id is null")
    several = known.groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "n")).alias("a"), F.max(F.struct("hi", "lo", "n")).alias("b"), F.count("*").alias("weight")).where("a <> b").drop("a", "b")
    twins = looked_up(looked_up(full, several, ["doc_id"], total), reps, ["hi", "lo", "n"], total)
    joined = materialize(connected(links.unionByName(twins.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))))
    alike = reps.join(joined.withColumnRenamed("doc_id", "rep"), "rep", "left").select("hi", "lo", "n", F.coalesce("component", "rep").alias("component"), "weight")
    lone = empty.groupBy("doc_id").agg(F.count("*").alias("weight")).join(joined, "doc_id")
    out = looked_up(full, alike, ["hi", "lo", "n"], total).unionByName(looked_up(empty, lone, ["doc_id"], total, "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are linked with one of a smaller doc_id. Documents with a null doc_id or no words stay."""
    gone = components(docs).where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_jaccard_metric_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at a Jaccard similarity of 0.75."""
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
