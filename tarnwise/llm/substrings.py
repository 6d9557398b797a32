"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash h = (h << 1) + GEAR[byte] over the bytes of a text, 32 bits wide, depends on the last 32 bytes only. Its value
where a word ends is the word's mark; a chunk ends behind a word whose mark is the highest of REACH words to either side
(the first of equal ones), and after MOST words at the latest. Where marks come again within REACH words, as in a word said
over and over, there is no first one; a chunk then ends at such a mark STEP words or more behind the last end. So boundaries follow the content: an insertion moves those
near it and no others. A chunk's digest is the 128-bit xxHash of its bytes, every white-space byte read as a space.

Of each digest the first chunk by (doc_id, text hash, place) stays; later ones are duplicates. A run of adjacent duplicate
chunks is cut out if it has at least LEAST words, so a passage of over 50 words that stood before loses all but its rims
(6.5 words each in the mean of prose, 17 at the 99th percentile), and a few common words in a row don't count.

Chunks that repeat within a batch of documents are told apart before the shuffle, so a hot chunk sends one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.llm.common import SLICE, lean, mix, ship, slices, whole_number

REACH, MOST, LEAST = 3, 256, 16
#: A multiple of all periods up to REACH, so that all chunks in the midst of periodic text are alike.
STEP = 12
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)
#: White space to a space; nothing else changes.
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind every byte, for all at once: the sum over the last 32 bytes by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def marks(data: np.ndarray, last: np.ndarray, size: int = SLICE) -> np.ndarray:
    """The rolling hash behind the bytes `last`, `size` bytes of data at a time, each with the 32 bytes before it."""
    out = np.zeros(len(last), np.int64)
    for at in range(0, len(data), size):
        lo, hi = np.searchsorted(last, (at, at + size))
        before = max(0, at - 32)
        out[lo:hi] = gear(data[before : at + size])[last[lo:hi] - before]
    return out


def spaced(at: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Those of the places `at` that are in top or STEP words or more behind the last that stays."""
    out, last = [], -1
    for k, sure in zip(at.tolist(), top[at].tolist()):
        if sure or k - last >= STEP:
            out.append(k)
            last = k
    return np.array(out, np.int64)


def ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of one text end (bytes), and their numbers of words. data has no white space but spaces."""
    a = np.frombuffer(data, np.uint8)
    ink = a != 32
    last = np.flatnonzero(ink & ~np.append(ink[1:], False))  # last bytes of words
    if not len(last):
        return (np.array([len(data)]), np.array([0])) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    mark = marks(a, last)
    n = len(mark)
    wide = np.full(n + 2 * REACH, -1, np.int64)
    wide[REACH : REACH + n] = mark
    top, level, again = np.ones(n, bool), np.ones(n, bool), np.zeros(n, bool)
    for k in range(1, REACH + 1):
        left = wide[REACH - k : REACH - k + n]
        high = mark >= wide[REACH + k : REACH + k + n]
        top &= (mark > left) & high
        level &= (mark >= left) & high
        again |= mark == left
    level &= again
    at = np.flatnonzero(top | level)
    if level.any():
        at = spaced(at, top)
    if not len(at) or at[-1] != n - 1:
        at = np.append(at, n - 1)
    gaps = np.diff(np.append(-1, at))
    if gaps.max() > MOST:
        at = np.unique(np.concatenate([at, *(np.arange(e - g + MOST, e, MOST) for e, g in zip(at, gaps) if g > MOST)]))
    starts = np.flatnonzero(ink & ~np.append(False, ink[:-1]))
    stop = np.where(at + 1 < n, starts[np.minimum(at + 1, n - 1)], len(data))
    return stop, np.diff(np.append(-1, at))


_CHUNK = "doc_id long, text_hash long, hi long, lo long, at int, to int, words int, again boolean"


@lean("substrings")
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hashes = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text_hash").to_numpy()
        texts = [(x.as_py() or "").encode().translate(SPACES) for x in b.column("text")]
        for lo, hi in slices(texts, 8 << 20):
            owner, at, to, words, digests = [], [], [], [], []
            for k in range(lo, hi):
                stop, n = ends(texts[k])
                begin = np.append(0, stop[:-1]) if len(stop) else stop
                digests += [xxhash.xxh3_128_digest(texts[k][s:e].rstrip(b" ")) for s, e in zip(begin.tolist(), stop.tolist())]
                owner.append(np.full(len(stop), k))
                at.append(begin)
                to.append(stop)
                words.append(n)
            if not digests:
                continue
            owner, at, to, words = (np.concatenate(x) for x in (owner, at, to, words))
            key = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            doc, th = ids[owner], hashes[owner]
            order = np.lexsort((at, th, doc, key[:, 1], key[:, 0]))
            k, d, h, p = key[order], doc[order], th[order], at[order]
            same = np.append(False, (k[1:] == k[:-1]).all(1))
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
            again = np.empty(len(k), bool)
            again[order] = same & ((d != d[head]) | (h != h[head]) | (p != p[head]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), *(pa.array(x.astype(np.int32)) for x in (at, to, words)), pa.array(again)],
                names=["doc_id", "text_hash", "hi", "lo", "at", "to", "words", "again"],
            )


def runs(flags: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, text_hash, spans): spans, flat byte ranges of adjacent duplicate chunks of at least `least` words together."""
    w = Window.partitionBy("doc_id", "text_hash").orderBy("at")
    new = F.coalesce(F.lag("to").over(w) != F.col("at"), F.lit(True)).cast("int")
    joined = flags.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    cutout = joined.groupBy("doc_id", "text_hash", "run").agg(F.min("at").alias("at"), F.max("to").alias("to"), F.sum("words").alias("words")).where(F.col("words") >= least)
    return cutout.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("spans"), F.sum("words").alias("cut_words"))


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, text_hash, spans, cut_words) of those documents (doc_id, text) from which something is cut.

    Rows with the same doc_id and the same text are one document and don't make each other duplicates; other rows with the
    same doc_id are documents of their own, in the order of their text hashes. A null doc_id takes no part; one that is no
    whole number is a TypeError. Null and empty texts have no chunks.
    """
    ship(docs.sparkSession)
    whole_number(docs, "doc_id")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    chunks = rows.mapInArrow(_chunks, _CHUNK)
    spread = F.when(F.col("again"), F.xxhash64("doc_id", "text_hash", "at")).otherwise(F.lit(0))
    w = Window.partitionBy("hi", "lo", spread).orderBy("doc_id", "text_hash", "at")
    flags = chunks.withColumn("rank", F.rank().over(w)).where(F.col("again") | (F.col("rank") > 1))
    return runs(flags.select("doc_id", "text_hash", "at", "to", "words").distinct(), least)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def dedupe(docs: DataFrame, least: int = LEAST, prefix: str = "") -> DataFrame:
    """docs without the repeated passages in their texts, with cut_words long, cut_bytes long and n_spans int. Texts without any stay as they are.

    Columns of docs with these names are replaced, unless the new names get a prefix.
    """
    found = repeats(docs, least).withColumnRenamed("doc_id", "__doc").withColumnRenamed("text_hash", "__hash").withColumnRenamed("spans", "__spans").withColumnRenamed("cut_words", "__cut")
    new = [prefix + c for c in ("cut_words", "cut_bytes", "n_spans")]
    rows = docs.drop(*new)
    met = rows.withColumn("__text_hash", F.xxhash64("text")).join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("__text_hash") == F.col("__hash")), "left")
    # byte ranges on the JVM: the pieces between the spans, of the text as binary
    raw = F.col("text").cast("binary")
    n = F.size("__spans")
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.substring(
            raw,
            F.when(k == 0, F.lit(0)).otherwise(F.element_at("__spans", F.greatest(k, F.lit(1)))["to"]) + 1,
            F.when(k == n, F.octet_length("text")).otherwise(F.element_at("__spans", F.least(k + 1, n))["at"]) - F.when(k == 0, F.lit(0)).otherwise(F.element_at("__spans", F.greatest(k, F.lit(1)))["to"]),
        ),
    )
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(F.transform(pieces, lambda x: x.cast("string")), ""))
    size = F.coalesce(F.expr("aggregate(__spans, 0L, (a, x) -> a + x.to - x.at)"), F.lit(0))
    cols = [text.alias("text") if c == "text" else F.col(c) for c in rows.columns]
    return met.select(*cols, F.coalesce("__cut", F.lit(0)).cast("long").alias(new[0]), size.cast("long").alias(new[1]), F.coalesce(n, F.lit(0)).alias(new[2]))


def op5_gear_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """What is cut from every document: doc_id, n_spans, cut_words, cut_bytes, and the digest of what is left."""
    out = dedupe(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_spans", "cut_words", "cut_bytes", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), (F.col("n_spans") > 0).alias("repeats"))
