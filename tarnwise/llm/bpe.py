"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can come last in the prefix's encoding. That token is found from the
tables of shorter prefixes: a token t that ends here is the one if the last token of the prefix before it, followed by t,
is itself an encoding (the two don't merge otherwise). The encoding of the whole is read off from the end. A table can be
appended to, and after an edit only the entries behind it are redone, up to where they agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from tarnwise.llm.common import claim, held, ship, trim

#: Pieces, and pairs of tokens, that a worker keeps.
KEPT = 100_000
#: Characters of a kept piece and its ids that count as one more piece.
LONG = 128
#: Characters of a long text that are split at once, and of texts whose new pieces are encoded together.
PART = BATCH = 1 << 20


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {k: t for t, k in ranks.items()}
        self.tails = {t[k:]: -1 for t in ranks for k in range(len(t))} | ranks  # -1: only the tail of a token
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the neighbours that make the token of least rank, the first of them, until none make one."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, t: int) -> bool:
        """Whether merging makes token t of its own bytes."""
        if t not in self.alone:
            self.alone[t] = self.merge(self.bytes_of[t]) == [t]
        return self.alone[t]

    def fits(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes."""
        if len(self.pairs) > 7 * KEPT:
            self.pairs.clear()
        got = self.pairs[a << 32 | b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def extend(self, data: bytes, table: list[int], to: int) -> None:
        """Adds the last tokens of the prefixes of data up to length `to`; table holds those of shorter ones, -1 for the empty prefix."""
        tails, pairs = self.tails.get, self.pairs
        for j in range(len(table), to + 1):
            for i in range(j - 1, -1, -1):
                t = tails(data[i:j])
                if t is None:
                    raise ValueError(f"no token ends at byte {j}; the vocabulary lacks a byte")
                if t >= 0:
                    if not i:
                        good = self.stands(t)
                    elif (good := pairs.get(table[i] << 32 | t)) is None:
                        good = self.fits(table[i], t)
                    if good:
                        table.append(t)
                        break
            else:
                raise ValueError(f"no token ends at byte {j}; the vocabulary lacks a byte")

    def read(self, table: list[int]) -> list[int]:
        """The encoding, from the end."""
        out, j = [], len(table) - 1
        while j:
            out.append(table[j])
            j -= len(self.bytes_of[table[j]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is a token stays whole, as the library has it; else the table's encoding."""
        return next(self.encode_pieces([data]))

    def encode_pieces(self, sorted_pieces: list[bytes]) -> Iterator[list[int]]:
        """The encodings of pieces in their order; what a piece begins with alike the one before it keeps its entries."""
        table, before = [-1], b""
        for data in sorted_pieces:
            if data in self.ranks:
                yield [self.ranks[data]]
                continue
            k, most = 0, min(len(before), len(data))
            while k < most and before[k] == data[k]:
                k += 1
            del table[k + 1 :]
            self.extend(data, table, len(data))
            before = data
            yield self.read(table)


class Table:
    """Last tokens of all prefixes of one piece of bytes."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last, len(self.data))

    def edit(self, at: int, to: int, data: bytes) -> int:
        """Puts data in place of bytes at..to; returns how many entries were redone."""
        old, width = self.last[to:], max(map(len, self.encoder.ranks))
        self.data = self.data[:at] + data + self.data[to:]
        del self.last[at + 1 :]
        same = redone = 0
        for j in range(at + 1, len(self.data) + 1):
            self.encoder.extend(self.data, self.last, j)
            redone += 1
            k = j - (at + len(data))
            same = same + 1 if 0 < k < len(old) and old[k] == self.last[j] else 0
            if same > width:  # all that later entries look back on is as before
                self.last += old[k + 1 :]
                break
        return redone

    def ids(self) -> list[int]:
        return self.encoder.read(self.last)


class Pieces(dict):
    """Decimal ids of each piece, joined by commas, of the last KEPT to 2 * KEPT pieces, fewer if they are long: the older half goes when the newer is full."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old, self.size = encoder, {}, 0

    def keep(self, piece: str, ids: str) -> None:
        self[piece] = ids
        self.size += 1 + (len(piece) + len(ids)) // LONG

    def turn(self) -> None:
        """If the newer half is full, it becomes the older one."""
        if self.size >= KEPT:
            self.old, self.size = dict(self), 0
            self.clear()

    def __missing__(self, piece: str) -> str:
        self.turn()
        ids = self.old.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.encoder.encode_piece(piece.encode())))
        self.keep(piece, ids)
        return ids

    def learn(self, found: set[str]) -> None:
        """Brings many pieces into the newer half, beyond its bound if need be. New ones are encoded in byte order, so that neighbours share the entries of their common prefix."""
        self.turn()
        new = []
        for p in found:
            if p not in self:
                if (ids := self.old.get(p)) is None:
                    new.append(p.encode())
                else:
                    self.keep(p, ids)
        new.sort()
        for data, ids in zip(new, self.encoder.encode_pieces(new)):
            self.keep(data.decode(), ",".join(map(str, ids)))


def loaded(path: str) -> tuple:
    """Ids of each piece (decimal, joined by commas), bytes of each id, and the compiled pattern."""

    def make() -> tuple:
        import public_tokenizers

        encoder = Encoder(load_ranks(path))
        return Pieces(encoder), encoder.bytes_of, regex.compile(public_tokenizers.PATTERN)

    return held(f"bpe {path}", make)


_INK = regex.compile(r"(?<=\S)\s")


def parts(text: str) -> Iterator[str]:
    """text in parts of about PART characters, cut before white space that follows a character: a piece always ends there."""
    at = 0
    while len(text) - at > PART:
        found = _INK.search(text, at + PART)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(text: str, path: str) -> Iterator[list[str]]:
    """Part by part, the ids of the part's pieces, as decimal text joined by commas."""
    pieces, _, pattern = loaded(path)
    for part in parts(text):
        if found := pattern.findall(part):
            yield list(map(pieces.__getitem__, found))


def split_texts(texts: pa.Array, path: str) -> Iterator[Iterator[list[str]]]:
    """encode_text() of every text; short texts are split together, and their new pieces are learned at once."""
    pieces, _, pattern = loaded(path)
    held: list[list[str]] = []
    size = 0

    def give() -> Iterator[Iterator[list[str]]]:
        pieces.learn(set().union(*held))
        for found in held:
            yield iter([list(map(pieces.__getitem__, found))] if found else [])
        held.clear()

    for text in texts:
        text = text.as_py() or ""
        if len(text) > PART:
            yield from give()
            yield encode_text(text, path)
            size = 0
            continue
        held.append(pattern.findall(text))
        size += len(text)
        if size > BATCH:
            yield from give()
            size = 0
    yield from give()


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(loaded(path)[1].__getitem__, ids.tolist()))


def tokenize(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """docs' columns `keep` (doc_id if not given) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids (array<int>).

    The digests are of the decimal ids joined by commas and of the bytes that the ids decode to. A null text is empty; an
    empty text has no tokens. Repeated rows are encoded each. No other columns are read.
    """
    ship(docs.sparkSession)
    path, keep = path or rank_file(), keep or ["doc_id"]
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(f"bpe {path}")
        for b in batches:
            count, ids_sha, text_sha, all_ids = [], [], [], []
            for found in split_texts(b.column("__text"), path):
                n, a, d, got = 0, hashlib.sha256(), hashlib.sha256(), []
                for pieces in found:
                    part = ",".join(pieces)
                    ids = np.fromstring(part, np.int32, sep=",")
                    a.update((b"," if n else b"") + part.encode())
                    n += len(ids)
                    d.update(decode_ids(ids, path))
                    if with_ids:
                        got.append(ids)
                count.append(n)
                ids_sha.append(a.hexdigest())
                text_sha.append(d.hexdigest())
                all_ids.append(np.concatenate(got) if got else np.zeros(0, np.int32))
            cols = [*(b.column(c) for c in keep), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            if with_ids:
                starts = np.cumsum([0, *map(len, all_ids)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids)
        trim()

    schema = rows.select(*keep).schema.add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    return rows.mapInArrow(run, schema.add("token_ids", ArrayType(IntegerType())) if with_ids else schema)


def op7_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
