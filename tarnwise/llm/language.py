"""Language ID by segmentation-marginalised unigrams.

The vocabulary is the fixed piece list of a public tokenizer; nothing but the probability of each piece in each language is
learned. A word (a run of letters, of any length, in lower case, behind the word mark) can be cut into pieces in many ways; its probability
is the sum over all of them, which the forward algorithm adds up from left to right. A text's score is the sum over its words.
The piece probabilities come from expectation-maximisation over the words of labelled rows: each round, the forward-backward
algorithm gives every piece its expected count in each language.

The labelled rows are a hash sample of about SAMPLE rows of each language (all rows of a language that has no more), a bound
that the parameter documents; so however rare a language is, it is learned. Prediction reads every word of every text. What
the driver collects is languages x pieces, whatever the input.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tarnwise.llm.common import held, lean, materialize, ship, trim

SAMPLE, ROUNDS, LEAST = 4_000, 2, 0.01
#: Places of a word that the recurrence passes between two scalings (FLOOR ** WINDOW is within the doubles' range), and the least probability of a piece.
WINDOW, FLOOR = 24, 1e-9
#: Tokens whose scores a worker keeps, and letters of text that it scores at once.
KEPT, AT_ONCE = 150_000, 1 << 20
WORDS = re.compile(r"[^\W\d_]+")
MARK = "▁"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """The pieces of a vocabulary file. Piece 0 is none; piece 1 stands for any character that no piece has.

    All prefixes of pieces form a trie, whose nodes that have children come first. Node 0 is dead: it leads to itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)))
        pieces = sorted({p for p in normal if p == p.lower() and all(c == MARK or c.isalpha() for c in p)} | {MARK})
        self.ids = {p: k for k, p in enumerate(pieces, 2)}
        self.size, self.wide = len(pieces) + 2, max(map(len, pieces))
        inner = sorted({p[:k] for p in pieces for k in range(1, len(p))})
        nodes = {x: k for k, x in enumerate([*inner, *sorted(self.ids.keys() - set(inner))], 1)}
        letters = {c: k for k, c in enumerate(sorted({c for p in pieces for c in p[1:]}), 1)}
        self.inner = len(inner)
        self.root, self.letter = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.step = np.zeros((self.inner + 1, len(letters) + 1), np.int32)
        self.piece = np.zeros(len(nodes) + 1, np.int32)
        for x, k in nodes.items():
            if len(x) > 1:
                self.step[nodes[x[:-1]], letters[x[-1]]] = k
            else:
                self.root[ord(x)] = k
            self.piece[k] = self.ids.get(x, 0)

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """[word, place]: the characters of words of one length, behind the word mark."""
        return np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)

    def pieces(self, codes: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Piece [word, start - lo, width - 1], 0 for none, of the starts lo up to hi; widths go as far as any of the words has a piece."""
        n = codes.shape[1]
        hi = n if hi is None else min(hi, n)
        seen = codes[:, lo : hi + self.wide - 1]
        node, letter = self.root[seen[:, : hi - lo]], self.letter[seen]
        out = np.zeros((len(codes), hi - lo, min(self.wide, n - lo)), np.int32)
        out[:, :, 0] = self.piece[node]
        out[:, :, 0][out[:, :, 0] == 0] = 1
        widest = 1
        for w in range(1, out.shape[2]):
            starts = min(hi - lo, seen.shape[1] - w)
            before = node[:, :starts]
            node = self.step[np.where(before > self.inner, 0, before), letter[:, w : w + starts]]
            if not node.any():
                break
            out[:, :starts, w] = found = self.piece[node]
            if found.any():
                widest = w + 1
        return out[:, :, :widest]


def log_sums(lat: Lattice, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[word, ...]: the logarithm of the sum over all segmentations of each word. p: [piece, ...], 0 for piece 0.

    The recurrence runs through WINDOW places at a time and is scaled in between, so words may have any length.
    """
    words, n = codes.shape
    a, scale = np.zeros((words, WINDOW + lat.wide, *p.shape[1:])), np.zeros((words, *p.shape[1:]))
    a[:, 0] = 1
    for lo in range(0, n, WINDOW):
        ids = lat.pieces(codes, lo, lo + WINDOW)
        size, wide = ids.shape[1:]
        for i in range(size):
            a[:, i + 1 : i + 1 + wide] += a[:, i, None] * p[ids[:, i]]
        top = a[:, size : size + lat.wide].max(1)
        scale += np.log(top)
        a[:, : lat.wide] = a[:, size : size + lat.wide] / top[:, None]
        a[:, lat.wide :] = 0
    return np.log(a[:, 0]) + scale


def expected(lat: Lattice, codes: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of all words, each word counted `weight` times. p: [piece].

    Forward sums of all places are kept, scaled by window; backward sums are kept for one window.
    """
    words, n = codes.shape
    starts = list(range(0, n, WINDOW))
    a, scales = np.zeros((words, n + 1 + WINDOW + lat.wide)), [np.zeros(words)]
    a[:, 0] = 1
    for lo in starts:
        ids = lat.pieces(codes, lo, lo + WINDOW)
        size, wide = ids.shape[1:]
        for i in range(lo, lo + size):
            a[:, i + 1 : i + 1 + wide] += a[:, i, None] * p[ids[:, i - lo]]
        top = a[:, lo + size : lo + size + lat.wide].max(1)
        a[:, lo + size : lo + size + lat.wide] /= top[:, None]
        scales.append(scales[-1] + np.log(top))
    total, behind = np.log(a[:, n]) + scales[-1], np.zeros(words)
    b, out = np.zeros((words, WINDOW + lat.wide)), np.zeros(len(p))
    ahead = np.zeros((words, lat.wide))
    ahead[:, 0] = 1
    for k, lo in reversed(list(enumerate(starts))):
        ids = lat.pieces(codes, lo, lo + WINDOW)
        size, wide = ids.shape[1:]
        b[:] = 0
        b[:, size : size + lat.wide] = ahead
        share = np.exp(scales[k] + behind - total) * weight
        for i in range(size - 1, -1, -1):
            x = p[ids[:, i]] * b[:, i + 1 : i + 1 + wide]
            b[:, i] = x.sum(1)
            out += np.bincount(ids[:, i].ravel(), (x * (a[:, lo + i] * share)[:, None]).ravel(), len(p))
        top = b[:, : lat.wide].max(1)
        behind = behind + np.log(top)
        ahead = b[:, : lat.wide] / top[:, None]
    return out


def by_length(words: list[str], most: int = 1 << 15) -> Iterator[list[int]]:
    """Places of words of one length, with about `most` letters at a time."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for size, places in groups.items():
        step = min(2000, max(1, most // max(1, size)))
        for k in range(0, len(places), step):
            yield places[k : k + step]


@lean("counts")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(total)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "word", "n"])
        total.clear()
        return out

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            for t, n in Counter(text.as_py().lower().split()).items():
                for w in WORDS.findall(t):
                    total[lang, w] += n
        if len(total) > KEPT:
            yield flush()
    yield flush()


def fit(rows: DataFrame, path: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities from rows (doc_id, text, lang) without null texts and languages. No rows: no languages.

    Of a language with more than `sample` rows about `sample` teach, dealt by the hash of doc_id: those of the least hash at least.
    """
    spark = rows.sparkSession
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    most = [(r["lang"], max(math.ceil(sample / r["n"] * (1 << 20)) - 1, r["least"])) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(slot).alias("least")).collect() if r["n"] > sample]
    if most:
        most = F.broadcast(spark.createDataFrame(most, "lang string, __most long"))
        rows = rows.join(most, "lang", "left").where(F.col("__most").isNull() | (slot <= F.col("__most")))
    words = materialize(rows.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    size = Lattice(path).size
    p = np.full((len(langs), size), 1.0 / size)
    p[:, 0] = 0
    at = {x: k for k, x in enumerate(langs)}
    for _ in range(ROUNDS if langs else 0):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lat = held(f"lattice {path}", lambda: Lattice(path))
            got = np.zeros((len(at), size))
            for b in batches:
                lang, word = (b.column(c).to_pylist() for c in ("lang", "word"))
                n = b.column("n").to_numpy()
                for x in langs:
                    own = [k for k, y in enumerate(lang) if y == x]
                    for part in by_length([word[k] for k in own]):
                        part = [own[k] for k in part]
                        got[at[x]] += expected(lat, lat.codes([word[k] for k in part]), shared.value[at[x]], n[part])
            lang, piece = np.nonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(got[lang, piece])], names=["l", "p", "x"])

        sums = words.mapInArrow(expect, "l long, p long, x double").groupBy("l", "p").agg(F.sum("x").alias("x")).toPandas()
        got = np.full(p.shape, LEAST)
        got[sums["l"].to_numpy(), sums["p"].to_numpy()] += sums["x"].to_numpy()
        p = np.maximum(got / got.sum(1, keepdims=True), FLOOR)
        p[:, 0] = 0
    return langs, p


class Scores:
    """Log-probabilities of white-space tokens by language, and how many of a token's runs have a letter; starts anew beyond KEPT tokens."""

    def __init__(self, path: str, p: np.ndarray):
        self.lat, self.p, self.at = Lattice(path), np.ascontiguousarray(p.T), {}
        self.table = np.zeros((1 << 14, len(p) + 1))

    def add(self, tokens: list[str]) -> None:
        first = len(self.at)
        while first + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(tokens)] = 0
        self.at.update(zip(tokens, range(first, first + len(tokens))))
        words, row = [], []
        for k, t in enumerate(tokens, first):
            for w in (t,) if t.isalpha() else WORDS.findall(t):
                words.append(w)
                row.append(k)
        for part in by_length(words):
            got = log_sums(self.lat, self.lat.codes([words[k] for k in part]), self.p)
            letters = np.array([words[k].isalpha() or any(map(str.isalpha, words[k])) for k in part], float)
            np.add.at(self.table, [row[k] for k in part], np.column_stack([got, letters]))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """A row for each list of tokens, with their sums: a log-probability for each language, then the runs that have a letter."""
        distinct = set().union(*texts)
        new = distinct.difference(self.at)
        if new and len(self.at) > KEPT:
            self.at.clear()
            new = distinct
        self.add(list(new))
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(texts)), np.int64)
        out, sizes = np.zeros((len(texts), self.table.shape[1])), np.array(list(map(len, texts)))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.table[ids], (np.cumsum(sizes) - sizes)[some])
        return out

    def score(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The row of totals() of each text. Texts with more than AT_ONCE letters are read in parts."""
        at, size = 0, 0
        for k, x in enumerate([*texts, " " * (AT_ONCE + 1)]):
            if size + len(x) <= AT_ONCE:
                size += len(x)
                continue
            if k > at:
                yield from self.totals([y.split() for y in texts[at:k]])
            at, size = k, len(x)
            if len(x) > AT_ONCE and k < len(texts):
                tokens = x.split()
                yield sum(self.totals([tokens[i : i + (1 << 16)]])[0] for i in range(0, len(tokens), 1 << 16)) + np.zeros(self.table.shape[1])
                at, size = k + 1, 0


def identify(docs: DataFrame, train: DataFrame, sample: int = SAMPLE, path: str | None = None, prefix: str = "") -> DataFrame:
    """docs (doc_id, text, ...) with lang_pred and score, learned from train (doc_id, text, lang); all columns of docs stay.

    Of each language about `sample` rows of train teach. lang_pred is a language of train, `und` for null texts and texts without a letter (score 0), and if nothing could be
    learned. score is the language's posterior under equal priors, 0 to 1. Ties go to the first language by name. Rows of
    train with a null text or language are not used; repeated rows count as often as they stand. Columns of docs named
    lang_pred or score are replaced, unless the new names get a prefix.
    """
    ship(docs.sparkSession)
    path = path or vocabulary()
    langs, p = fit(train.where("text is not null and lang is not null"), path, sample)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    model = f"language {uuid.uuid4().hex}"
    new = [prefix + "lang_pred", prefix + "score"]
    names = [c for c in docs.columns if c not in new]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(model, lambda: Scores(path, shared.value))
        for b in batches:
            pred, score = [], []
            for total in known.score([(x or "").lower() for x in b.column("text").to_pylist()]):
                if not total[-1] or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                best = int(total[:-1].argmax())
                pred.append(langs[best])
                score.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, *new])
        trim()

    rows = docs.select(*names)
    return rows.mapInArrow(predict, StructType(list(rows.schema.fields)).add(new[0], StringType()).add(new[1], DoubleType()))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_segmentation_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
