r"""Benchmark decontamination by a generalised suffix automaton of the benchmark's items.

Items and documents are words: A-Z lower-cased, maximal runs of bytes other than \x00-\x2F, \x3A-\x60 and \x7B-\x7F. The automaton
holds every run of words of every item. A document is streamed through it word by word; its state is the longest run of
words up to here that some item has. Where that is WINDOW words or more, the last WINDOW words stand in the items of the
state that holds them, and an item of fewer words is found as a suffix of the state's run.

An automaton is built over a block of BLOCK item words (long items are cut with an overlap of WINDOW - 1 words), so it is
bounded, as is what is broadcast. With more items than one block holds, a worker holds one automaton at a time and passes it
over some texts before it takes the next; after MANY blocks the rows are written with what was found, and read again.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tarnwise.llm.common import held, lean, materialize, ship

WINDOW, BLOCK = 10, 200_000
#: Blocks whose automata are sent out at once, and bytes of text that a worker holds while they pass over it one after another.
MANY, HOLD = 16, 8 << 20
#: Words of the shortest item that clean() cuts out of longer texts; fewer words say nothing by themselves.
SHORT = 3
#: All but words to spaces, A-Z to a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton over (item, words, whole): whole says that the words are the item, not a part of it."""

    def __init__(self, items: list[tuple[str, list[bytes], bool]], window: int = WINDOW):
        self.window, self.ids, self.next, self.link, self.len = window, {}, [{}], [-1], [0]
        ends = []
        for name, words, whole in items:
            v = 0
            for w in words:
                v = self._extend(v, self.ids.setdefault(w, len(self.ids)))
            ends.append(v)
        at: list[set[str]] = [set() for _ in self.len]
        short: list[dict[int, set[str]]] = [{} for _ in self.len]
        for (name, words, whole), end in zip(items, ends):
            if whole and 0 < len(words) < window:
                while self.len[self.link[end]] >= len(words):
                    end = self.link[end]
                short[end].setdefault(len(words), set()).add(name)
                continue
            v = 0
            for w in words:
                v = u = self.next[v][self.ids[w]]
                while u > 0 and self.len[u] >= window and name not in at[u]:
                    at[u].add(name)
                    u = self.link[u]
        self.items = [tuple(sorted(x)) for x in at]
        self.short: list[tuple] = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            own = tuple((n, tuple(sorted(x))) for n, x in sorted(short[v].items()))
            self.short[v] = self.short[self.link[v]] + own
        self.least = min([window] + [len(w) for _, w, whole in items if whole and w])

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's longest run and c, parted from q, which has longer runs too."""
        clone = self._new(self.len[p] + 1, q)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has this run already
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, end), in order and apart, and the items found."""
        ids = list(map(self.ids.get, words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        nxt, link, length, short, window = self.next, self.link, self.len, self.short, self.window

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        v = n = 0
        for i, c in enumerate(ids):
            if c is None:
                v = n = 0
                continue
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                found.update(self.items[u])
                hit(i + 1 - window, i + 1)
            if short[v]:
                for k, names in short[v]:
                    if k <= n:
                        found.update(names)
                        hit(i + 1 - k, i + 1)
        return spans, found


def blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, list[bytes], bool]]]:
    """The items in blocks of about `most` words; only one block is on the driver at a time."""
    block, size = [], 0
    for name, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        words = split(text)
        for at in range(0, max(1, len(words) - window + 1), most):
            part = words[at : at + most + window - 1]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((name, part, len(part) == len(words)))
            size += len(part)
    if block:
        yield block


def merge(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of spans, each flat: start, end, start, end."""
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _pass(rows: DataFrame, packed: list, named: list[str], first: bool, finish: Callable, schema: StructType) -> DataFrame:
    """rows through the automata of one list of blocks. packed: broadcasts of pickled automata, of which a worker holds one at a time.

    Texts are held HOLD bytes at a time, and each automaton passes over them. named: the columns of counts, spans and items;
    finish(batch, counts, spans, items) makes what is sent on.
    """
    mine = [f"automaton {uuid.uuid4().hex}" for _ in packed]

    @lean(mine[0])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [[([], set()) if first else (x, set(y)) for x, y in (zip([()] * b.num_rows, [()] * b.num_rows) if first else zip(b.column(named[1]).to_pylist(), b.column(named[2]).to_pylist()))] for b in some]
            counts = [[0] * b.num_rows for b in some]
            for key, blob in zip(mine, packed):
                automaton = held(key, lambda blob=blob: pickle.loads(blob.value))
                for i, b in enumerate(some):
                    for k, text in enumerate(b.column("text")):
                        words = split(text.as_py())
                        counts[i][k] = len(words)
                        got, names = automaton.match(words)
                        if got:
                            old, seen = found[i][k]
                            flat = [x for span in got for x in span]
                            found[i][k] = (merge(old, flat) if old else flat, seen | names)
            for b, n, got in zip(some, counts, found):
                yield finish(b, n, [x for x, _ in got], [sorted(y) for _, y in got])

        some, size = [], 0
        for b in batches:
            some.append(b)
            size += b.column("text").nbytes
            if size >= HOLD or len(packed) == 1:
                yield from work(some)
                some, size = [], 0
        if some:
            yield from work(some)

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int, most: int, named: list[str], finish: Callable, schema: StructType) -> DataFrame:
    """docs through all blocks of the benchmark, MANY blocks in a pass. Between passes the rows are written to the shared folder, with what was found so far."""
    spark = docs.sparkSession
    ship(spark)
    keep, rows, packed, first = docs.columns, docs, [], True
    between = StructType(list(docs.schema.fields)).add(named[0], LongType()).add(named[1], ArrayType(LongType())).add(named[2], ArrayType(StringType()))

    def add(b: pa.RecordBatch, counts: list, spans: list, items: list) -> pa.RecordBatch:
        cols = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *named])

    for block in list_or_one(blocks(benchmark, window, most)):
        if len(packed) == MANY:
            rows, packed, first = materialize(_pass(rows, packed, named, first, add, between)), [], False
        packed.append(spark.sparkContext.broadcast(pickle.dumps(Automaton(block, window), pickle.HIGHEST_PROTOCOL)))
    return _pass(rows, packed, named, first, finish or add, schema or between)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK, prefix: str = "") -> DataFrame:
    """docs (text, ...) with n_words long, spans array<long> (flat pairs of word numbers, end exclusive) and items array<string> (sorted).

    Null texts have no words. Items without words are never found; items with equal texts are found together. An item_id that
    repeats counts once; a null one is the empty string. Repeated rows and empty tables are as any other. Columns of docs
    named n_words, spans or items are replaced, unless the new names get a prefix.
    """
    named = [prefix + c for c in ("n_words", "spans", "items")]
    return scan(docs.drop(*named), benchmark, window, most, named, None, None)


def list_or_one(found: Iterator[list]) -> Iterator[list]:
    """At least one block, so that an empty benchmark gives the columns as well."""
    any_ = False
    for x in found:
        any_ = True
        yield x
    if not any_:
        yield []


def clean(docs: DataFrame, benchmark: DataFrame, longest: int = WINDOW, coverage: float = 0.8, window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """docs without the hit spans of at least `longest` words in their texts, and without documents of which more than `coverage` of the words are hit.

    Spans of fewer than `window` words are whole items; those of SHORT words and more are cut, too. Items of fewer words stay
    inside longer texts, but count for `coverage`. A span goes from its first word to the start of the word after it. Texts without such spans stay as they are, null ones too.
    """
    keep = docs.columns

    def cut(b: pa.RecordBatch, counts: list, found: list, items: list) -> pa.RecordBatch:
        texts, stay = [], []
        for text, n, flat in zip(b.column("text"), counts, found):
            hit = sum(flat[1::2]) - sum(flat[::2])
            stay.append(not n or hit <= coverage * n)
            spans = [(s, e) for s, e in zip(flat[::2], flat[1::2]) if e - s >= min(longest, n) or SHORT <= e - s < window]
            texts.append(without(text.as_py(), spans) if spans and stay[-1] else text.as_py())
        cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in keep]
        return pa.RecordBatch.from_arrays(cols, names=keep).filter(pa.array(stay, pa.bool_()))

    return scan(docs, benchmark, window, most, ["__n_words", "__spans", "__items"], cut, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    starts = [m.start() for m in _WORD.finditer(raw.translate(WORDS))] + [len(raw)]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = starts[e]
    return b"".join([*out, raw[at:]]).decode()


def op10_suffix_automaton_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hits of all benchmark items in all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
