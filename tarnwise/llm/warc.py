r"""WARC archives with payload deduplication, read back into a globally ordered capture index.

Writing: a page is archived as a `response` record with its HTML, or, if another page with the same payload has a smaller
page_id, as a `revisit` record that refers to that page. Payloads meet by digest without their HTML, and those of one digest
are dealt over several keys, so the hot payload of a third of all pages is no hot group. Every
task writes one archive through Spark's text sink with the record terminator \r\n\r\n as line separator, gzip over the whole
file, so any store that Spark writes to will do.

Reading: each archive is streamed line by line and parsed by Content-Length, so neither an archive nor anything but one
record is held. Every RUN records of an archive form a capture run that is sorted by URL key and timestamp. The runs' entries
go to ranges of (URL key, timestamp, page_id) - a hot URL spreads over ranges by its timestamps - and in each range the
pieces of the runs are merged by a loser tree. Range after range, the result is ordered over all. An entry's offset is its
place in the inflated archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwise.llm.common import lean, materialize, shared_dir, ship, whole_number

#: Records in one sorted capture run, and entries that a merging task takes about.
RUN, RANGE = 20_000, 100_000
#: Keys that the pages of one payload are dealt over, and revisits that are broadcast at most.
SALT, SMALL = 16, 10_000
#: Payloads below this many bytes are always responses.
LEAST = 0
#: Capture time of page 0 where pages have no timestamp of their own, in seconds; page n is taken n seconds later.
EPOCH = 1_700_000_000
END = "\r\n\r\n"


def payload_key(html: Column) -> Column:
    """SHA-1 of the payload in UTF-8, as 40 hex digits."""
    return F.sha1(F.coalesce(html, F.lit("")).cast("binary"))


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Distinct rows (page_id, digest, first) of the pages (page_id, html) that revisit another: the smallest page_id with the same payload is less than their own.

    No HTML is shuffled, and the pages of a hot payload are dealt over SALT keys.
    """
    rows = pages.select("page_id", payload_key(F.col("html")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    first = rows.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    dealt = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    own = rows.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int").alias("salt"))
    return own.join(dealt, ["digest", "salt"]).where("first < page_id").select("page_id", "digest", "first").distinct()


def mark(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html, ts) with digest and refers_to: the smallest page_id with the same payload, null for that page itself.

    Up to SMALL revisits are broadcast, so that pages stay where they are; more are joined by page, which no payload makes hot.
    """
    found = materialize(revisits(pages, least))
    found = found.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to"))
    rows = pages.withColumn("digest", payload_key(F.col("html")))
    found = F.broadcast(found) if found.count() <= SMALL else found
    return rows.join(found, (F.col("page_id") == F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").drop("__page", "__digest")


def record(page_id: Column, url: Column, html: Column, ts: Column, digest: Column, refers_to: Column) -> Column:
    r"""One WARC/1.1 record without the \r\n\r\n that ends it."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    block = F.when(refers_to.isNull(), F.coalesce(html, F.lit(""))).otherwise("")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")
    http = F.concat(http, F.octet_length(F.coalesce(html, F.lit(""))).cast("string"), F.lit(END))
    body = F.concat(http, block)
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(refers_to.isNull(), F.lit("response")).otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", stamp), line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(refers_to.isNotNull(), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string, eight letters for every ten digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(4):
        part = F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.substring(letters, F.shiftright(part, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*out)


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives all pages (page_id, url, html, and ts, a timestamp; else EPOCH + page_id seconds) below path."""
    whole_number(pages, "page_id")
    ts = F.col("ts") if "ts" in pages.columns else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)))
    rows = mark(pages.select("page_id", "url", "html", ts.alias("ts")), least)
    cols = [F.col(c) for c in ("page_id", "url", "html", "ts")]
    rows.select(record(*cols, base32(F.col("digest")), F.col("refers_to")).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").rstrip(">")
    return int(text) if text else None


def url_key(url: str) -> str:
    """Host labels reversed and joined by commas, then ')' and the rest of the URL in lower case."""
    scheme, found, rest = url.partition("://")
    rest = rest if found else scheme
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().removeprefix("www.").split("."))) + ")" + rest[cut:].lower()


class Reader:
    """Takes an archive's lines one by one; records() holds those that are complete."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.need = self.offset = self.start = 0
        self.found: list[tuple[dict[str, str], bytes, int]] = []

    def line(self, raw: bytes) -> None:
        """raw: a line without its line feed."""
        if self.need:
            self.parts.append(raw)
            self.need -= len(raw) + 1
            if self.need <= 0:  # the block ends in this line, which goes on with the terminator's carriage return
                block = b"\n".join(self.parts)
                size = int(self.head["content-length"])
                if block[size:] != b"\r":
                    raise ValueError(f"record at {self.start}: the block isn't followed by its terminator")
                self.found.append((self.head, block[:size], self.start))
                self.head, self.parts, self.need = None, [], 0
        elif self.head is None:
            if raw.rstrip(b"\r"):
                if raw != b"WARC/1.1\r":
                    raise ValueError(f"no record begins at {self.offset}")
                self.head, self.start = {}, self.offset
        elif raw == b"\r":
            self.need = int(self.head["content-length"]) + 2
        else:
            name, _, value = raw.decode().rstrip("\r").partition(": ")
            self.head[name.lower()] = value
        self.offset += len(raw) + 1


_ENTRY = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]
_RUN_ENTRY = f"{_ENTRY}, run string, seq int"


def entry(head: dict[str, str], block: bytes, archive: str, at: int) -> tuple:
    """Index entry of a record. A response's size and digest come from its block; a revisit's from its headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = head["warc-type"] == "revisit"
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if not revisit:
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{archive} at {at}: the payload isn't what its headers say")
    return (url_key(head.get("warc-target-uri", "")), head["warc-date"], _page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head["warc-refers-to"]) if revisit else None, archive, at)


def _order(e: tuple) -> tuple:
    return e[0].encode(), e[1], e[2] is not None, e[2] or 0, e[7], e[8]


@lean("warc")
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, archive, run, n = Reader(), None, [], 0

    def close() -> pa.RecordBatch:
        nonlocal n
        run.sort(key=_order)
        rows = [(*e, f"{archive}#{n}", k) for k, e in enumerate(run)]
        n += 1
        run.clear()
        return to_batch(rows, _RUN_ENTRY)

    for b in batches:
        for path, raw in zip(b.column("path").to_pylist(), b.column("line").to_pylist()):
            if path != archive:
                if run:
                    yield close()
                reader, archive, n = Reader(), path, 0
            reader.line(raw)
            for head, block, at in reader.found:
                run.append(entry(head, block, archive.rpartition("/")[2], at))
            reader.found.clear()
            if len(run) >= RUN:
                yield close()
    if run:
        yield close()


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[f for f, _ in fields])


def loser_tree(runs: list[Iterator[tuple]], key) -> Iterator[tuple]:
    """All entries of sorted runs in order. tree[0] is the winner; an inner node keeps the loser of its match, so an entry costs one match a level."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    keys = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    tree = [0] * max(1, k)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        tree[node] = lose
        return win

    if k:
        tree[0] = build(1) if k > 1 else 0
    while k and keys[tree[0]] is not None:
        win = tree[0]
        yield heads[win]
        heads[win] = next(runs[win], None)
        keys[win] = None if heads[win] is None else key(heads[win])
        node = (win + k) // 2
        while node:
            if beats(tree[node], win):
                tree[node], win = win, tree[node]
            node //= 2
        tree[0] = win


def entries(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run, of which one part at a time is turned into Python objects."""
    for part in parts:
        yield from zip(*(part.column(k).to_pylist() for k in range(len(_NAMES))))


@lean("warc")
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, of about RANGE entries, kept as Arrow slices: its rows come run by run, each run in its order."""
    runs: list[list[pa.RecordBatch]] = []
    now = None
    for b in batches:
        names = b.column("run")
        at = 0
        while at < b.num_rows:
            run, to = names[at].as_py(), at + 1
            while to < b.num_rows and names[to].as_py() == run:
                to += 1
            if run != now:
                runs.append([])
                now = run
            runs[-1].append(b.slice(at, to - at))
            at = to
    out = []
    for row in loser_tree([entries(r) for r in runs], _order):
        out.append(row)
        if len(out) == 10_000:
            yield to_batch(out, _ENTRY)
            out = []
    if out:
        yield to_batch(out, _ENTRY)


def read(spark, path: str) -> DataFrame:
    """Capture index of all archives below path, in the order of (url_key, ts, page_id). Archives are read once; their sorted runs are written to the shared folder."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    runs = materialize(lines.mapInArrow(_runs, _RUN_ENTRY))
    ranges = max(spark.sparkContext.defaultParallelism, -(-runs.count() // RANGE))
    ranged = runs.repartitionByRange(ranges, "url_key", "ts", "page_id").sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(_merge, _ENTRY)


def op4_warc_index_merge(spark, sf_dir: str) -> DataFrame:
    """Archives every page in the shared folder and reads the archives back.

    Null HTML is an empty payload, a null URL an empty target. Repeated rows are records of their own; of equal page_ids
    with equal payloads each is the response. Columns but page_id, url, html and ts are not read.
    """
    path = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")
