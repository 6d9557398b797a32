"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models over a 32-letter alphabet, one of accepted and one of rejected URLs, are learned from the URLs
that a rule decides. A context of up to three letters backs off to shorter ones by Witten-Bell interpolation, so a context
that was never seen leaves the word to the next shorter one. A URL's score is the difference of the two log-likelihoods
divided by its length. The threshold is the one that parts the ruled URLs best (balanced accuracy), each scored by models of
the FOLDS - 1 folds that it isn't in.

The counts and the threshold cover every ruled URL; a model has 32**4 cells at most, so what reaches the driver and the broadcast is bounded
by the alphabet, not by the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwise.llm.common import lean, ship

#: (verdict, host, path). Fixed values of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
ORDER, BITS = 3, 5
CELLS = 1 << BITS * (ORDER + 1)
#: Bins of the calibration histogram over scores from -SPAN to SPAN.
BINS, SPAN = 4096, 8.0
#: Parts of the ruled URLs, by hash.
FOLDS = 5


def _alphabet() -> np.ndarray:
    """0 pads; 1-26 letters without case, 27 digits, 28 '/', 29 '.', 30 other ASCII, 31 other bytes."""
    out = np.full(256, 31, np.int64)
    out[:128] = 30
    for k in range(26):
        out[65 + k] = out[97 + k] = 1 + k
    out[48:58] = 27
    out[47], out[46] = 28, 29
    return out


ALPHABET = _alphabet()


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://' or without a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path together) and verdict of the longest rule that fits, else null."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(h + p))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(kind))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def codes(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the (ORDER + 1)-grams at every byte of all URLs (what follows '://', else all), and the lengths in bytes."""
    raw = [(u or "").partition("://")[2] or (u or "") for u in urls]
    raw = [x.encode("utf-8", "replace") for x in raw]
    pad = b"\0" * ORDER
    a = np.frombuffer(pad + b"".join(x + pad for x in raw), np.uint8)
    s = np.where(a == 0, 0, ALPHABET[a])
    grams = np.zeros(len(s) - ORDER, np.int64)
    for k in range(ORDER + 1):
        grams = grams << BITS | s[k : len(s) - ORDER + k]
    n = np.array([len(x) for x in raw], np.int64)
    at = np.concatenate([[0], np.cumsum(n + ORDER)])[:-1]
    own = np.repeat(at - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    return grams[own], n


def log_probs(count: np.ndarray) -> np.ndarray:
    """log P(letter | up to ORDER letters before it) for every gram, Witten-Bell interpolated down to the uniform."""
    a = 1 << BITS
    p = np.full(a, 1.0 / a)
    for k in range(ORDER + 1):
        c = count.reshape(-1, a ** (k + 1)).sum(0).reshape(-1, a)
        n, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        low = np.tile(p.reshape(-1, a), (a, 1)) if k else p.reshape(1, a)
        low = low[: len(c)]
        p = np.where(n > 0, (c + kinds * low) / np.maximum(n + kinds, 1), low)
    return np.log(p).reshape(-1)


@lean("urls")
def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {}
    for b in batches:
        kind, fold = np.array(b.column("verdict").to_pylist(), object), b.column("fold").to_numpy()
        urls = np.array(b.column("url").to_pylist(), object)
        for v in ("allow", "block"):
            for k in range(FOLDS):
                own = urls[(kind == v) & (fold == k)].tolist()
                if own:
                    got = codes(own)[0]
                    total[v, k] = total.get((v, k), 0) + np.bincount(got, minlength=CELLS)
    for (v, k), c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([v == "block"] * len(at), pa.bool_()), pa.array(np.full(len(at), k, np.int8)), pa.array(at), pa.array(c[at])], names=["block", "fold", "code", "n"])


def score(urls: list[str | None], table: np.ndarray) -> np.ndarray:
    grams, n = codes(urls)
    total = np.concatenate([[0.0], np.cumsum(table[grams])])
    end = np.cumsum(n)
    return (total[end] - total[end - n]) / np.maximum(n, 1)


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Log-ratio table and threshold from rows (url, verdict), verdict not null. Without URLs of either kind all is allowed."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("byte"))
    counts = rows.mapInArrow(_counter, "block boolean, fold byte, code long, n long").groupBy("block", "fold", "code").agg(F.sum("n").alias("n")).toPandas()
    by = np.zeros((2, FOLDS, CELLS))
    by[counts["block"].to_numpy(np.int64), counts["fold"].to_numpy(np.int64), counts["code"].to_numpy()] = counts["n"].to_numpy()
    allow, block = by.sum(1)
    if not (allow.any() and block.any()):
        return np.zeros(CELLS), -1.0
    table = log_probs(allow) - log_probs(block)
    # a fold whose others lack a kind can't be scored by them
    others = [(allow - by[0, k], block - by[1, k]) for k in range(FOLDS)]
    tables = {k: log_probs(x) - log_probs(y) for k, (x, y) in enumerate(others) if x.any() and y.any()}
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    @lean("urls")
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, urls = b.column("fold").to_numpy(), np.array(b.column("url").to_pylist(), object)
            for k, own in shared.value.items():
                at = np.flatnonzero(fold == k)
                x = score(urls[at].tolist(), own)
                bins = np.clip((x + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("verdict").take(pa.array(at)), pa.array(bins)], names=["verdict", "bin"])

    bins = rows.mapInArrow(scored, "verdict string, bin long").groupBy("verdict", "bin").count().toPandas()
    got = {v: np.zeros(BINS) for v in ("allow", "block")}
    for v, part in bins.groupby("verdict"):
        got[v][part["bin"].to_numpy()] = part["count"].to_numpy()
    if not all(c.sum() for c in got.values()):
        return table, 0.0
    below = {v: np.concatenate([[0], np.cumsum(c)]) / c.sum() for v, c in got.items()}
    gain = below["block"] - below["allow"]
    best = np.flatnonzero(gain == gain.max())
    return table, float(best[len(best) // 2] * (2 * SPAN / BINS) - SPAN)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score, threshold), one for each row of pages; other columns are not read.

    Null and empty URLs, and those without '://', have an empty host and path and are judged by the models as they are (score
    0 if empty). Repeated rows are judged alike. Ties with the threshold are allowed.
    """
    ship(pages.sparkSession)
    host, path = host_path(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    table, limit = fit(rows.where(F.col("verdict").isNotNull()).select("url", "verdict"))
    shared = pages.sparkSession.sparkContext.broadcast(table)

    @lean("urls")
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = score(b.column("url").to_pylist(), shared.value)
            kind = [v or ("allow" if s >= limit else "block") for v, s in zip(b.column("verdict").to_pylist(), x)]
            cols = [b.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kind, pa.string()), pa.array(x), pa.array(np.full(len(x), limit))], names=["page_id", "host", "path", "rule", "verdict", "score", "threshold"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string, score double, threshold double")


def op2_char_lm_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL by the contract's rules and the models learned from the URLs they decide."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
