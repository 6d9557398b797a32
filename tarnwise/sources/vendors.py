"""Price vendors as Spark data sources: paging, retries, a cache by instrument, and total-return panels made of what they give.

A vendor is a class with fetch(code, adjusted, start, end), which returns rows (dt, close) or raises Unavailable for a failure
that may pass. Vendors are registered by name; a file-backed one stands in where there is no network.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwise.operators.series import assemble, missing, rescaled


class Unavailable(Exception):
    """A request that failed and may succeed later."""


VENDORS: dict[str, Callable[[dict], object]] = {}


def vendor(name: str) -> Callable:
    def put(make: Callable[[dict], object]) -> Callable[[dict], object]:
        VENDORS[name] = make
        return make

    return put


def pages(start: dt.date, end: dt.date, days: int) -> list[tuple[dt.date, dt.date]]:
    """start to end, both included, in pages of `days` days, as vendors cap the rows of an answer."""
    out = []
    while start <= end:
        to = min(end, start + dt.timedelta(days - 1))
        out.append((start, to))
        start = to + dt.timedelta(1)
    return out


def linear(n: int) -> float:
    return 2 + 3 * n


def quadratic(n: int) -> float:
    return 2 * (n + 1) ** 2


def patient(ask: Callable[[], list], tries: int = 4, wait: Callable[[int], float] = linear, sleep: Callable[[float], None] = time.sleep) -> list:
    """ask(), again after a wait that grows if it was Unavailable or gave nothing; the last failure is raised."""
    for n in range(tries):
        try:
            if rows := ask():
                return rows
            failure: Exception = Unavailable("no rows")
        except Unavailable as e:
            failure = e
        if n + 1 < tries:
            sleep(wait(n))
    raise failure


@vendor("files")
class Files:
    """A folder with a CSV (dt,close) for every instrument: <code>.csv, or <code>.adjusted.csv."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def fetch(self, code: str, adjusted: bool, start: dt.date, end: dt.date) -> list[tuple[dt.date, float]]:
        import csv
        import os

        path = os.path.join(self.folder, f"{code}.adjusted.csv" if adjusted else f"{code}.csv")
        if not os.path.exists(path):
            raise KeyError(code)
        with open(path, newline="", encoding="utf-8") as f:
            rows = [(dt.date.fromisoformat(r["dt"]), float(r["close"])) for r in csv.DictReader(f) if r["close"]]
        return [r for r in rows if start <= r[0] <= end]


class Ask(InputPartition):
    def __init__(self, code: str, start: dt.date, end: dt.date):
        self.code, self.start, self.end = code, start, end


class Prices(DataSource):
    """format("prices"): options vendor, codes (by commas), start, end, adjusted, page (days), tries, backoff (linear or quadratic), pause (seconds), and the vendor's own.

    An instrument is a partition, its pages are asked one after another, so a vendor that blocks fast clients is asked by few.
    """

    @classmethod
    def name(cls) -> str:
        return "prices"

    def schema(self) -> str:
        return "code string, dt date, close double"

    def reader(self, schema) -> DataSourceReader:
        return PriceReader(dict(self.options))


class PriceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.start, self.end = (dt.date.fromisoformat(options.get(k, d)) for k, d in (("start", "1990-01-01"), ("end", "2099-12-31")))

    def partitions(self) -> list[InputPartition]:
        return [Ask(c.strip(), self.start, self.end) for c in self.options["codes"].split(",") if c.strip()]

    def read(self, partition: Ask) -> Iterator[tuple]:
        o = self.options
        source = VENDORS[o.get("vendor", "files")](o)
        wait = quadratic if o.get("backoff") == "quadratic" else linear
        adjusted, tries, pause = o.get("adjusted", "false") == "true", int(o.get("tries", 4)), float(o.get("pause", 0))
        end = min(partition.end, dt.date.today())
        span = int(o.get("page", 0)) or (end - partition.start).days + 1
        found: dict[dt.date, float] = {}
        parts = pages(partition.start, end, span)
        for a, b in parts:
            # a page before the listing is empty and no failure; an instrument without any row is one
            ask = lambda a=a, b=b: source.fetch(partition.code, adjusted, a, b)
            found.update(patient(ask, tries, wait) if len(parts) == 1 else _page(ask, tries, wait))
            time.sleep(pause)
        if not found:
            raise Unavailable(f"{partition.code}: no rows")
        for day in sorted(found):
            yield partition.code, day, found[day]


def _page(ask: Callable[[], list], tries: int, wait: Callable[[int], float]) -> list:
    for n in range(tries):
        try:
            return ask()
        except Unavailable:
            if n + 1 == tries:
                raise
            time.sleep(wait(n))
    return []


def fetch(spark: SparkSession, codes: Sequence[str], vendor_name: str = "files", **options: object) -> DataFrame:
    """(code, dt, close) of the codes from a vendor."""
    spark.dataSource.register(Prices)
    said = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return spark.read.format("prices").options(vendor=vendor_name, codes=",".join(codes), **said).load()


def cached(spark: SparkSession, codes: Sequence[str], folder: str, vendor_name: str = "files", adjusted: bool = False, refresh: bool = False, **options: object) -> DataFrame:
    """fetch(), kept below folder by vendor, adjustment and instrument; only instruments that aren't there are asked for, so a run that broke off goes on."""
    from pyspark.errors import AnalysisException

    at = f"{folder.rstrip('/')}/vendor={vendor_name}/adjusted={str(adjusted).lower()}"
    have: set[str] = set()
    try:
        have = {r[0] for r in spark.read.option("basePath", at).schema("dt date, close double, code string").parquet(at).select("code").distinct().collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    for code in codes:  # one instrument is one write, so what has come is kept when a later one fails
        if refresh or code not in have:
            fetch(spark, [code], vendor_name, adjusted=adjusted, **options).select("dt", "close").write.mode("overwrite").parquet(f"{at}/code={code}")
    return spark.read.option("basePath", at).schema("dt date, close double, code string").parquet(at).where(F.col("code").isin(list(codes))).select("code", "dt", "close")


def build(spark: SparkSession, sources: Sequence[tuple[DataFrame, DataFrame]], universe: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(total return, raw, missing) of several sources' (adjusted, raw) prices, the first source first; adjusted prices end on the last raw one."""
    raw = assemble([r for _, r in sources])
    adjusted = rescaled(assemble([a for a, _ in sources]), raw)
    return adjusted, raw, missing(adjusted, universe)


def prefixed(code, prefixes: dict[str, str]):
    """A vendor's own name of an instrument: its exchange, by the code's first character, before the code."""
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    return F.concat(F.element_at(known, F.substring(code, 1, 1)), code)
