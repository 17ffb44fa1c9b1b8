"""A feed that is read page by page, newest first, as a data source for batches and streams."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

#: What the feed allows. Fixed values.
PAGE, MOST_PAGE, MOST_PAGES, MOST_OFFSET = 100, 500, 50, 3_000
SCHEMA = "market string, id long, at_us long, notional double, incomplete boolean"


#: Tasks that a batch is read by at most, where folders are a market's own.
TASKS = 256


def publish(rows: DataFrame, root: str, market: str, order: list[Column], at: str, notional: str, part: str = "0", shelves: int | None = None) -> None:
    """Lays rows out as the feed serves them: a folder a market, a file of its rows. id is a row's place in `order` within its
    market, so `order` should leave no ties. For tests, replays and back-fills from a table.

    With `shelves` (at most 9,999) a folder holds all markets of one remainder of their CRC-32, so that files do not
    grow in number with the markets. A feed is laid out in one way, with one number of shelves."""
    d = rows.withColumn("_m", F.col(market).cast("string"))
    keys, folder = ["_m"], "market"
    if shelves:
        keys, folder = ["shelf", "_m"], "shelf"
        d = d.withColumn("shelf", F.format_string("%04d-of-%04d", F.coalesce(F.crc32(F.col("_m").cast("binary")), F.lit(0)) % shelves, F.lit(shelves))).repartition("shelf")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    d = d.select(*keys[:-1], F.col("_m").alias("market"), number.alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(notional).cast("double").alias("notional")).withColumn("part", F.lit(part))
    if not shelves:
        d = d.repartition("market")
    d = d.sortWithinPartitions(folder, "part", *(["market"] if shelves else []), F.desc("at_us"), F.desc("id"))
    d.write.mode("append").partitionBy(folder, "part").parquet(root)


Page = list[tuple[int, int, float]]


class Pages:
    """Pages of a market's rows (id, at_us, notional), newest first."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    def page(self, offset: int, limit: int) -> Page:
        rows = self.rows.slice(offset, limit)
        return list(zip(*(rows[c].to_pylist() for c in ("id", "at_us", "notional")), strict=True))


@dataclass(frozen=True)
class Feed:
    """The upstream side: markets and their pages."""

    root: str

    def _folder(self):
        return pyarrow.fs.FileSystem.from_uri(self.root) if "://" in self.root else (pyarrow.fs.LocalFileSystem(), self.root)

    def _named(self, kind: str) -> list[str]:
        files, path = self._folder()
        return sorted(x.base_name for x in files.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if x.base_name.startswith(f"{kind}="))

    def _read(self, folder: str, columns: list[str], only=None) -> pa.Table:
        files, path = self._folder()
        return ds.dataset(f"{path}/{folder}", filesystem=files, format="parquet", exclude_invalid_files=True).to_table(columns=columns, filter=only)

    def shelves(self) -> list[str]:
        """The folders of a feed with several markets in one; none where each market has its own."""
        return self._named("shelf")

    @staticmethod
    def shelf(market: str, shelves: list[str]) -> str:
        n = int(shelves[0].rpartition("-")[2])
        return f"shelf={zlib.crc32(market.encode()) % n:04d}-of-{n:04d}"

    def markets(self) -> list[str]:
        shelves = self.shelves()
        if not shelves:
            return [x.removeprefix("market=") for x in self._named("market")]
        return sorted({m for s in shelves for m in pc.unique(self._read(s, ["market"])["market"]).to_pylist()})

    def pages(self, market: str) -> Pages:
        """A market's pages, read once for all of them."""
        shelves = self.shelves()
        rows = self._read(self.shelf(market, shelves), ["id", "at_us", "notional"], ds.field("market") == market) if shelves else self._read(f"market={market}", ["id", "at_us", "notional"])
        return Pages(rows.sort_by([("at_us", "descending"), ("id", "descending")]))

    def on(self, shelf: str) -> Iterator[tuple[str, Pages]]:
        """The markets of a shelf with their pages; the shelf is read once for all of them."""
        rows = self._read(shelf, ["market", "id", "at_us", "notional"]).sort_by([("market", "ascending"), ("at_us", "descending"), ("id", "descending")])
        runs = pc.run_end_encode(rows["market"].combine_chunks())
        rows, start = rows.combine_chunks(), 0
        for market, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            yield market, Pages(rows.slice(start, end - start))
            start = end


@dataclass(frozen=True)
class Limits:
    page: int = PAGE
    pages: int = MOST_PAGES
    offset: int = MOST_OFFSET

    @classmethod
    def of(cls, options: dict) -> Limits:
        page = int(options.get("pageSize", PAGE))
        return cls(max(1, min(page, MOST_PAGE)), max(1, int(options.get("maxPages", MOST_PAGES))), int(options.get("maxOffset", MOST_OFFSET)))


def walk(pages: Pages, since: int | None, limits: Limits) -> tuple[Page, bool]:
    """A market's rows at or after `since` (microseconds), newest first, and whether a limit of pages or offset ended the walk
    before it came to an older row or to the end."""
    out: Page = []
    for k in range(limits.pages):
        if k * limits.page > limits.offset:
            return out, True
        rows = pages.page(k * limits.page, limits.page)
        fresh = [r for r in rows if since is None or r[1] >= since]
        out += fresh
        if len(rows) < limits.page or len(fresh) < len(rows):
            return out, False
    return out, True


class _Market(InputPartition):
    def __init__(self, market: str, start: list | None = None, end: list | None = None):
        self.market, self.start, self.end = market, start, end


class _Markets(InputPartition):
    """Markets by name, or all of a shelf."""

    def __init__(self, markets: list[str], shelf: str | None = None):
        self.markets, self.shelf = markets, shelf


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.feed, self.limits = Feed(options["path"]), Limits.of(options)
        self.since = int(options["sinceMicros"]) if "sinceMicros" in options else None
        self.only: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        shelves = self.feed.shelves()
        if shelves and self.only is None:
            return [_Markets([], x) for x in shelves]
        if shelves:
            markets = sorted(m for m in self.only if m is not None and self.feed.shelf(m, shelves) in shelves)
        else:
            markets = [m for m in self.feed.markets() if self.only is None or m in self.only]
        return [_Markets(markets[i::TASKS]) for i in range(min(TASKS, len(markets)))]

    def read(self, partition: _Markets | None) -> Iterator[tuple]:
        if partition is None:  # a feed without markets
            return
        for market, pages in self.feed.on(partition.shelf) if partition.shelf else ((m, self.feed.pages(m)) for m in partition.markets):
            rows, incomplete = walk(pages, self.since, self.limits)
            for i, at, notional in rows:
                yield market, i, at, notional, incomplete


class _Filtered(_Batch):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Markets that are asked for are the only ones walked; a lower bound of the time ends a walk. Both are checked again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("market",):
                self.only = {f.value} & (self.only if self.only is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("market",):
                self.only = set(f.value) & (self.only if self.only is not None else set(f.value))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("at_us",):
                self.since = f.value if self.since is None else max(self.since, f.value)
            yield f


class _Stream(DataSourceStreamReader):
    """Offsets: for each market its newest time and the ids seen at that time, so that rows of one time that come later are not
    skipped and none comes twice."""

    def __init__(self, options: dict):
        self.feed, self.limits = Feed(options["path"]), Limits.of(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for m in self.feed.markets():
            newest, ids, k, pages = None, [], 0, self.feed.pages(m)
            while True:
                rows = pages.page(k * self.limits.page, self.limits.page)
                newest = rows[0][1] if rows and newest is None else newest
                ids += [r[0] for r in rows if r[1] == newest]
                k += 1
                if len(rows) < self.limits.page or rows[-1][1] != newest or k * self.limits.page > self.limits.offset:
                    break
            if newest is not None:
                out[m] = json.dumps([newest, sorted(ids)])
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Market(m, json.loads(start[m]) if m in start else None, json.loads(end[m])) for m in sorted(end) if start.get(m) != end[m]]

    def read(self, partition: _Market) -> Iterator[tuple]:
        start, (last, at_last) = partition.start, partition.end
        rows, incomplete = walk(self.feed.pages(partition.market), start[0] if start else None, self.limits)
        seen, known = set(start[1]) if start else set(), set(at_last)
        for i, at, notional in reversed(rows):
            if at > last or at == last and i not in known or start and at == start[0] and i in seen:
                continue
            yield partition.market, i, at, notional, incomplete

    def commit(self, end: dict) -> None:
        pass


class PagedTrades(DataSource):
    """Options: path of the feed; pageSize (100, at most 500), maxPages (50), maxOffset (3,000); for batches sinceMicros.

    A task reads several markets: a shelf's, or every 256th. incomplete says that a limit of pages or offset cut its walk, so that older rows are missing."""

    @classmethod
    def name(cls) -> str:
        return "paged_trades"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Filtered(self.options) if self.options.get("pushdown") == "true" else _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def paged(spark: SparkSession, path: str, **options) -> DataFrame:
    """The feed at path as a batch. Filters reach it where the session lets Python sources have them."""
    spark.dataSource.register(PagedTrades)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("paged_trades").options(**options, pushdown=pushdown).load(path)


def paged_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PagedTrades)
    return spark.readStream.format("paged_trades").options(**options).load(path)
