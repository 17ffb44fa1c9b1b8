"""Work-queue rows out of a market feed: trades, status changes, and price moves behind two chained cool-downs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Queue priorities by reason.
PRIORITY = {"market_status": 1, "price_move": 2, "trade_seen": 3, "book_change": 4}
OUT = "market string, at timestamp, reason string, priority int, mid double, before double, change double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows a worker walks before what they give leaves it, and buckets that markets share; a stream's number of buckets stays as it began.
PIECE = 50_000
BUCKETS = 512
_NOTHING = (None,) * (4 + len(PRIORITY))
_ROW = pa.schema([("market", pa.string()), ("at_us", pa.int64()), ("id", pa.int64()), ("kind", pa.string()), ("mid", pa.float64())])
_LIVE = pa.schema([("market", pa.string()), ("mid", pa.float64()), ("seen", pa.int64()), ("repriced", pa.int64()), ("refreshed", pa.int64()), *[(reason, pa.int64()) for reason in sorted(PRIORITY, key=PRIORITY.get)]])


def _packed(t: pa.Table) -> bytes:
    """t as an Arrow stream, as which the state holds it."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _unpacked(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _table(live: dict) -> pa.Table:
    columns = zip(*((m, *k) for m, k in live.items()), strict=True) if live else ((),) * len(_LIVE)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _LIVE, strict=True)], schema=_LIVE)


def _known(b: bytes) -> dict:
    """What _step knows of each market."""
    markets, *known = (c.to_pylist() for c in _unpacked(b).columns)
    return dict(zip(markets, zip(*known, strict=True), strict=True))


def _queued(out: list) -> pd.DataFrame:
    market, at, reason, priority, *numbers = zip(*out, strict=True)
    d = pd.DataFrame({"market": market, "at": pd.to_datetime(np.array(at, dtype="int64"), unit="us", utc=True), "reason": reason, "priority": np.array(priority, dtype="int32")})
    return d.assign(**{c: np.array(x, dtype="float64") for c, x in zip(("mid", "before", "change"), numbers, strict=True)})


@dataclass(frozen=True)
class Rules:
    """least: relative move of the mid that counts; reprice_s and refresh_s: the cool-downs of price_move and of book_change, which
    is looked at only when price_move fires; idle_s: silence of a market after which what is known of it is forgotten;
    from_zero: a mid above nothing after one of nothing is a move without bounds, else none."""

    least: float = 0.03
    reprice_s: float = 60.0
    refresh_s: float = 300.0
    idle_s: float = 86_400.0
    from_zero: bool = False


class _Market:
    """What one market's rows, in order of time, put into the queue."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def _step(self, market: str, at: int, kind: str, mid: float | None, known: tuple | None, out: list) -> tuple:
        """What is known of the market after a row: its mid, the row's time, when it was repriced and refreshed, and the last minute of each reason."""
        if known is None or at - known[1] >= self.rules.idle_s * 1e6:
            known = _NOTHING
        before, _, repriced, refreshed, *last = known

        def enqueue(reason: str, m: float | None = None, change: float | None = None) -> None:
            """One row for a market, reason and minute."""
            i, minute = PRIORITY[reason] - 1, at // 60_000_000
            if last[i] != minute:
                last[i] = minute
                out.append((market, at, reason, i + 1, m, before if m is not None else None, change))

        if kind == "trade":
            enqueue("trade_seen")
        elif kind == "status":
            enqueue("market_status")
        elif mid is not None and mid > 0:
            usable = before is not None and (before > 0 or before == 0 and self.rules.from_zero)
            change = 0.0 if not usable else abs(mid - before) / before if before else math.inf
            if usable and change >= self.rules.least and not (repriced is not None and at - repriced < self.rules.reprice_s * 1e6):
                enqueue("price_move", mid, change)
                repriced = at
                if not (refreshed is not None and at - refreshed < self.rules.refresh_s * 1e6):
                    enqueue("book_change", mid, change)
                    refreshed = at
        if kind == "book" and mid is not None:
            before = mid
        return (before, at, repriced, refreshed, *last)


class _Markets(StatefulProcessor):
    """A bucket of markets: rows wait until the watermark has passed them and are then taken in order of market and time.

    A call of a worker and what it asks of the state store cost milliseconds whatever they carry, so they are made for a bucket and not for
    a market, and state is kept in pieces: of rows that wait, one for each Arrow batch that came, and one of all that is known of the markets."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "wake long, markets binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    @staticmethod
    def _due(at: int) -> int:
        """The first millisecond of the watermark that has passed a time in microseconds."""
        return -(-at // 1_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(b[list(_ROW.names)], schema=_ROW, preserve_index=False) for b in rows]
        yield from self._walk(self._held(), new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.live.exists() and self.live.get()[0] <= now:  # else the rows that came with the watermark have taken those due with them
            yield from self._walk(self._held(), [], now)

    def _held(self) -> list[pa.Table]:
        return [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []

    def _walk(self, held: list[pa.Table], new: list[pa.Table], now: int) -> Iterator[pd.DataFrame]:
        """Takes the rows that are due, keeps the others and has itself woken for the first of them, or to forget markets that went silent."""
        passed = [pc.less_equal(t["at_us"], now * 1_000) for t in held + new]
        due, rest = ([t.filter(p if took else pc.invert(p)) for t, p in zip(held + new, passed, strict=True)] for took in (True, False))
        rest = [t for t in rest if t.num_rows]
        live = _known(self.live.get()[1]) if self.live.exists() else {}
        yield from self._taken(pa.concat_tables(due), live)
        idle = int(self.rules.idle_s * 1e6)
        live = {m: k for m, k in live.items() if self._due(k[1] + idle) > now}
        if rest and not held and all(t.num_rows == n.num_rows for t, n in zip(rest, new, strict=False)):
            for t in rest:
                self.waiting.appendValue((_packed(t),))
        elif rest:
            self.waiting.put([(_packed(t),) for t in rest])
        else:
            self.waiting.clear()
        if not rest and not live:
            self.live.clear()
            return
        wake = self._due(min(pc.min(t["at_us"]).as_py() for t in rest)) if rest else self._due(max(k[1] for k in live.values()) + idle)
        self.live.update((wake, _packed(_table(live))))
        self.handle.registerTimer(wake)

    def _taken(self, rows: pa.Table, live: dict) -> Iterator[pd.DataFrame]:
        """Queue rows of rows that are due; live is brought up to date."""
        rows = rows.sort_by([(c, "ascending") for c in ("market", "at_us", "id", "kind", "mid")])
        market, out = _Market(self.rules), []
        for piece in rows.to_batches(PIECE):
            names, kinds = piece["market"].to_pylist(), piece["kind"].to_pylist()
            for m, at, kind, mid in zip(names, piece["at_us"].to_numpy().tolist(), kinds, piece["mid"].to_numpy(zero_copy_only=False).tolist(), strict=True):
                live[m] = market._step(m, at, kind, None if mid != mid else mid, live.get(m), out)
            if out:
                yield _queued(out)
            out.clear()

    def close(self) -> None:
        pass


def work_queue(events: DataFrame, rules: Rules, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """events (market, at, id, kind: trade, status or book, mid) to queue rows (OUT), in append mode.

    A book row is compared with the market's mid before it. Rows may come out of order by `late`; those of a time are
    taken by id. State is a market's last mid, three times and last minutes, and its rows that wait for the watermark; it is forgotten
    after idle_s of silence. Markets share `buckets` keys of the state, whose rows of a micro-batch a worker holds at once; more of them hold
    less. It needs the RocksDB state store (STORE)."""
    e = events.select(F.col("market").cast("string").alias("market"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), "kind", F.col("mid").cast("double").alias("mid"))
    e = e.where("at is not null").withColumn("at_us", F.unix_micros("at")).withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("market"), F.lit(buckets)).cast("int"))
    return e.groupBy("bucket").transformWithStateInPandas(_Markets(rules), OUT, "Append", "EventTime")
