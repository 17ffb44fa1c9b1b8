"""Tables kept by key: deduplication, latest rows, upserts, change detection, cool-downs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.operators.islands import quiet_cut


def new_rows(batch: DataFrame, history: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row of each key of the batch that history lacks. A second run with the same batch adds nothing."""
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(history.select(*key), key, "left_anti")


def upsert(history: DataFrame, batch: DataFrame, key: list[str], at: str, rules: dict[str, str]) -> DataFrame:
    """One row per key of both. rules by column: last (newest not-null), filled (newest not empty), first, max, min, sum.

    Columns are folded in one aggregation that combines map-side; ties in `at` are broken by value."""
    both = history.unionByName(batch)

    def fold(c: str, how: str) -> Column:
        if how in ("max", "min", "sum"):
            return getattr(F, how)(c)
        v = F.nullif(F.col(c), F.lit("")) if how == "filled" else F.col(c)
        by = F.when(v.isNotNull(), F.struct(F.col(at), v))
        return F.min_by(v, by) if how == "first" else F.max_by(v, by)

    return both.groupBy(*key).agg(*[fold(c, how).alias(c) for c, how in rules.items()])


def updated(d: DataFrame, guard: Column, sets: dict[str, Column]) -> DataFrame:
    """d with the columns of `sets` written where the guard holds; all of them see the values from before."""
    hit = F.coalesce(guard, F.lit(False))
    return d.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in sets.items()})


def changes(d: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds changed (differs from the key's row before; the first counts) and repeats (rows since then, from 1)."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = d.withColumn("changed", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))
    d = d.withColumn("_island", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("repeats", F.row_number().over(Window.partitionBy(*key, "_island").orderBy(*order))).drop("_island")


def fingerprint(d: DataFrame, key: list[str], parts: list[str]) -> DataFrame:
    """A digest of the key's rows, normalised, independent of their order; repeated rows count.

    Each row's SHA-256 is cut into four numbers of 60 bits, these are summed over the key, and the count and the sums
    are hashed again: sums combine map-side, so no task holds the rows of a key."""
    line = F.concat_ws("|", *[F.lower(F.trim(F.coalesce(F.col(p).cast("string"), F.lit("")))) for p in parts])
    hashed = d.select(*key, F.sha2(line, 256).alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return hashed.groupBy(*key).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("fingerprint"), F.count("*").alias("n"))


def cluster_alerts(candidates: DataFrame, key: str, hours: float = 1.0, min_trades: int = 3, min_wallets: int = 2, min_usd: float = 1_000, cooldown_hours: float = 1.0, sample: int = 5) -> DataFrame:
    """Hard alerts of a sliding window per key: enough trades, wallets and money, then a cool-down; with the window's oldest
    `sample` rows as wallet=notional.

    Which row fires depends on earlier firings, so rows are walked in order, but a key is cut where it is quiet for longer than
    the window and the cool-down: nothing is kept over such a gap, and its stretches are walked side by side. A walk holds a
    window of anomalous trades, batch after batch, not a stretch."""
    schema = "key string, at timestamp, trades int, wallets int, total double, sample array<string>"

    def walk(_key, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque
        from itertools import islice

        window, quiet_until, span, rest = deque(), None, pd.Timedelta(hours=hours), pd.Timedelta(hours=cooldown_hours)
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                window.append((r.at, r.wallet, r.notional))
                while window and window[0][0] < r.at - span:
                    window.popleft()
                if quiet_until is not None and r.at < quiet_until:
                    continue
                wallets = {w for _, w, _ in window if w}
                total = sum(x for _, _, x in window)
                if len(window) >= min_trades and len(wallets) >= min_wallets and total >= min_usd:
                    out.append((r.key, r.at, len(window), len(wallets), total, [f"{w}={x:.2f}" for _, w, x in islice(window, sample)]))
                    quiet_until = r.at + rest
            if out:
                yield pd.DataFrame(out, columns=["key", "at", "trades", "wallets", "total", "sample"])

    return _walked(candidates, key, walk, schema, ["wallet", "notional"], max(hours, cooldown_hours))


def concentration_gate(alerts: DataFrame, event: str = "event_id", wallet: str = "trader_id", wallet_hours: float = 6, event_hours: float = 24, event_count: int = 3, factor: float = 2.0) -> DataFrame:
    """Adds passes to info alerts by accepted history: a wallet needs factor x its largest of wallet_hours, an
    event with event_count alerts factor x its largest of event_hours. Others pass and count. Events are cut where they are quiet for
    longer than both."""
    schema = "key string, dedup_key string, passes boolean"

    def walk(_key, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        we, ev = pd.Timedelta(hours=wallet_hours), pd.Timedelta(hours=event_hours)
        kept: deque = deque()  # (time, wallet) of accepted alerts that a wallet's window may hold
        counted: deque = deque()  # times of those that the event's window holds
        largest: deque = deque()  # the event's, falling: the first is the largest of its window
        of: dict[str, deque] = {}  # the same for each wallet with accepted alerts in its window

        def add(peaks: deque, at, x) -> None:
            while peaks and peaks[-1][1] <= x:
                peaks.pop()
            peaks.append((at, x))

        def drop(peaks: deque, before) -> None:
            while peaks and peaks[0][0] < before:
                peaks.popleft()

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                while kept and kept[0][0] < r.at - we:
                    w = kept.popleft()[1]
                    if w in of:
                        drop(of[w], r.at - we)
                        if not of[w]:
                            del of[w]
                while counted and counted[0] < r.at - ev:
                    counted.popleft()
                drop(largest, r.at - ev)
                ok = True
                if r.severity == "info":
                    mine = of.get(r.wallet)
                    ok = not (mine and r.notional < factor * mine[0][1]) and not (len(counted) >= event_count and largest and r.notional < factor * largest[0][1])
                if ok:
                    counted.append(r.at)
                    if not pd.isna(r.notional):
                        add(largest, r.at, r.notional)
                        if r.wallet is not None:
                            kept.append((r.at, r.wallet))
                            add(of.setdefault(r.wallet, deque()), r.at, r.notional)
                out.append((r.key, r.dedup_key, ok))
            yield pd.DataFrame(out, columns=["key", "dedup_key", "passes"])

    d = alerts.withColumn("wallet", F.col(wallet).cast("string")).withColumnRenamed("sent_at", "at")
    return _walked(d, event, walk, schema, ["wallet", "notional", "severity", "dedup_key"], max(wallet_hours, event_hours))


def _walked(d: DataFrame, key: str, walk, schema: str, columns: list[str], quiet_hours: float) -> DataFrame:
    """Rows of a stretch of a key in time order, through an iterator of Arrow batches: a stretch is never held whole. A key is cut
    after every pause longer than quiet_hours."""
    src = d.select(F.col(key).cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), *columns)
    src = quiet_cut(src, "key", "at", f"{int(quiet_hours * 3_600)} SECONDS")
    # The stretch a row is walked in, by key and first time; null keys are a key.
    part = F.concat(F.coalesce(F.concat(F.lit("k"), F.col("key")), F.lit("n")), F.lit("|"), F.unix_micros("_island.at").cast("string"))
    dealt = src.withColumn("part", part).drop("_island").repartition("part").sortWithinPartitions("part", "at", *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Splits the sorted stream where the stretch changes; `walk` pulls the rows of one stretch at a time."""
        state = {"rest": None, "it": iter(batches)}

        def pull():
            while state["rest"] is None or not len(state["rest"]):
                state["rest"] = next(state["it"], None)
                if state["rest"] is None:
                    return None
            return state["rest"]

        def rows_of(k):
            while (b := pull()) is not None:
                n = int((b["part"] == k).to_numpy().cumprod().sum())
                if not n:
                    return
                state["rest"] = b.iloc[n:]
                yield b.iloc[:n]

        while (b := pull()) is not None:
            yield from walk(b["part"].iloc[0], rows_of(b["part"].iloc[0]))

    return dealt.mapInPandas(run, schema)


def backoff(attempt: Column, base_s: float = 5.0, cap_s: float = 3600.0) -> Column:
    return F.least(F.lit(cap_s), F.pow(F.lit(2.0), attempt) * base_s)
