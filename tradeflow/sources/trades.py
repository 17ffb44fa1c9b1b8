"""The trade domain over the driver's tables, as DataFrames and as the same SQL.

A supplier is a market, its nation the event and its region the category; line status is the
outcome token, returns are sales, a customer is a wallet. Times keep the tables' type.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.functions import compact
from tradeflow.functions.bands import lifecycle_pct
from tradeflow.operators.asof import asof
from tradeflow.operators.scoring import Thresholds, may_fire, score
from tradeflow.sources.scratch import kept

#: The moment queries take as now; no query reads a clock.
NOW = "2001-11-05 00:00:00"

TRADES_SQL = """trades AS (
  SELECT l.l_suppkey AS market_id, s.s_nationkey AS event_id, n.n_regionkey AS category_id, l.l_linestatus AS outcome,
         CASE WHEN l.l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, o.o_custkey AS trader_id,
         0.05 + 9 * l.l_discount AS price, l.l_extendedprice AS notional, l.l_extendedprice / (0.05 + 9 * l.l_discount) AS shares,
         l.l_shipdate AS traded_at, l.l_orderkey AS order_id, l.l_linenumber AS line_no
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

MARKETS_SQL = TRADES_SQL + """, markets AS (
  SELECT market_id, event_id, category_id, min(traded_at) AS start_at, max(traded_at) + INTERVAL 30 DAY AS end_at, count(*) AS n_trades
  FROM trades GROUP BY market_id, event_id, category_id)"""

ALERTS_SQL = MARKETS_SQL + """, base AS (
  SELECT market_id, outcome, count(*) AS m_count, sum(notional) AS m_total, quantile_cont(notional, 0.95) AS m_p95, quantile_cont(notional, 0.99) AS m_p99
  FROM trades GROUP BY market_id, outcome), tbase AS (
  SELECT trader_id, count(*) AS t_count, quantile_cont(notional, 0.95) AS t_p95, quantile_cont(notional, 0.99) AS t_p99 FROM trades GROUP BY trader_id), tiers AS (
  SELECT t.*, 1 / price AS odds, notional * (1 / price - 1) AS profit,
         100 * (epoch(t.traded_at) - epoch(m.start_at)) / (epoch(m.end_at) - epoch(m.start_at)) AS lifecycle, b.m_count, b.m_total, b.m_p95, b.m_p99, w.t_count, w.t_p95, w.t_p99,
         (m_count >= 20 AND m_total >= 1000 AND m_p95 > 0) AS m_ready, (t_count >= 20 AND t_p95 > 0) AS t_ready
  FROM trades t JOIN base b USING (market_id, outcome) JOIN tbase w USING (trader_id) JOIN markets m USING (market_id)), verdicts AS (
  SELECT *, CASE
      WHEN notional >= 100000 AND odds >= 8 AND profit >= 50000 AND (NOT m_ready OR notional / m_p95 >= 1.0) AND (NOT t_ready OR notional / t_p95 >= 0.8) THEN 'critical'
      WHEN notional >= 25000 AND odds >= 5 AND profit >= 15000 AND (NOT m_ready OR notional / m_p95 >= 0.8) AND (NOT t_ready OR notional / t_p95 >= 0.5) THEN 'warning'
      WHEN notional >= 10000 AND odds >= 3 AND profit >= 5000 AND (NOT m_ready OR notional / m_p95 >= 0.5) AND (NOT t_ready OR notional / t_p95 >= 0.3) THEN 'info' END AS raw_severity
  FROM tiers), scored AS (
  SELECT *, CASE WHEN NOT m_ready AND raw_severity IN ('critical', 'warning') AND NOT (notional >= 100000 AND odds >= 8) THEN 'info' ELSE raw_severity END AS severity
  FROM verdicts), alerts AS (
  SELECT concat_ws('|', 'trade', market_id, outcome, trader_id, order_id, line_no, strftime(traded_at, '%Y-%m-%d')) AS dedup_key, market_id, event_id, category_id, outcome, side, trader_id,
         min(price) AS price, max(notional) AS notional, max(odds) AS odds, max(lifecycle) AS lifecycle, min(severity) AS severity, traded_at AS sent_at,
         CASE WHEN max(lifecycle) >= 90 THEN 'hot_trade' ELSE 'trade' END AS kind,
         CASE WHEN market_id % 3 = 2 THEN 'unresolved' WHEN ((outcome = 'O') = (market_id % 3 = 0)) = (side = 'BUY') THEN 'correct' ELSE 'wrong' END AS outcome_status
  FROM scored WHERE severity IS NOT NULL
  GROUP BY market_id, event_id, category_id, outcome, side, trader_id, order_id, line_no, traded_at)"""

PRICES_SQL = """, daily AS (SELECT market_id, outcome, traded_at AS at, avg(price) AS price FROM trades GROUP BY market_id, outcome, traded_at)"""

#: The reference's windows of 15 minutes to 24 hours, as days: trades here have day granularity.
HORIZONS = {"ret_15m": 1, "ret_1h": 3, "ret_6h": 7, "ret_24h": 14}


def _returns_sql() -> str:
    out, prev = "", "alerts"
    for c, days in HORIZONS.items():
        out += f""", w_{c} AS (
  SELECT a.*, CASE WHEN a.side = 'SELL' THEN -1 ELSE 1 END * (p.price - a.price) / a.price AS {c}, (p.price - a.price) * 100 * CASE WHEN a.side = 'SELL' THEN -1 ELSE 1 END AS {c.replace("ret", "clv")}
  FROM {prev} a ASOF LEFT JOIN daily p ON a.market_id = p.market_id AND a.outcome = p.outcome AND a.sent_at + INTERVAL {days} DAY <= p.at)"""
        prev = f"w_{c}"
    return out + f", measured AS (SELECT * FROM {prev})"


MEASURED_SQL = ALERTS_SQL + PRICES_SQL + _returns_sql()

DECISIONS_SQL = MEASURED_SQL + """, decisions AS (
  SELECT *, CASE trader_id % 4 WHEN 0 THEN 'thesis' WHEN 1 THEN 'cohort' WHEN 2 THEN 'cheap_tail' ELSE 'catalyst' END AS strategy, 'v1' AS version,
         CASE WHEN market_id % 2 = 0 THEN dedup_key END AS linked_key, severity AS level, sent_at AS created_at,
         concat_ws('|', category_id, CASE WHEN lifecycle < 75 THEN 'early' ELSE 'late' END) AS control_bucket
  FROM measured)"""


def line() -> dict[str, Column]:
    """What a trade takes from its line, before it has met its order."""
    return {
        "outcome": F.col("l_linestatus"), "side": F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY"), "price": F.lit(0.05) + F.lit(9) * F.col("l_discount"),
        "notional": F.col("l_extendedprice"), "traded_at": F.col("l_shipdate"), "order_id": F.col("l_orderkey"), "line_no": F.col("l_linenumber")}


class Domain:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _placed(self, lines: DataFrame, market: str) -> DataFrame:
        """lines with s_nationkey and n_regionkey. They meet the two tables one by one: of what a join of both would give, Spark assumes the
        product of their sizes, and at 60 x sf0.1 it sent all lines to their suppliers rather than broadcast that."""
        s, n = self.table("supplier").select("s_suppkey", "s_nationkey"), self.table("nation").select("n_nationkey", "n_regionkey")
        return lines.join(s, F.col(market) == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))

    def narrow(self, **columns: Column) -> DataFrame:
        """market_id, trader_id, order_id and columns of all trades, worked out of lineitem before it is sent to its orders."""
        li = self.table("lineitem").select(F.col("l_orderkey"), F.col("l_suppkey").alias("market_id"), *[c.alias(n) for n, c in columns.items()])
        o = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("trader_id"))
        j = self._placed(li, "market_id").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return j.select("market_id", "trader_id", F.col("l_orderkey").alias("order_id"), *columns)

    @cached_property
    def parts(self) -> dict[str, compact.Part]:
        """What of a trade fits into a long, worked out of lineitem."""
        at = self.table("lineitem").schema["l_shipdate"].dataType
        return {
            "notional": compact.hundredths(F.col("l_extendedprice"), 27), "price": compact.hundredths(F.col("l_discount"), 7, lambda x: F.lit(0.05) + F.lit(9) * x),
            "traded_at": compact.day(F.col("l_shipdate"), at), "line_no": compact.number(F.col("l_linenumber"), 6, "int"),
            "sell": compact.flag(F.coalesce(F.col("l_returnflag") == "R", F.lit(False)))}

    @cached_property
    def trades(self) -> DataFrame:
        li, o = self.table("lineitem"), self.table("orders")
        price = F.lit(0.05) + F.lit(9) * F.col("l_discount")
        j = self._placed(li, "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return j.select(
            F.col("l_suppkey").alias("market_id"), F.col("s_nationkey").alias("event_id"), F.col("n_regionkey").alias("category_id"), F.col("l_linestatus").alias("outcome"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("o_custkey").alias("trader_id"), price.alias("price"),
            F.col("l_extendedprice").alias("notional"), (F.col("l_extendedprice") / price).alias("shares"), F.col("l_shipdate").alias("traded_at"),
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"))

    @cached_property
    def stored(self) -> DataFrame:
        """trades, written once: for what reads them more than once."""
        d = kept(self.trades.drop("shares"))
        return d.withColumn("shares", F.col("notional") / F.col("price")).select(*self.trades.columns)

    @cached_property
    def markets(self) -> DataFrame:
        return self.__dict__.get("stored", self.trades).groupBy("market_id", "event_id", "category_id").agg(
            F.min("traded_at").alias("start_at"), (F.max("traded_at") + F.expr("INTERVAL 30 DAYS")).alias("end_at"), F.count("*").alias("n_trades"))

    @cached_property
    def scored(self) -> DataFrame:
        return self._judged(self.stored)

    def _judged(self, rows: DataFrame) -> DataFrame:
        """rows, some of the trades, scored by the baselines of all trades."""
        t = self.stored
        # Values go to their key as they are: a buffer a trade, as partial percentiles make them of small keys, is several times as large.
        by = t.select("market_id", "outcome", "notional").repartition("market_id", "outcome")
        base = by.groupBy("market_id", "outcome").agg(F.count("*").alias("m_count"), F.sum("notional").alias("m_total"), F.percentile("notional", F.array(F.lit(0.95), F.lit(0.99))).alias("_m"))
        base = base.select("market_id", "outcome", "m_count", "m_total", F.col("_m")[0].alias("m_p95"), F.col("_m")[1].alias("m_p99"))
        tb = t.select("trader_id", "notional").repartition("trader_id").groupBy("trader_id").agg(F.count("*").alias("t_count"), F.percentile("notional", F.array(F.lit(0.95), F.lit(0.99))).alias("_t"))
        tb = tb.select("trader_id", "t_count", F.col("_t")[0].alias("t_p95"), F.col("_t")[1].alias("t_p99"))
        # Markets meet the baselines, a row each, so that trades are sent for both at once; wallets come last, as alerts are grouped by theirs.
        base = base.join(self.markets.select("market_id", "start_at", "end_at"), "market_id")
        j = rows.join(base, ["market_id", "outcome"]).join(tb, "trader_id")
        return score(j.withColumn("lifecycle", lifecycle_pct("traded_at", "start_at", "end_at", clamp=False)), Thresholds.for_driver())

    @cached_property
    def alerts(self) -> DataFrame:
        """Trades that fired, few beside all trades; written once, as most queries on them read them more than once."""
        return kept(self.fired)

    @cached_property
    def fired(self) -> DataFrame:
        """alerts as they are worked out, for what reads them once. Only trades that may fire meet the baselines."""
        known = F.array(*[F.lit(x) for x in ("critical", "info", "warning")])  # in order, so that the least is found by its place
        a = self._judged(self.stored.where(may_fire(Thresholds.for_driver()))).where("severity is not null").groupBy("market_id", "event_id", "category_id", "outcome", "side", "trader_id", "order_id", "line_no", "traded_at").agg(
            F.min("price").alias("price"), F.max("notional").alias("notional"), F.max("odds").alias("odds"), F.max("lifecycle").alias("lifecycle"), F.min(F.array_position(known, F.col("severity"))).alias("_s"))
        key = F.concat_ws("|", F.lit("trade"), *[F.col(c).cast("string") for c in ("market_id", "outcome", "trader_id", "order_id", "line_no")], F.date_format("traded_at", "yyyy-MM-dd"))
        kind = F.when(F.col("lifecycle") >= 90, "hot_trade").otherwise("trade")
        return a.select(key.alias("dedup_key"), "market_id", "event_id", "category_id", "outcome", "side", "trader_id", "price", "notional", "odds", "lifecycle", F.get(known, (F.col("_s") - 1).cast("int")).alias("severity"),
                        F.col("traded_at").alias("sent_at"), kind.alias("kind"), self.status().alias("outcome_status"))

    @staticmethod
    def status() -> Column:
        """Two thirds of the markets are resolved, by their number; a sale is right when its outcome loses."""
        m = F.col("market_id") % 3
        won = (F.col("outcome") == "O") == (m == 0)
        return F.when(m == 2, "unresolved").when(won == (F.col("side") == "BUY"), "correct").otherwise("wrong")

    @cached_property
    def daily(self) -> DataFrame:
        return self.__dict__.get("stored", self.trades).groupBy("market_id", "outcome", F.col("traded_at").alias("at")).agg(F.avg("price").alias("price"))

    @cached_property
    def measured(self) -> DataFrame:
        """Alerts with forward returns (relative) and moves (cents) at each horizon; written once."""
        return kept(self.returns(*HORIZONS))

    def returns(self, *names: str) -> DataFrame:
        """measured with the named horizons alone and not written, for what reads it once."""
        from tradeflow.operators.outcomes import forward_returns

        return forward_returns(self.alerts, kept(self.daily), ["market_id", "outcome"], "sent_at", "at", {n: HORIZONS[n] for n in names}, unique=True)

    @cached_property
    def decisions(self) -> DataFrame:
        return self.decided(self.measured)

    @cached_property
    def unmeasured(self) -> DataFrame:
        """decisions without their returns, for what asks for none: a row each all the same."""
        return self.decided(self.__dict__.get("alerts", self.fired))

    @cached_property
    def once(self) -> DataFrame:
        """decisions, not written, for what reads them once."""
        return self.decided(self.returns(*HORIZONS))

    @staticmethod
    def decided(measured: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in ("thesis", "cohort", "cheap_tail", "catalyst")])
        return measured.withColumns({
            "strategy": F.get(names, (F.col("trader_id") % 4).cast("int")), "version": F.lit("v1"), "linked_key": F.when(F.col("market_id") % 2 == 0, F.col("dedup_key")),
            "level": F.col("severity"), "created_at": F.col("sent_at"),
            "control_bucket": F.concat_ws("|", F.col("category_id").cast("string"), F.when(F.col("lifecycle") < 75, "early").otherwise("late"))})


__all__ = ["Domain", "NOW", "HORIZONS", "TRADES_SQL", "MARKETS_SQL", "ALERTS_SQL", "PRICES_SQL", "MEASURED_SQL", "DECISIONS_SQL", "asof"]
