"""Tuning sheets: eligibility by day, freshness, feature histograms, load, clusters, coverage of staged inputs, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions import rounding
from tradeflow.operators.selection import percentiles
from tradeflow.plans.flow import beside
from tradeflow.plans.named import query
from tradeflow.sources.scratch import kept
from tradeflow.sources.trades import ALERTS_SQL, DECISIONS_SQL, MARKETS_SQL

SINCE = "2001-06-01 00:00:00"


def _since():
    return F.to_timestamp_ntz(F.lit(SINCE))


@query("SELECT strategy, date_trunc('day', created_at)::TIMESTAMP AS day, bool_or(coalesce(clv_6h > 0 AND level <> 'info', false)) AS eligible, count(*) AS n, count(clv_6h) AS measured FROM decisions GROUP BY ALL", DECISIONS_SQL)
def eligibility_timeline(t):
    good = F.coalesce((F.col("clv_6h") > 0) & (F.col("level") != "info"), F.lit(False))
    return t.decisions.groupBy("strategy", F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")).agg(F.bool_or(good).alias("eligible"), F.count("*").alias("n"), F.count("clv_6h").alias("measured"))


#: Counts and newest times of thirteen tables, as parts of three: (name, condition).
PARTS = {
    "trades": [("trades", "true"), ("large_trades", "notional >= 100000")],
    "alerts": [("alerts", "true"), ("hot_alerts", "kind = 'hot_trade'"), ("critical_alerts", "severity = 'critical'"), ("resolved_alerts", "outcome_status <> 'unresolved'")],
    "decisions": [("decisions", "true"), ("linked", "linked_key IS NOT NULL"), ("standalone", "linked_key IS NULL"), ("measured_15m", "clv_15m IS NOT NULL"), ("measured_1h", "clv_1h IS NOT NULL"), ("measured_6h", "clv_6h IS NOT NULL"), ("measured_24h", "clv_24h IS NOT NULL")],
}
TIMES = {"trades": "traded_at", "alerts": "sent_at", "decisions": "created_at"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS source, count(*) AS n, max({TIMES[table]}) AS newest FROM {table} WHERE {where}" for table, parts in PARTS.items() for name, where in parts), DECISIONS_SQL)
def table_freshness(t):
    """Thirteen counts and newest times out of one pass over each of three tables."""
    out = None
    for table, parts in PARTS.items():
        d, at = getattr(t, table), TIMES[table]
        one = d.agg(*[x for name, where in parts for x in (F.count_if(F.expr(where)).alias(f"{name}_n"), F.max(F.when(F.expr(where), F.col(at))).alias(f"{name}_at"))])
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("source"), F.col(f"{name}_n").alias("n"), F.col(f"{name}_at").alias("newest")) for name, _ in parts])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Buckets by feature: values times this, rounded, over this.
SCALES = {"odds": 2.0, "notional": 0.0001, "lifecycle": 0.1, "price": 20.0, "profit_k": 0.1, "market_no": 0.2, "clv_15m": 1.0, "clv_1h": 1.0}
FEATURES_SQL = """, features AS (SELECT strategy, clv_6h, odds, notional, lifecycle, price, notional * (odds - 1) / 1000 AS profit_k, market_id::DOUBLE AS market_no, clv_15m, clv_1h FROM decisions)"""


@query(" UNION ALL ".join(f"SELECT strategy, '{f}' AS feature, floor({f} * {k} + 0.5) / {k} + 0.0 AS bucket, count(*) AS n, round(avg(clv_6h), 6) + 0.0 AS mean_6h FROM features WHERE {f} IS NOT NULL GROUP BY 1, 3" for f, k in SCALES.items()), DECISIONS_SQL + FEATURES_SQL)
def feature_histograms(t):
    """Eight features out of the JSON that decisions keep, each in buckets of its own width, in one pass."""
    d = t.decisions.withColumns({"profit_k": F.col("notional") * (F.col("odds") - 1) / 1_000, "market_no": F.col("market_id").cast("double")})
    d = d.select("strategy", "clv_6h", F.to_json(F.struct(*SCALES)).alias("features"))
    values = F.from_json("features", ", ".join(f"{f} double" for f in SCALES))
    d = d.withColumn("_f", values).withColumn("_x", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.floor(F.col(f"_f.{f}") * k + 0.5) / k + 0.0).alias("bucket")) for f, k in SCALES.items()])))
    d = d.where("_x.bucket IS NOT NULL").groupBy("strategy", F.col("_x.feature").alias("feature"), F.col("_x.bucket").alias("bucket"))
    return d.agg(F.count("*").alias("n"), (rounding.rounded(F.avg("clv_6h"), 6) + 0.0).alias("mean_6h"))


@query("""SELECT event_type, hours, rows_an_hour, most_an_hour, users, most_users_an_hour, minutes, CAST(floor((epoch((SELECT max(ts) FROM events)) - epoch(newest)) / 60) AS BIGINT) AS idle_minutes FROM (SELECT event_type, count(*) AS hours, round(avg(n), 6) AS rows_an_hour, max(n) AS most_an_hour, max(u) AS most_users_an_hour, sum(m)::BIGINT AS minutes, max(newest) AS newest
  FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n, count(DISTINCT user_id) AS u, count(DISTINCT date_trunc('minute', ts)) AS m, max(ts) AS newest FROM events GROUP BY ALL) GROUP BY event_type) JOIN (SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type) USING (event_type)""")
def hourly_load(t):
    """Volume and distinct users by hour, active minutes and staleness of each kind of event.

    Distinct users and minutes of an hour are counted among (kind, hour), never over a kind's whole life in one task."""
    e = t.table("events")
    hours = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"), F.count_distinct(F.date_trunc("minute", "ts")).alias("m"), F.max("ts").alias("newest"))
    d = hours.groupBy("event_type").agg(F.count("*").alias("hours"), rounding.rounded(F.avg("n"), 6).alias("rows_an_hour"), F.max("n").alias("most_an_hour"), F.max("u").alias("most_users_an_hour"), F.sum("m").alias("minutes"), F.max("newest").alias("newest"))
    users = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("users"))
    now = e.agg(F.max("ts").alias("now"))
    d = beside(d.join(users, "event_type"), now)
    idle = F.floor(F.timestamp_diff("SECOND", "newest", "now") / 60)
    return d.select("event_type", "hours", "rows_an_hour", "most_an_hour", "users", "most_users_an_hour", "minutes", idle.alias("idle_minutes"))


@query("""SELECT category_id, count(*) AS clusters, round(quantile_cont(usd, 0.5), 4) AS usd_p50, round(quantile_cont(usd, 0.9), 4) AS usd_p90, round(quantile_cont(usd, 0.99), 4) AS usd_p99, quantile_cont(n, 0.5) AS trades_p50, quantile_cont(n, 0.9) AS trades_p90
  FROM (SELECT category_id, sent_at, count(*)::DOUBLE AS n, sum(notional) AS usd FROM alerts GROUP BY ALL) GROUP BY category_id""", ALERTS_SQL)
def cluster_percentiles(t):
    """Sizes of clusters, taken out of the nested JSON that an alert carries, by category."""
    c = t.alerts.groupBy("category_id", "sent_at").agg(F.count("*").alias("trades"), F.sum("notional").alias("total"))
    payload = c.select("category_id", F.to_json(F.struct(F.struct(F.col("trades").alias("anomalous_trades"), F.col("total").alias("total_usd")).alias("cluster"))).alias("payload"))
    got = kept(payload.select("category_id", F.get_json_object("payload", "$.cluster.total_usd").cast("double").alias("usd"), F.get_json_object("payload", "$.cluster.anomalous_trades").cast("double").alias("n")))
    usd = percentiles(got, ["category_id"], "usd", (0.5, 0.9, 0.99)).select("category_id", F.col("n").alias("clusters"), *[rounding.rounded(F.col("q")[i], 4).alias(c) for i, c in enumerate(("usd_p50", "usd_p90", "usd_p99"))])
    return usd.join(percentiles(got, ["category_id"], "n", (0.5, 0.9)).select("category_id", F.col("q")[0].alias("trades_p50"), F.col("q")[1].alias("trades_p90")), "category_id")


STAGED_SQL = f""", recent AS (SELECT * FROM alerts WHERE sent_at >= TIMESTAMP '{SINCE}'),
  edges AS (SELECT DISTINCT a.trader_id AS wallet_a, b.trader_id AS wallet_b FROM recent a JOIN recent b ON a.market_id = b.market_id AND a.outcome = b.outcome AND a.side = b.side AND a.sent_at = b.sent_at AND a.trader_id < b.trader_id)"""


@query("""SELECT count(*) AS recent_alerts, count(*) FILTER (event_id % 2 = 0) AS with_catalysts, count(*) FILTER (market_id IN (SELECT market_id FROM (SELECT market_id, min(market_id) OVER (PARTITION BY event_id) AS src FROM markets) WHERE market_id <> src)) AS with_links,
  count(*) FILTER (market_id IN (SELECT market_id FROM alerts WHERE outcome_status <> 'unresolved')) AS with_outcomes, (SELECT count(DISTINCT r.dedup_key) FROM recent r JOIN edges e ON e.wallet_a = r.trader_id OR e.wallet_b = r.trader_id) AS with_wallet_edges FROM recent""", ALERTS_SQL + STAGED_SQL)
def staged_coverage(t):
    """How many recent alerts each kind of staged input covers. A wallet on either side of an edge covers: the two sides are one
    list of wallets and one semi-join, not a join by OR."""
    r = kept(t.alerts.where(F.col("sent_at") >= _since()))
    m = t.markets.select("market_id", "event_id")
    firsts = m.groupBy("event_id").agg(F.min("market_id").alias("market_id"))
    later = m.join(firsts, ["event_id", "market_id"], "left_anti").select(F.col("market_id").alias("_m"))
    settled = t.alerts.where("outcome_status <> 'unresolved'").select(F.col("market_id").alias("_s")).distinct()
    # Wallets with an edge: two or more wallets in one place and time.
    places = r.select("market_id", "outcome", "side", "sent_at", "trader_id").distinct()
    shared = places.groupBy("market_id", "outcome", "side", "sent_at").agg(F.count("*").alias("wallets")).where("wallets > 1")
    wallets = places.join(shared, ["market_id", "outcome", "side", "sent_at"], "left_semi").select(F.col("trader_id").alias("_w")).distinct()
    d = r.join(later, F.col("market_id") == F.col("_m"), "left").join(settled, F.col("market_id") == F.col("_s"), "left").join(wallets, F.col("trader_id") == F.col("_w"), "left")
    return d.agg(F.count("*").alias("recent_alerts"), F.count_if(F.col("event_id") % 2 == 0).alias("with_catalysts"), F.count("_m").alias("with_links"), F.count("_s").alias("with_outcomes"), F.count("_w").alias("with_wallet_edges"))


@query("""SELECT t.order_id, t.line_no, t.market_id, round(t.notional, 2) AS notional, round(100.0 * (epoch(TIMESTAMP '2001-11-05') - epoch(m.start_at)) / (epoch(m.end_at) - epoch(m.start_at)), 6) AS lifecycle FROM trades t JOIN markets m USING (market_id) WHERE t.traded_at >= TIMESTAMP '2001-06-01' AND t.price > 0 AND t.price < 1
  AND m.start_at <= TIMESTAMP '1996-01-01' AND market_id IN (SELECT market_id FROM (SELECT market_id, category_id AS c FROM markets UNION ALL SELECT market_id, market_id % 5 FROM markets) WHERE c IN (1, 3))""", MARKETS_SQL)
def candidate_trades(t):
    """Trades of markets in any of the wanted categories, each once, though a market is in several: the m:n table is met by a
    semi-join, so no row is made twice and none has to be taken away again."""
    m = kept(t.markets)
    categories = m.select("market_id", F.col("category_id").cast("long").alias("c")).unionByName(m.select("market_id", (F.col("market_id") % 5).cast("long").alias("c")))
    old = m.where(F.col("start_at") <= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))).select("market_id", "start_at", "end_at")
    d = t.trades.where((F.col("traded_at") >= _since()) & (F.col("price") > 0) & (F.col("price") < 1)).join(categories.where("c IN (1, 3)"), "market_id", "left_semi").join(old, "market_id")
    now = F.to_timestamp_ntz(F.lit("2001-11-05 00:00:00"))
    life = 100.0 * F.timestamp_diff("SECOND", "start_at", now) / F.timestamp_diff("SECOND", "start_at", "end_at")
    return d.select("order_id", "line_no", "market_id", rounding.rounded("notional", 2).alias("notional"), rounding.rounded(life, 6).alias("lifecycle"))
