"""Queries that keep tables by key: catalog, snapshots, predictions, caches; upserts over a history and a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.operators import flow, state
from tradeflow.plans.named import query
from tradeflow.sources.trades import ALERTS_SQL, MARKETS_SQL, NOW, TRADES_SQL


@query("SELECT user_id, max(ts) AS at, arg_max(event_type, (ts, event_type)) AS event_type, min(ts) AS first_at, max(value) AS best, count(*) AS n FROM events GROUP BY user_id")
def upsert_latest(t):
    """A history and a batch of events folded to one row a user."""
    e = t.table("events").withColumns({"at": F.col("ts"), "first_at": F.col("ts"), "best": F.col("value"), "n": F.lit(1).cast("long")})
    rules = {"at": "max", "event_type": "last", "first_at": "min", "best": "max", "n": "sum"}
    return state.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id"], "ts", rules)


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) FILTER (event_type <> 'view') AS title, max(value) AS confidence FROM events GROUP BY user_id")
def upsert_non_empty_wins(t):
    """The newest value that is not empty; confidence is the largest."""
    e = t.table("events").select("user_id", "ts", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("title"), F.col("value").alias("confidence"))
    return state.upsert(e.where("ts < '2024-01-15'"), e.where("ts >= '2024-01-15'"), ["user_id"], "ts", {"title": "filled", "confidence": "max"})


@query("SELECT user_id, arg_max(value, (ts, value)) FILTER (event_type = 'click') AS click_price, arg_max(value, (ts, value)) FILTER (event_type = 'view') AS view_price, max(ts) AS at FROM events GROUP BY user_id")
def live_state(t):
    """Last value of each kind that is not null, as a live market state is kept."""
    e = t.table("events").select("user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("click_price"), F.when(F.col("event_type") == "view", F.col("value")).alias("view_price"), F.col("ts").alias("at"))
    return state.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "ts", {"click_price": "last", "view_price": "last", "at": "max"})


@query("SELECT event_type, minute, count(*) AS n FROM (SELECT DISTINCT event_type, date_trunc('hour', ts)::TIMESTAMP AS minute, user_id % 10 AS market FROM events) GROUP BY ALL")
def work_queue(t):
    """One row for a market, reason and window, however often it was asked for."""
    d = t.table("events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("minute"), (F.col("user_id") % 10).alias("market")).distinct()
    return d.groupBy("event_type", "minute").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-30') ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id LIMIT 50")
def work_claim(t):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    d = t.table("events").where("ts >= '2024-01-29' and not (event_type = 'error' and ts < '2024-01-30')")
    return d.orderBy(rank, "ts", "event_id").limit(50).select("event_id", "user_id")


@query("SELECT r_regionkey AS category_id, CASE WHEN r_regionkey IN (SELECT category_id FROM trades WHERE traded_at >= TIMESTAMP '2001-11-01') THEN 'active' ELSE 'inactive' END AS status FROM region", TRADES_SQL)
def categories_inactive(t):
    """Categories that a sync has not seen become inactive."""
    seen = t.trades.where("traded_at >= '2001-11-01'").select("category_id").distinct().withColumn("_s", F.lit(True))
    r = t.table("region").select(F.col("r_regionkey").alias("category_id"))
    return r.join(seen, r["category_id"] == seen["category_id"], "left").select(r["category_id"], F.when(F.col("_s"), "active").otherwise("inactive").alias("status"))


@query(f"SELECT market_id, CASE WHEN market_id % 6 = 1 THEN TIMESTAMP '2001-01-01' WHEN market_id % 2 = 1 AND category_id <> 0 THEN TIMESTAMP '{NOW}' END AS deleted_at FROM markets", MARKETS_SQL)
def markets_inactive(t):
    """Markets not seen and in a synced category are soft-deleted; the first time stays."""
    m = t.markets.withColumn("deleted_at", F.when(F.col("market_id") % 6 == 1, F.lit("2001-01-01").cast("timestamp_ntz")))
    seen = m.where("market_id % 2 = 0").select("market_id")
    scope = t.table("region").where("r_regionkey <> 0").select(F.col("r_regionkey").alias("category_id"))
    gone = m.join(seen, "market_id", "left_anti").join(scope, "category_id", "left_semi").select(F.col("market_id").alias("gone"))
    now = F.to_timestamp_ntz(F.lit(NOW))
    j = m.join(gone, F.col("market_id") == F.col("gone"), "left")
    return j.select("market_id", F.coalesce("deleted_at", F.when(F.col("gone").isNotNull(), now)).alias("deleted_at"))


@query("SELECT market_id, end_at FROM markets WHERE market_id % 4 IN (0, 1) ORDER BY CASE WHEN market_id % 8 = 0 THEN NULL ELSE end_at END NULLS LAST, market_id LIMIT 30", MARKETS_SQL)
def markets_for_backfill(t):
    end = F.when(F.col("market_id") % 8 != 0, F.col("end_at"))
    return t.markets.where("market_id % 4 in (0, 1)").orderBy(end.asc_nulls_last(), "market_id").limit(30).select("market_id", "end_at")


@query("SELECT market_id, greatest(max(traded_at), TIMESTAMP '2001-10-01') AS cursor_at FROM trades GROUP BY market_id", TRADES_SQL)
def collect_cursor(t):
    """A high-water mark that never goes back."""
    return t.trades.groupBy("market_id").agg(F.greatest(F.max("traded_at"), F.lit("2001-10-01").cast("timestamp_ntz")).alias("cursor_at"))


@query("SELECT market_id, category_id FROM markets WHERE category_id <> market_id % 5", MARKETS_SQL)
def category_links(t):
    """m:n links without duplicates, less those that a keep-list lacks."""
    links = t.markets.select("market_id", "category_id")
    drop = t.markets.select("market_id", (F.col("market_id") % 5).cast("int").alias("category_id"))
    return links.unionByName(links).distinct().join(drop, ["market_id", "category_id"], "left_anti")


@query("SELECT page_id, coalesce(c.canonical, p.slug) AS slug FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS slug FROM pages) p LEFT JOIN (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS slug, regexp_replace(regexp_extract(url, '://([^/]+)', 1), '^(www|m|blog)[.]', '') AS canonical FROM pages) c USING (slug)")
def slug_aliases(t):
    slug = F.regexp_extract("url", "://([^/]+)", 1)
    p = t.table("pages").select("page_id", slug.alias("slug"))
    alias = p.select(F.col("slug").alias("original"), F.regexp_replace("slug", "^(www|m|blog)[.]", "").alias("canonical")).distinct()
    return p.join(alias, F.col("slug") == F.col("original"), "left").select("page_id", F.coalesce("canonical", "slug").alias("slug"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_snapshot(t):
    return flow.latest(t.table("events"), ["user_id"], [F.desc("ts"), "event_id"]).select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2")
def current_and_previous(t):
    from pyspark.sql import Window

    d = t.table("events").withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return flow.newest(d, ["user_id"], 2, [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value", "before")


PRED_SQL = ", predictions AS (SELECT market_id, event_id, CASE market_id % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'stale' WHEN 2 THEN 'active' WHEN 3 THEN 'weakening' WHEN 4 THEN 'confirmed' ELSE 'new' END AS state, 0.3 + (market_id % 7) / 10 AS confidence, CASE WHEN market_id % 9 <> 0 THEN end_at - INTERVAL 40 DAY END AS touched_at FROM markets)"


def _predictions(t):
    m = F.col("market_id")
    names = F.array(*[F.lit(x) for x in ("resolved", "stale", "active", "weakening", "confirmed", "new")])
    return t.markets.select("market_id", "event_id", F.get(names, (m % 6).cast("int")).alias("state"), (0.3 + (m % 7) / 10).alias("confidence"), F.when(m % 9 != 0, F.col("end_at") - F.expr("INTERVAL 40 DAYS")).alias("touched_at"))


@query("SELECT market_id, state, touched_at FROM predictions WHERE state NOT IN ('resolved', 'stale') ORDER BY CASE state WHEN 'weakening' THEN 0 WHEN 'active' THEN 1 WHEN 'new' THEN 2 ELSE 3 END, touched_at NULLS FIRST, market_id LIMIT 40", MARKETS_SQL + PRED_SQL)
def predictions_for_evolution(t):
    rank = F.when(F.col("state") == "weakening", 0).when(F.col("state") == "active", 1).when(F.col("state") == "new", 2).otherwise(3)
    return _predictions(t).where("state not in ('resolved', 'stale')").orderBy(rank, F.asc_nulls_first("touched_at"), "market_id").limit(40).select("market_id", "state", "touched_at")


@query("SELECT market_id, round(greatest(0.2, confidence - 0.15), 6) AS confidence, CASE WHEN state IN ('active', 'new') AND touched_at < TIMESTAMP '2001-09-20' THEN 'stale' ELSE state END AS state FROM predictions", MARKETS_SQL + PRED_SQL)
def prediction_decay(t):
    idle = F.col("state").isin("active", "new") & F.coalesce(F.col("touched_at") < F.lit("2001-09-20").cast("timestamp_ntz"), F.lit(False))
    return _predictions(t).select("market_id", F.round(F.greatest(F.lit(0.2), F.col("confidence") - 0.15), 6).alias("confidence"), F.when(idle, "stale").otherwise(F.col("state")).alias("state"))


@query("SELECT event_id, count(*) AS n, round(max(confidence), 6) AS best FROM predictions WHERE touched_at IS NOT NULL GROUP BY event_id", MARKETS_SQL + PRED_SQL)
def predictions_by_event(t):
    return _predictions(t).where("touched_at is not null").groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("best"))


@query("SELECT market_id, version FROM (SELECT market_id, count(DISTINCT severity) AS version FROM alerts GROUP BY market_id) UNION ALL SELECT market_id, 0 FROM markets WHERE market_id NOT IN (SELECT market_id FROM alerts)", ALERTS_SQL)
def latest_analysis_version(t):
    v = t.alerts.groupBy("market_id").agg(F.count_distinct("severity").alias("version"))
    return t.markets.select("market_id").join(v, "market_id", "left").select("market_id", F.coalesce("version", F.lit(0)).alias("version"))


@query("SELECT user_id, count(*) - 1 AS reuse_count, max(ts) AS last_used FROM events GROUP BY user_id")
def cache_reuse(t):
    return t.table("events").groupBy("user_id").agg((F.count("*") - 1).alias("reuse_count"), F.max("ts").alias("last_used"))


@query("SELECT event_id, user_id, ts FROM events WHERE (ts >= TIMESTAMP '2024-01-29' OR value >= 99) ORDER BY ts DESC, event_id LIMIT 100")
def annotations_since(t):
    d = t.table("events").where((F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")) | (F.col("value") >= 99))
    return d.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "ts")


@query("SELECT event_type, sha256(event_type || '|' || user_id) AS item_hash, max(ts) AS newest, CASE WHEN max(value) >= 95 THEN 'daily' WHEN max(value) >= 90 THEN 'weekly' ELSE 'monthly' END AS tier FROM events GROUP BY event_type, user_id")
def news_selection(t):
    d = t.table("events").groupBy("event_type", "user_id").agg(F.max("ts").alias("newest"), F.max("value").alias("v"))
    tier = F.when(F.col("v") >= 95, "daily").when(F.col("v") >= 90, "weekly").otherwise("monthly")
    return d.select("event_type", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("item_hash"), "newest", tier.alias("tier"))


@query("SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN user_id % 2 = 0 THEN 0 WHEN abs(value - 50) >= 45 THEN 1 ELSE 2 END, value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def annotation_order(t):
    first = F.when(F.col("user_id") % 2 == 0, 0).when(F.abs(F.col("value") - 50) >= 45, 1).otherwise(2)
    return flow.newest(t.table("events"), ["event_type"], 10, [first.asc(), F.desc("value"), F.col("event_id")]).select("event_type", "event_id", "rank")


@query("SELECT market_id FROM markets WHERE market_id % 3 = 0 AND end_at < TIMESTAMP '2001-12-03' ORDER BY end_at, market_id LIMIT 20", MARKETS_SQL)
def markets_to_purge(t):
    return t.markets.where((F.col("market_id") % 3 == 0) & (F.col("end_at") < F.lit("2001-12-03").cast("timestamp_ntz"))).orderBy("end_at", "market_id").limit(20).select("market_id")
