"""Queries over alerts: creation, delivery, gates, outcome, forward returns, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions import bands, rounding
from tradeflow.operators import flow, outcomes, scoring, state
from tradeflow.plans.flow import beside, rounded
from tradeflow.plans.named import query
from tradeflow.sources.trades import ALERTS_SQL, MEASURED_SQL, NOW, TRADES_SQL

RANK_SQL = "CASE severity WHEN 'hard' THEN 4 WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
#: The alerts' payload, as the reference stores it beside the columns.
PAYLOAD_SQL = ", loaded AS (SELECT *, json_object('trade', json_object('wallet', trader_id, 'notional_usd', notional), 'odds', odds) AS payload FROM alerts)"


def payloads(t):
    return t.alerts.withColumn("payload", F.to_json(F.struct(F.struct(F.col("trader_id").alias("wallet"), F.col("notional").alias("notional_usd")).alias("trade"), "odds")))


@query("SELECT event_id, kind, severity, count(*) AS n FROM alerts GROUP BY ALL", ALERTS_SQL)
def event_alerts_by_kind(t):
    return t.alerts.groupBy("event_id", "kind", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, rank, dedup_key, severity FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {RANK_SQL} DESC, sent_at DESC, dedup_key) AS rank FROM alerts) WHERE rank <= 5", ALERTS_SQL)
def event_top_alerts(t):
    d = flow.newest(t.alerts, ["event_id"], 5, [bands.severity_rank("severity").desc(), F.desc("sent_at"), "dedup_key"])
    return d.select("event_id", "rank", "dedup_key", "severity")


@query("SELECT count(*) AS created, (SELECT count(*) FROM alerts WHERE market_id % 4 = 0) AS known FROM alerts WHERE market_id % 4 <> 0", ALERTS_SQL)
def create_pending_alerts(t):
    """A batch that holds every alert twice, against a history that holds a quarter of them."""
    known = t.alerts.where("market_id % 4 = 0").select("dedup_key")
    new = state.new_rows(t.alerts.unionByName(t.alerts), known, ["dedup_key"], [F.col("sent_at")])
    return beside(new.agg(F.count("*").alias("created")), known.agg(F.count("*").alias("known")))


STATUS_SQL = ", queue AS (SELECT *, CASE market_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'sending' ELSE 'sent' END AS status, market_id % 4 AS attempts, sent_at + INTERVAL 1 DAY * (market_id % 4) AS next_retry FROM alerts)"


def queue(t):
    m = F.col("market_id")
    status = F.when(m % 5 == 0, "pending").when(m % 5 == 1, "failed").when(m % 5 == 2, "sending").otherwise("sent")
    return t.alerts.withColumns({"status": status, "attempts": m % 4, "next_retry": F.col("sent_at") + F.make_dt_interval((m % 4).cast("int"))})


@query(f"SELECT dedup_key, status, attempts FROM queue WHERE status = 'pending' OR (status = 'failed' AND next_retry <= TIMESTAMP '{NOW}') ORDER BY sent_at, dedup_key LIMIT 100", ALERTS_SQL + STATUS_SQL)
def alerts_due(t):
    due = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("next_retry") <= F.to_timestamp_ntz(F.lit(NOW))))
    return queue(t).where(due).orderBy("sent_at", "dedup_key").limit(100).select("dedup_key", "status", "attempts")


@query("SELECT status, attempts, count(*) AS n, max(wait_s) AS wait_s FROM (SELECT CASE WHEN status = 'sending' AND attempts % 2 = 0 THEN 'sent' WHEN status = 'sending' THEN 'failed' ELSE status END AS status, attempts + CASE WHEN status = 'sending' AND attempts % 2 = 1 THEN 1 ELSE 0 END AS attempts, least(3600, pow(2, attempts) * 5) AS wait_s FROM queue) GROUP BY ALL", ALERTS_SQL + STATUS_SQL)
def alert_delivery(t):
    """Sending rows become sent or, with an odd number of attempts, failed with one more."""
    sending, odd = F.col("status") == "sending", F.col("attempts") % 2 == 1
    d = queue(t).select(F.when(sending & ~odd, "sent").when(sending, "failed").otherwise(F.col("status")).alias("status"), (F.col("attempts") + F.when(sending & odd, 1).otherwise(0)).alias("attempts"), state.backoff(F.col("attempts")).alias("wait_s"))
    return d.groupBy("status", "attempts").agg(F.count("*").alias("n"), F.max("wait_s").alias("wait_s"))


@query("SELECT category_id, market_id, max(sent_at) AS sent_at, arg_max(dedup_key, (sent_at, dedup_key)) AS dedup_key FROM alerts WHERE kind = 'hot_trade' GROUP BY ALL", ALERTS_SQL)
def latest_category_alert(t):
    return t.alerts.where("kind = 'hot_trade'").groupBy("category_id", "market_id").agg(F.max("sent_at").alias("sent_at"), F.max_by("dedup_key", F.struct("sent_at", "dedup_key")).alias("dedup_key"))


@query(f"SELECT a.dedup_key, m.end_at FROM alerts a JOIN markets m USING (market_id) WHERE a.outcome_status = 'unresolved' AND m.end_at <= TIMESTAMP '{NOW}' + INTERVAL 28 DAY", ALERTS_SQL)
def alerts_for_outcome_check(t):
    j = t.alerts.where("outcome_status = 'unresolved'").join(t.markets.select("market_id", "end_at"), "market_id")
    return j.where(F.col("end_at") <= F.to_timestamp_ntz(F.lit(NOW)) + F.expr("INTERVAL 28 DAYS")).select("dedup_key", "end_at")


@query("SELECT dedup_key FROM alerts a WHERE outcome_status <> 'unresolved' AND NOT EXISTS (SELECT 1 FROM alerts b WHERE b.dedup_key = a.dedup_key AND b.market_id % 2 = 0)", ALERTS_SQL)
def alerts_for_postmortem(t):
    analysed = t.alerts.where("market_id % 2 = 0").select("dedup_key")
    return t.alerts.where("outcome_status <> 'unresolved'").join(analysed, "dedup_key", "left_anti").select("dedup_key")


@query("SELECT event_id, wallet, count(*) AS n, round(max(usd), 2) AS largest FROM (SELECT event_id, CAST(json_extract_string(payload, '$.trade.wallet') AS BIGINT) AS wallet, CAST(json_extract_string(payload, '$.trade.notional_usd') AS DOUBLE) AS usd FROM loaded WHERE sent_at >= TIMESTAMP '2001-01-01') GROUP BY ALL", ALERTS_SQL + PAYLOAD_SQL)
def event_concentration(t):
    d = payloads(t).where(F.col("sent_at") >= F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")))
    d = d.select("event_id", F.get_json_object("payload", "$.trade.wallet").cast("long").alias("wallet"), F.get_json_object("payload", "$.trade.notional_usd").cast("double").alias("usd"))
    return d.groupBy("event_id", "wallet").agg(F.count("*").alias("n"), rounding.rounded(F.max("usd"), 2).alias("largest"))


@query("SELECT key, dedup_key, passes FROM walk WHERE seq > 0", "RECURSIVE " + ALERTS_SQL + """, numbered AS (
  SELECT event_id::VARCHAR AS key, sent_at AS moment, trader_id::VARCHAR AS wallet, notional, severity, dedup_key,
         row_number() OVER (PARTITION BY event_id ORDER BY sent_at, trader_id::VARCHAR, notional, severity, dedup_key) AS seq FROM alerts), walk AS (
  SELECT DISTINCT key, 0::BIGINT AS seq, NULL::VARCHAR AS dedup_key, NULL::BOOLEAN AS passes, []::STRUCT(moment TIMESTAMP, wallet VARCHAR, notional DOUBLE)[] AS kept FROM numbered
  UNION ALL
  SELECT key, seq, dedup_key, passes, CASE WHEN passes THEN list_append(recent, {'moment': moment, 'wallet': wallet, 'notional': notional}) ELSE recent END FROM (
    SELECT *, severity <> 'info' OR NOT (coalesce(notional < 2 * list_max([x.notional for x in recent if x.wallet = wallet]), false)
                OR len(of_week) >= 3 AND coalesce(notional < 2 * list_max(of_week), false)) AS passes FROM (
      SELECT *, [x.notional for x in recent if x.moment >= moment - INTERVAL 7 DAY] AS of_week FROM (
        SELECT n.*, [x for x in w.kept if x.moment >= n.moment - INTERVAL 30 DAY] AS recent FROM walk w JOIN numbered n ON n.key = w.key AND n.seq = w.seq + 1))))""")
def concentration_gate(t):
    """Info alerts by accepted history; sequential within an event, in SQL a row an event and step."""
    return state.concentration_gate(t.alerts, wallet_hours=24 * 30, event_hours=24 * 7)


@query('SELECT key, moment AS "at", trades, wallets, round(total, 2) AS total, sample FROM fired JOIN hits USING (key, seq)', "RECURSIVE " + ALERTS_SQL + """, numbered AS (
  SELECT category_id::VARCHAR AS key, traded_at::TIMESTAMP AS moment, trader_id::VARCHAR AS wallet, notional,
         row_number() OVER (PARTITION BY category_id ORDER BY traded_at, trader_id::VARCHAR, notional) AS seq FROM scored WHERE severity IS NOT NULL), hits AS (
  SELECT r.key, r.seq, r.moment, count(*)::INT AS trades, count(DISTINCT w.wallet)::INT AS wallets, sum(w.notional) AS total, array_to_string(list(w.wallet || '=' || printf('%.2f', w.notional) ORDER BY w.seq)[1:5], '|') AS sample
  FROM numbered r JOIN numbered w ON r.key = w.key AND w.seq <= r.seq AND w.moment >= r.moment - INTERVAL 48 HOUR
  GROUP BY r.key, r.seq, r.moment HAVING count(*) >= 5 AND count(DISTINCT w.wallet) >= 3 AND sum(w.notional) >= 200000), firsts AS (
  SELECT key, moment, min(seq) AS seq FROM hits GROUP BY key, moment), later AS (
  SELECT h.key, h.seq, min(g.seq) AS next_seq FROM hits h JOIN firsts g ON h.key = g.key AND h.moment + INTERVAL 14 DAY <= g.moment GROUP BY h.key, h.seq), fired AS (
  SELECT key, min(seq) AS seq FROM hits GROUP BY key UNION ALL SELECT l.key, l.next_seq FROM fired f JOIN later l ON f.key = l.key AND f.seq = l.seq)""")
def cluster_alerts(t):
    """Hard alerts of a sliding window with cool-down, over anomalous trades."""
    c = t.scored.where("severity is not null").select(F.col("category_id"), F.col("traded_at").alias("at"), F.col("trader_id").cast("string").alias("wallet"), "notional")
    d = state.cluster_alerts(c, "category_id", hours=48, min_trades=5, min_wallets=3, min_usd=200_000, cooldown_hours=24 * 14)
    return d.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "trades", "wallets", rounding.rounded("total", 2).alias("total"), F.array_join("sample", "|").alias("sample"))


@query("SELECT dedup_key, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("ret_15m", "ret_1h", "ret_6h", "ret_24h")) + ", CASE (ret_15m IS NOT NULL)::INT + (ret_1h IS NOT NULL)::INT + (ret_6h IS NOT NULL)::INT + (ret_24h IS NOT NULL)::INT WHEN 4 THEN 'done' WHEN 0 THEN 'pending' ELSE 'partial' END AS status FROM measured", MEASURED_SQL)
def forward_returns(t):
    cols = ["ret_15m", "ret_1h", "ret_6h", "ret_24h"]
    d = t.measured.withColumn("status", outcomes.drift_status(cols))
    return d.select("dedup_key", *[(rounding.rounded(c, 6) + 0.0).alias(c) for c in cols], "status")  # + 0.0: no negative zero


@query("SELECT side, round(sum(CASE WHEN clv_15m > 0 AND clv_1h <= 0 THEN 1 ELSE 0 END) / count(clv_1h), 6) AS reversal, round(avg(clv_6h), 6) AS mean_cents, count(*) AS n FROM measured GROUP BY side", MEASURED_SQL)
def signed_moves(t):
    return t.measured.groupBy("side").agg(rounding.rounded(F.sum(F.when(outcomes.reversal(), 1).otherwise(0)) / F.count("clv_1h"), 6).alias("reversal"), rounding.rounded(F.avg("clv_6h"), 6).alias("mean_cents"), F.count("*").alias("n"))


def _case(x: str, edges, zero: bool = True) -> str:
    return "CASE " + (f"WHEN {x} <= 0 THEN '' " if zero else "") + " ".join(f"WHEN {x} < {e} THEN '{n}'" for e, n in edges if e is not None) + f" ELSE '{edges[-1][1]}' END"


LIFE_CASE = "CASE WHEN lifecycle < 75 THEN '0-75%' WHEN lifecycle < 80 THEN '75-80%' WHEN lifecycle < 85 THEN '80-85%' WHEN lifecycle < 90 THEN '85-90%' WHEN lifecycle < 95 THEN '90-95%' WHEN lifecycle <= 100 THEN '95-100%' ELSE 'unknown' END"


@query(f"SELECT {LIFE_CASE} AS lifecycle_band, {_case('odds', bands.ODDS)} AS odds_band, {_case('notional', bands.NOTIONAL)} AS notional_band, {_case('100 * (1 - price) / price', bands.RETURN_PCT, False)} AS return_band, count(*) AS n FROM alerts GROUP BY ALL", ALERTS_SQL)
def attribution_buckets(t):
    d = t.alerts.select(bands.lifecycle_band("lifecycle").alias("lifecycle_band"), bands.odds_band("odds").alias("odds_band"), bands.notional_band("notional").alias("notional_band"), bands.return_band_of_price("price").alias("return_band"))
    return d.groupBy("lifecycle_band", "odds_band", "notional_band", "return_band").agg(F.count("*").alias("n"))


@query("SELECT dedup_key, CASE WHEN won IS NULL THEN 'unknown' WHEN (lower(won) = lower(outcome)) = (side = 'BUY') THEN 'correct' ELSE 'wrong' END AS verdict FROM (SELECT *, CASE market_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' END AS won FROM alerts)", ALERTS_SQL)
def outcome_classification(t):
    """Winner from arrays of outcomes and prices, as a catalog delivers them."""
    m = F.col("market_id") % 3
    prices = F.when(m == 0, F.array(F.lit("1"), F.lit("0"))).when(m == 1, F.array(F.lit("0"), F.lit("1.0"))).otherwise(F.array(F.lit("0.5"), F.lit("0.5")))
    d = t.alerts.withColumns({"outcomes": F.array(F.lit("o"), F.lit("F")), "prices": prices})
    return d.select("dedup_key", outcomes.classified(outcomes.winner("outcomes", "prices"), F.col("outcome"), F.col("side")).alias("verdict"))


@query(f"""SELECT bucket, count(*) AS n, round(sum(edge * weight) / sum(weight), 6) AS weighted_edge, round(avg(CASE WHEN outcome_status = 'correct' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM (SELECT *, {_case('implied', bands.CALIBRATION, False)} AS bucket, CASE outcome_status WHEN 'correct' THEN 1 - implied WHEN 'wrong' THEN -implied END AS edge,
  CASE severity WHEN 'info' THEN 1.0 WHEN 'warning' THEN 3.0 WHEN 'critical' THEN 10.0 WHEN 'hard' THEN 25.0 ELSE 0 END AS weight FROM (SELECT *, CASE side WHEN 'SELL' THEN 1 - price ELSE price END AS implied FROM alerts)) WHERE edge IS NOT NULL GROUP BY bucket""", ALERTS_SQL)
def calibration(t):
    d = outcomes.with_edge(t.alerts).where("edge is not null")
    return d.groupBy("bucket").agg(F.count("*").alias("n"), rounding.rounded(F.sum(F.col("edge") * F.col("weight")) / F.sum("weight"), 6).alias("weighted_edge"), rounding.rounded(F.avg(F.when(F.col("outcome_status") == "correct", 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query("SELECT market_id, to_json(list({key: dedup_key, severity: severity} ORDER BY dedup_key) FILTER (r <= 50))::VARCHAR AS package, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY severity, sent_at DESC, dedup_key) AS r FROM alerts WHERE severity <> 'info') GROUP BY market_id", ALERTS_SQL)
def evidence_package(t):
    """The strongest and newest fifty alerts of a market as one JSON, and how many strong ones it has."""
    strong = t.alerts.where("severity <> 'info'")
    top = flow.newest(strong, ["market_id"], 50, ["severity", F.desc("sent_at"), "dedup_key"])
    p = top.groupBy("market_id").agg(F.array_sort(F.collect_list(F.struct(F.col("dedup_key").alias("key"), "severity"))).alias("p"))  # fifty at most
    return strong.groupBy("market_id").agg(F.count("*").alias("n")).join(p, "market_id").select("market_id", F.to_json("p").alias("package"), "n")


@query("SELECT key, count(*) AS n FROM (SELECT concat_ws('|', CASE WHEN lifecycle < 90 THEN 'early' ELSE 'late' END, CASE WHEN severity = 'info' THEN '_' ELSE severity END, category_id) AS key FROM alerts) GROUP BY ALL", ALERTS_SQL)
def control_keys(t):
    key = bands.control_key(F.when(F.col("lifecycle") < 90, "early").otherwise("late"), F.when(F.col("severity") != "info", F.col("severity")).otherwise(F.lit("")), "category_id")
    return t.alerts.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT key, count(*) AS n FROM (SELECT DISTINCT concat_ws('|', 'cluster', category_id, floor(epoch(sent_at) / 604800)::BIGINT) AS key, trader_id FROM alerts) GROUP BY ALL", ALERTS_SQL)
def cooldown_keys(t):
    key = F.concat_ws("|", F.lit("cluster"), F.col("category_id").cast("string"), F.floor(F.unix_seconds(F.col("sent_at").cast("timestamp")) / 604_800).cast("string"))
    return t.alerts.select(key.alias("key"), "trader_id").distinct().groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT r_name, count(*) AS n FROM trades JOIN region ON category_id = r_regionkey WHERE lower(r_name) LIKE '%asia%' OR lower(r_name) LIKE '%europe%' GROUP BY r_name", TRADES_SQL)
def category_whitelist(t):
    j = t.trades.join(t.table("region"), F.col("category_id") == F.col("r_regionkey"))
    return j.where(scoring.allowed_category(F.col("r_name"), F.lit(""), ["Asia", "EUROPE"])).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT dedup_key, CASE WHEN market_id % 2 = 0 THEN 'b' ELSE CASE WHEN severity IN ('warning', 'critical') THEN 'a' ELSE 'b' END END AS category, CASE WHEN market_id % 2 = 0 AND severity = 'info' THEN 'info' ELSE severity END AS severity FROM alerts", ALERTS_SQL)
def category_fan_out(t):
    """An alert scored under two categories: the second has the same severity in even markets, info in odd ones."""
    cats = F.array(F.struct(F.lit("a").alias("category"), F.lit(0).alias("position"), F.col("severity")), F.struct(F.lit("b").alias("category"), F.lit(1).alias("position"), F.when(F.col("market_id") % 2 == 0, F.col("severity")).otherwise("info").alias("severity")))
    return scoring.strongest_category(t.alerts.withColumn("categories", cats), ["dedup_key"])
