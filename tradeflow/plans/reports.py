"""Reporting queries: quality views, snapshots, funnel, tuning sheets and distribution sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions import rounding
from tradeflow.operators import flow
from tradeflow.operators.selection import percentiles
from tradeflow.plans.flow import beside, rounded
from tradeflow.plans.named import query
from tradeflow.sources.scratch import kept
from tradeflow.sources.trades import ALERTS_SQL, DECISIONS_SQL, MEASURED_SQL, NOW, TRADES_SQL

REVIEWS_SQL = ", reviews AS (SELECT market_id, end_at - INTERVAL 15 DAY AS closed_at, CASE market_id % 3 WHEN 0 THEN 'thin' WHEN 1 THEN 'late' ELSE 'fair' END AS reason, CASE WHEN market_id % 5 = 4 THEN 'failed' ELSE 'succeeded' END AS status, CASE market_id % 2 WHEN 0 THEN 'small' ELSE 'large' END AS model, 100 * (market_id % 7) AS tokens, 0.01::DOUBLE * (market_id % 7) AS cost FROM markets)"


def reviews(t):
    m = F.col("market_id")
    return t.markets.select("market_id", (F.col("end_at") - F.expr("INTERVAL 15 DAYS")).alias("closed_at"), F.when(m % 3 == 0, "thin").when(m % 3 == 1, "late").otherwise("fair").alias("reason"),
                            F.when(m % 5 == 4, "failed").otherwise("succeeded").alias("status"), F.when(m % 2 == 0, "small").otherwise("large").alias("model"), (100 * (m % 7)).alias("tokens"), (0.01 * (m % 7)).alias("cost"))


def _is(c: str, v: str):
    return F.count_if(F.col(c) == v)


@query("""SELECT r.market_id, r.reason, count(a.dedup_key) AS alerts, count(a.dedup_key) FILTER (a.severity = 'critical') AS critical, count(a.dedup_key) FILTER (a.outcome_status = 'correct') AS correct, count(a.dedup_key) FILTER (a.outcome_status = 'wrong') AS wrong, round(avg(a.ret_6h), 6) + 0.0 AS mean_6h, round(avg(a.ret_24h), 6) + 0.0 AS mean_24h
  FROM reviews r LEFT JOIN measured a ON a.market_id = r.market_id AND a.sent_at <= r.closed_at WHERE r.status = 'succeeded' GROUP BY ALL""", MEASURED_SQL + REVIEWS_SQL)
def close_review_quality(t):
    d = t.returns("ret_6h", "ret_24h")  # first, so that the markets are read off the trades written for it
    r = reviews(t).where("status = 'succeeded'").select(F.col("market_id").alias("m"), "reason", "closed_at")
    j = r.join(d, (F.col("market_id") == F.col("m")) & (F.col("sent_at") <= F.col("closed_at")), "left")
    return j.groupBy(F.col("m").alias("market_id"), "reason").agg(F.count("dedup_key").alias("alerts"), _is("severity", "critical").alias("critical"), _is("outcome_status", "correct").alias("correct"), _is("outcome_status", "wrong").alias("wrong"),
                                                                  (rounding.rounded(F.avg("ret_6h"), 6) + 0.0).alias("mean_6h"), (rounding.rounded(F.avg("ret_24h"), 6) + 0.0).alias("mean_24h"))


@query("""SELECT kind, severity, n, correct, wrong, round(correct / nullif(correct + wrong, 0), 6) AS hit_rate, CASE WHEN n < 10 THEN 'needs_more_data' WHEN correct / nullif(correct + wrong, 0) > 0.65 THEN 'keep' WHEN wrong / nullif(correct + wrong, 0) > 0.55 THEN 'tighten' ELSE 'watch' END AS verdict FROM
  (SELECT kind, severity, count(*) AS n, count(*) FILTER (outcome_status = 'correct') AS correct, count(*) FILTER (outcome_status = 'wrong') AS wrong FROM alerts WHERE market_id IN (SELECT market_id FROM reviews WHERE status = 'succeeded') GROUP BY ALL)""", ALERTS_SQL + REVIEWS_SQL)
def strategy_quality(t):
    seen = reviews(t).where("status = 'succeeded'").select("market_id").distinct()
    d = t.alerts.join(seen, "market_id", "left_semi").groupBy("kind", "severity").agg(F.count("*").alias("n"), _is("outcome_status", "correct").alias("correct"), _is("outcome_status", "wrong").alias("wrong"))
    hit, miss = F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong")), F.try_divide(F.col("wrong"), F.col("correct") + F.col("wrong"))
    return d.withColumns({"hit_rate": rounding.rounded(hit, 6), "verdict": F.when(F.col("n") < 10, "needs_more_data").when(hit > 0.65, "keep").when(miss > 0.55, "tighten").otherwise("watch")})


@query("""SELECT reason, kind, n, round(rate, 6) AS rate, round(mean_6h, 6) AS mean_6h, CASE WHEN mean_6h > 0.01 THEN 'positive' WHEN mean_6h < -0.01 THEN 'negative' ELSE 'flat' END AS verdict FROM (SELECT r.reason, a.kind, count(*) AS n, avg(CASE WHEN outcome_status = 'correct' THEN 1.0 ELSE 0.0 END) AS rate, avg(ret_6h) AS mean_6h FROM measured a JOIN reviews r USING (market_id) GROUP BY ALL)""", MEASURED_SQL + REVIEWS_SQL)
def reason_quality(t):
    d = t.measured.join(reviews(t).select("market_id", "reason"), "market_id").groupBy("reason", "kind").agg(F.count("*").alias("n"), F.avg(F.when(F.col("outcome_status") == "correct", 1.0).otherwise(0.0)).alias("rate"), F.avg("ret_6h").alias("mean_6h"))
    return rounded(d.withColumn("verdict", F.when(F.col("mean_6h") > 0.01, "positive").when(F.col("mean_6h") < -0.01, "negative").otherwise("flat")), "rate", "mean_6h", digits=6)


@query("SELECT date_trunc('month', closed_at)::TIMESTAMP AS month, model, count(*) AS n, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM reviews GROUP BY ALL", ALERTS_SQL + REVIEWS_SQL)
def review_cost(t):
    return reviews(t).groupBy(F.date_trunc("month", "closed_at").cast("timestamp_ntz").alias("month"), "model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), rounding.rounded(F.sum("cost"), 6).alias("cost"))


@query("SELECT market_id, reason, closed_at FROM reviews ORDER BY closed_at DESC, market_id LIMIT 200", ALERTS_SQL + REVIEWS_SQL)
def review_examples(t):
    return reviews(t).orderBy(F.desc("closed_at"), "market_id").limit(200).select("market_id", "reason", "closed_at")


@query(f"SELECT m.market_id FROM markets m WHERE m.end_at <= TIMESTAMP '{NOW}' + INTERVAL 29 DAY AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.market_id = m.market_id AND r.status = 'succeeded')", ALERTS_SQL + REVIEWS_SQL)
def close_review_candidates(t):
    closed = t.markets.where(F.col("end_at") <= F.to_timestamp_ntz(F.lit(NOW)) + F.expr("INTERVAL 29 DAYS")).select("market_id")
    return closed.join(reviews(t).where("status = 'succeeded'"), "market_id", "left_anti")


@query("""SELECT coalesce(kind, 'all') AS kind, coalesce(severity, 'all') AS severity, count(*) AS n, count(*) FILTER (outcome_status = 'correct') AS correct, count(*) FILTER (outcome_status = 'wrong') AS wrong, (SELECT count(*) > 2000 FROM alerts) AS truncated
  FROM (SELECT * FROM alerts ORDER BY sent_at DESC, dedup_key LIMIT 2000) GROUP BY GROUPING SETS ((), (kind), (severity))""", ALERTS_SQL)
def signal_snapshot(t):
    """Newest 2000 alerts, counted in total, by kind and by severity in one pass."""
    newest = t.alerts.orderBy(F.desc("sent_at"), "dedup_key").limit(2001).withColumn("_r", F.lit(1))
    more = newest.agg((F.count("*") > 2000).alias("truncated"))
    kept = newest.orderBy(F.desc("sent_at"), "dedup_key").limit(2000)
    d = kept.groupingSets([[], [F.col("kind")], [F.col("severity")]], "kind", "severity").agg(F.count("*").alias("n"), _is("outcome_status", "correct").alias("correct"), _is("outcome_status", "wrong").alias("wrong"))
    return beside(d.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("severity", F.lit("all")).alias("severity"), "n", "correct", "wrong"), more)


@query("SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (outcome_status = 'correct') AS success, count(*) FILTER (outcome_status = 'wrong') AS failure, count(*) FILTER (outcome_status = 'unresolved') AS unresolved, round(avg(ret_1h) FILTER (severity = 'info'), 6) AS info_1h, round(avg(ret_24h) FILTER (severity <> 'info'), 6) AS strong_24h FROM measured WHERE sent_at >= TIMESTAMP '2000-01-01' AND sent_at < TIMESTAMP '2001-01-01'", MEASURED_SQL)
def signal_quality(t):
    d = t.measured.where((F.col("sent_at") >= F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))) & (F.col("sent_at") < F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00"))))
    return d.agg(F.count("*").alias("total"), _is("severity", "critical").alias("critical"), _is("outcome_status", "correct").alias("success"), _is("outcome_status", "wrong").alias("failure"), _is("outcome_status", "unresolved").alias("unresolved"),
                 rounding.rounded(F.avg(F.when(F.col("severity") == "info", F.col("ret_1h"))), 6).alias("info_1h"), rounding.rounded(F.avg(F.when(F.col("severity") != "info", F.col("ret_24h"))), 6).alias("strong_24h"))


@query("SELECT kind, severity, count(*) FILTER (outcome_status = 'correct') AS success, count(*) FILTER (outcome_status = 'wrong') AS failure, count(*) FILTER (outcome_status = 'unresolved') AS unresolved FROM alerts GROUP BY ALL", ALERTS_SQL)
def signal_quality_by_kind(t):
    return t.alerts.groupBy("kind", "severity").agg(_is("outcome_status", "correct").alias("success"), _is("outcome_status", "wrong").alias("failure"), _is("outcome_status", "unresolved").alias("unresolved"))


@query("""SELECT event_id, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_id, count(*) AS n FROM alerts GROUP BY event_id) ORDER BY n DESC, event_id LIMIT 10""", ALERTS_SQL)
def funnel_top_events(t):
    per = t.alerts.groupBy("event_id").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("_all"))
    return beside(per, total).orderBy(F.desc("n"), "event_id").limit(10).select("event_id", "n", rounding.rounded(F.col("n") / F.col("_all"), 6).alias("share"))


@query("SELECT (SELECT count(*) FROM markets) AS markets, count(*) AS trades, count(DISTINCT trader_id) AS wallets, count(*) FILTER (severity IS NOT NULL) AS fired, count(DISTINCT market_id) FILTER (severity IS NOT NULL) AS alerting_markets FROM scored", ALERTS_SQL)
def funnel_counts(t):
    m = t.markets.agg(F.count("*").alias("markets"))
    fired = F.col("severity").isNotNull()
    d = t.scored.agg(F.count("*").alias("trades"), F.count_distinct("trader_id").alias("wallets"), F.count_if(fired).alias("fired"), F.count_distinct(F.when(fired, F.col("market_id"))).alias("alerting_markets"))
    return beside(m, d)


@query("SELECT floor(lifecycle / 10)::INT AS decile, count(*) AS n FROM scored GROUP BY ALL", ALERTS_SQL)
def funnel_lifecycle(t):
    return t.scored.groupBy(F.floor(F.col("lifecycle") / 10).cast("int").alias("decile")).agg(F.count("*").alias("n"))


@query("SELECT market_id FROM markets m WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.market_id = m.market_id AND a.severity = 'warning' AND a.sent_at >= TIMESTAMP '2001-06-01')", ALERTS_SQL)
def funnel_silent_markets(t):
    loud = t.alerts.where((F.col("severity") == "warning") & (F.col("sent_at") >= F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00")))).select("market_id")
    return t.markets.select("market_id").join(loud, "market_id", "left_anti")


@query("SELECT count(*) AS pairs, count(*) FILTER (n >= 20) AS enough_trades, count(*) FILTER (n >= 20 AND total >= 1000) AS enough_total, count(*) FILTER (n >= 20 AND span_h >= 24) AS enough_span, round(avg(median), 4) AS mean_median FROM (SELECT count(*) AS n, sum(notional) AS total, quantile_cont(notional, 0.5) AS median, (epoch(max(traded_at)) - epoch(min(traded_at))) / 3600 AS span_h FROM trades GROUP BY market_id, outcome)", TRADES_SQL)
def baseline_readiness(t):
    d = flow.distribution(t.trades, ["market_id", "outcome"]).withColumn("span_h", F.timestamp_diff("SECOND", "oldest", "newest") / 3600)
    enough = F.col("n") >= 20
    return d.agg(F.count("*").alias("pairs"), F.count_if(enough).alias("enough_trades"), F.count_if(enough & (F.col("total") >= 1000)).alias("enough_total"), F.count_if(enough & (F.col("span_h") >= 24)).alias("enough_span"), rounding.rounded(F.avg("median"), 4).alias("mean_median"))


@query("SELECT " + ", ".join(f"count(*) FILTER (notional >= {n} AND odds >= {o}) AS n{n}_o{o}" for n in (10_000, 25_000, 100_000) for o in (3, 5, 8)) + " FROM scored WHERE lifecycle >= 75", ALERTS_SQL)
def gate_breakdown(t):
    return t.scored.where("lifecycle >= 75").agg(*[F.count_if((F.col("notional") >= n) & (F.col("odds") >= o)).alias(f"n{n}_o{o}") for n in (10_000, 25_000, 100_000) for o in (3, 5, 8)])


@query("SELECT market_id, trader_id, round(notional, 2) AS notional, round(odds, 6) AS odds, round(notional / m_p95, 6) AS multiple FROM scored WHERE severity IS NOT NULL AND lifecycle >= 75 ORDER BY traded_at DESC, notional DESC, order_id, line_no LIMIT 100", ALERTS_SQL)
def firing_candidates(t):
    d = t.scored.where("severity is not null and lifecycle >= 75").orderBy(F.desc("traded_at"), F.desc("notional"), "order_id", "line_no").limit(100)
    return d.select("market_id", "trader_id", rounding.rounded("notional", 2).alias("notional"), rounding.rounded("odds", 6).alias("odds"), rounding.rounded("m_p95_ratio", 6).alias("multiple"))


@query("SELECT strategy, level, date_trunc('month', created_at)::TIMESTAMP AS month, count(*) AS n FROM decisions GROUP BY ALL", DECISIONS_SQL)
def decision_rates(t):
    return t.unmeasured.groupBy("strategy", "level", F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT strategy, count(*) AS n, count(clv_15m) AS has_15m, count(clv_24h) AS has_24h, round(quantile_cont(clv_6h, 0.25), 6) AS q1, round(quantile_cont(clv_6h, 0.5), 6) AS q2, round(quantile_cont(clv_6h, 0.75), 6) AS q3 FROM decisions GROUP BY strategy", DECISIONS_SQL)
def return_quartiles(t):
    d = t.decisions.groupBy("strategy").agg(F.count("*").alias("n"), F.count("clv_15m").alias("has_15m"), F.count("clv_24h").alias("has_24h"))
    d = d.join(percentiles(t.decisions, ["strategy"], "clv_6h", (0.25, 0.5, 0.75)).select("strategy", "q"), "strategy", "left")
    return d.select("strategy", "n", "has_15m", "has_24h", *[rounding.rounded(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@query("SELECT s.strategy, s.control_bucket, s.n, round(s.m - c.m, 6) + 0.0 AS lift FROM (SELECT strategy, control_bucket, count(*) AS n, quantile_cont(clv_6h, 0.5) AS m FROM decisions GROUP BY ALL HAVING count(*) >= 10) s JOIN (SELECT control_bucket, quantile_cont(clv_6h, 0.5) AS m FROM decisions GROUP BY ALL) c USING (control_bucket)", DECISIONS_SQL)
def matched_control(t):
    d = t.decisions
    median = lambda keys, name: percentiles(d, keys, "clv_6h", (0.5,)).select(*keys, F.col("q")[0].alias(name))
    s = d.groupBy("strategy", "control_bucket").agg(F.count("*").alias("n")).where("n >= 10").join(median(["strategy", "control_bucket"], "own"), ["strategy", "control_bucket"], "left")
    c = d.select("control_bucket").distinct().join(median(["control_bucket"], "all"), "control_bucket", "left")
    return s.join(c, "control_bucket").select("strategy", "control_bucket", "n", (rounding.rounded(F.col("own") - F.col("all"), 6) + 0.0).alias("lift"))


@query("SELECT 'alerts' AS source, count(*) AS n, max(sent_at) AS newest FROM alerts UNION ALL SELECT 'trades', count(*), max(traded_at) FROM trades UNION ALL SELECT 'markets', count(*), max(end_at) FROM markets", ALERTS_SQL)
def freshness(t):
    one = lambda name, d, at: d.agg(F.count("*").alias("n"), F.max(at).alias("newest")).select(F.lit(name).alias("source"), "n", "newest")
    return one("alerts", t.alerts, "sent_at").unionByName(one("trades", t.trades, "traded_at")).unionByName(one("markets", t.markets, "end_at"))


@query("SELECT strategy, round(round(odds * 2) / 2, 1) AS odds_bin, count(*) AS n, round(avg(clv_6h), 6) AS mean_6h FROM decisions GROUP BY ALL", DECISIONS_SQL)
def feature_histogram(t):
    """The feature comes out of a JSON column, as decisions keep it."""
    d = t.decisions.withColumn("features", F.to_json(F.struct("odds")))
    odds = F.get_json_object("features", "$.odds").cast("double")
    return d.groupBy("strategy", rounding.rounded(rounding.rounded(odds * 2) / 2, 1).alias("odds_bin")).agg(F.count("*").alias("n"), rounding.rounded(F.avg("clv_6h"), 6).alias("mean_6h"))


@query("SELECT strategy, count(*) FILTER (outcome_status <> 'unresolved') AS resolved, round(100.0 * count(*) FILTER (outcome_status = 'correct') / nullif(count(*) FILTER (outcome_status <> 'unresolved'), 0), 4) AS hit_pct FROM decisions GROUP BY strategy", DECISIONS_SQL)
def hit_rates(t):
    done = F.count_if(F.col("outcome_status") != "unresolved")
    return t.unmeasured.groupBy("strategy").agg(done.alias("resolved"), rounding.rounded(F.try_divide(F.lit(100.0) * _is("outcome_status", "correct"), done), 4).alias("hit_pct"))


@query(f"SELECT strategy, count(DISTINCT market_id) AS markets, count(DISTINCT date_trunc('day', created_at)) AS days, date_diff('day', max(created_at), TIMESTAMP '{NOW}') AS idle_days FROM decisions GROUP BY strategy", DECISIONS_SQL)
def load_and_staleness(t):
    return t.unmeasured.groupBy("strategy").agg(F.count_distinct("market_id").alias("markets"), F.count_distinct(F.date_trunc("day", "created_at")).alias("days"), F.datediff(F.to_timestamp_ntz(F.lit(NOW)), F.max("created_at")).cast("long").alias("idle_days"))


Q6 = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


@query("SELECT " + ", ".join(f"round(quantile_cont(notional, {q}), 6) AS p{str(q)[2:]}" for q in Q6) + " FROM scored WHERE lifecycle >= 75", ALERTS_SQL)
def notional_percentiles(t):
    d = percentiles(t.scored.where("lifecycle >= 75"), [], "notional", Q6)
    return d.select(*[rounding.rounded(F.col("q")[i], 6).alias(f"p{str(q)[2:]}") for i, q in enumerate(Q6)])


@query("SELECT severity, round(quantile_cont(notional / m_p95, 0.5), 6) AS p50, round(quantile_cont(notional / m_p95, 0.95), 6) AS p95 FROM scored WHERE severity IS NOT NULL GROUP BY severity", ALERTS_SQL)
def ratio_percentiles(t):
    d = percentiles(t.scored.where("severity is not null"), ["severity"], "m_p95_ratio", (0.5, 0.95))
    return d.select("severity", rounding.rounded(F.col("q")[0], 6).alias("p50"), rounding.rounded(F.col("q")[1], 6).alias("p95"))


@query("SELECT count(*) AS lines, round(quantile_cont(total, 0.5), 4) AS total_p50, round(quantile_cont(total, 0.95), 4) AS total_p95, round(quantile_cont(median, 0.5), 4) AS median_p50 FROM (SELECT sum(notional) AS total, quantile_cont(notional, 0.5) AS median FROM trades GROUP BY trader_id, market_id HAVING count(*) >= 3)", TRADES_SQL)
def line_percentiles(t):
    l = kept(flow.lines(t.trades, ["trader_id", "market_id"]).where("n >= 3").select("total", "median"))
    d = percentiles(l, [], "total", (0.5, 0.95)).select(F.col("n").alias("lines"), rounding.rounded(F.col("q")[0], 4).alias("total_p50"), rounding.rounded(F.col("q")[1], 4).alias("total_p95"))
    return beside(d, percentiles(l, [], "median", (0.5,)).select(rounding.rounded(F.col("q")[0], 4).alias("median_p50")))


@query("SELECT trader_id, market_id, n, round(total, 2) AS total FROM (SELECT trader_id, market_id, count(*) AS n, sum(notional) AS total, quantile_cont(notional, 0.5) AS median FROM trades GROUP BY ALL) WHERE n >= 3 AND total >= 40000 AND median <= 60000", TRADES_SQL)
def many_smalls_lines(t):
    return flow.lines(t.trades, ["trader_id", "market_id"]).where("n >= 3 and total >= 40000 and median <= 60000").select("trader_id", "market_id", "n", rounding.rounded("total", 2).alias("total"))


OWN_SQL = """(SELECT 100 * greatest(coalesce(sum(shares) FILTER (side = 'BUY'), 0) - coalesce(sum(shares) FILTER (side = 'SELL'), 0), 0) / any_value(mb) AS pct, sum(notional) AS vol FROM trades JOIN (SELECT market_id, outcome, sum(shares) FILTER (side = 'BUY') AS mb FROM trades GROUP BY ALL) m USING (market_id, outcome) GROUP BY market_id, outcome, trader_id)"""
OWN_CASE = "CASE WHEN pct <= 0 THEN '' WHEN pct < 0.2 THEN '<0.2' WHEN pct < 0.5 THEN '0.2-0.5' WHEN pct < 1 THEN '0.5-1' WHEN pct < 2 THEN '1-2' ELSE '2+' END"


@query(f"SELECT {OWN_CASE} AS band, CASE WHEN vol < 50000 THEN 'low' WHEN vol < 150000 THEN 'mid' ELSE 'high' END AS volume, count(*) AS n FROM {OWN_SQL} GROUP BY ALL", TRADES_SQL)
def ownership_by_volume(t):
    keys = ["market_id", "outcome"]
    o = flow.ownership_verdict(flow.ownership(t.trades, keys)).select(*keys, "trader_id", F.col("share_pct").alias("pct"))
    v = t.trades.groupBy(*keys, "trader_id").agg(F.sum("notional").alias("vol"))
    p = F.col("pct")
    band = F.when(p <= 0, "").when(p < 0.2, "<0.2").when(p < 0.5, "0.2-0.5").when(p < 1, "0.5-1").when(p < 2, "1-2").otherwise("2+")
    vol = F.when(F.col("vol") < 50_000, "low").when(F.col("vol") < 150_000, "mid").otherwise("high")
    return o.join(v, [*keys, "trader_id"]).groupBy(band.alias("band"), vol.alias("volume")).agg(F.count("*").alias("n"))


@query(f"SELECT severity, round(count(*) FILTER (sent_at >= TIMESTAMP '{NOW}' - INTERVAL 70 DAY) / 70.0, 6) AS per_day_70, round(count(*) FILTER (sent_at >= TIMESTAMP '{NOW}' - INTERVAL 300 DAY) / 300.0, 6) AS per_day_300 FROM alerts GROUP BY severity", ALERTS_SQL)
def severity_mix(t):
    per = lambda d: rounding.rounded(F.count_if(F.col("sent_at") >= F.to_timestamp_ntz(F.lit(NOW)) - F.expr(f"INTERVAL {d} DAYS")) / float(d), 6)
    return t.alerts.groupBy("severity").agg(per(70).alias("per_day_70"), per(300).alias("per_day_300"))


@query("SELECT severity, kind, count(*) AS n, round(100.0 * count(*) FILTER (outcome_status = 'correct') / nullif(count(*) FILTER (outcome_status <> 'unresolved'), 0), 2) AS win_pct FROM alerts GROUP BY ALL", ALERTS_SQL)
def win_percent(t):
    return t.alerts.groupBy("severity", "kind").agg(F.count("*").alias("n"), rounding.rounded(F.try_divide(F.lit(100.0) * _is("outcome_status", "correct"), F.count_if(F.col("outcome_status") != "unresolved")), 2).alias("win_pct"))


@query("SELECT date_trunc('month', sent_at)::TIMESTAMP AS month, count(*) FILTER (market_id % 3 = 0) AS tagged, count(*) AS n FROM alerts GROUP BY ALL", ALERTS_SQL)
def tag_rate(t):
    """A tag inside a JSON array."""
    tags = F.when(F.col("market_id") % 3 == 0, F.lit('["HOT","LATE"]')).otherwise(F.lit('["LATE"]'))
    has = F.array_contains(F.from_json("tags", "array<string>"), "HOT")
    return t.alerts.withColumn("tags", tags).groupBy(F.date_trunc("month", "sent_at").cast("timestamp_ntz").alias("month")).agg(F.count_if(has).alias("tagged"), F.count("*").alias("n"))


@query("SELECT CASE WHEN p < 0.2 THEN '0-0.2' WHEN p < 0.4 THEN '0.2-0.4' WHEN p < 0.6 THEN '0.4-0.6' WHEN p < 0.8 THEN '0.6-0.8' ELSE '0.8-1' END AS purity, count(*) AS n FROM (SELECT abs(b - s) / (b + s) AS p FROM (SELECT coalesce(sum(notional) FILTER (side = 'BUY'), 0) AS b, coalesce(sum(notional) FILTER (side = 'SELL'), 0) AS s FROM trades GROUP BY trader_id, event_id)) GROUP BY ALL", TRADES_SQL)
def directional_purity(t):
    d = flow.side_activity(t.trades, ["trader_id", "event_id"])
    p = F.try_divide(F.abs(F.col("buy_usd") - F.col("sell_usd")), F.col("buy_usd") + F.col("sell_usd"))
    return d.groupBy(F.when(p < 0.2, "0-0.2").when(p < 0.4, "0.2-0.4").when(p < 0.6, "0.4-0.6").when(p < 0.8, "0.6-0.8").otherwise("0.8-1").alias("purity")).agg(F.count("*").alias("n"))


@query("""SELECT m.market_id, coalesce(t.n, 0) AS trades_30d, round(coalesce(t.usd, 0), 2) AS usd_30d, round(p.price, 6) AS last_price, coalesce(a.n, 0) AS alerts_30d FROM markets m LEFT JOIN (SELECT market_id, count(*) AS n, sum(notional) AS usd FROM trades WHERE traded_at >= TIMESTAMP '2001-10-05' GROUP BY ALL) t USING (market_id)
  LEFT JOIN (SELECT market_id, arg_max(price, (traded_at, order_id, line_no, price)) AS price FROM trades GROUP BY ALL) p USING (market_id) LEFT JOIN (SELECT market_id, count(*) AS n FROM alerts WHERE sent_at >= TIMESTAMP '2001-10-05' GROUP BY ALL) a USING (market_id) ORDER BY usd_30d DESC, market_id LIMIT 50""", ALERTS_SQL)
def intelligence_candidates(t):
    """Correlated look-ups as one aggregate for each side and outer joins."""
    since = F.to_timestamp_ntz(F.lit("2001-10-05 00:00:00"))
    tr = t.trades.where(F.col("traded_at") >= since).groupBy("market_id").agg(F.count("*").alias("n"), F.sum("notional").alias("usd"))
    last = t.trades.groupBy("market_id").agg(F.max_by("price", F.struct("traded_at", "order_id", "line_no", "price")).alias("price"))
    al = t.alerts.where(F.col("sent_at") >= since).groupBy("market_id").agg(F.count("*").alias("k"))
    d = t.markets.select("market_id").join(tr, "market_id", "left").join(last, "market_id", "left").join(al, "market_id", "left")
    d = d.select("market_id", F.coalesce("n", F.lit(0)).alias("trades_30d"), rounding.rounded(F.coalesce("usd", F.lit(0.0)), 2).alias("usd_30d"), rounding.rounded("price", 6).alias("last_price"), F.coalesce("k", F.lit(0)).alias("alerts_30d"))
    return d.orderBy(F.desc("usd_30d"), "market_id").limit(50)
