"""Panels of the learning loop's dashboard, over the reviews of closed markets and a window of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeflow.functions import rounding
from tradeflow.plans.named import query
from tradeflow.plans.reports import REVIEWS_SQL, reviews
from tradeflow.sources.scratch import kept
from tradeflow.sources.trades import MEASURED_SQL

FROM, TO = "2001-06-01 00:00:00", "2001-12-31 00:00:00"

REVIEWED_SQL = REVIEWS_SQL + f""", judged AS (SELECT r.market_id, r.closed_at AS reviewed_at, r.model, r.cost, count(a.dedup_key) AS alerts, count(a.dedup_key) FILTER (a.outcome_status = 'correct') AS correct, count(a.dedup_key) FILTER (a.outcome_status = 'wrong') AS wrong, round(avg(a.clv_6h), 4) + 0.0 AS avg_clv_6h
    FROM reviews r LEFT JOIN measured a ON a.market_id = r.market_id AND a.sent_at <= r.closed_at WHERE r.status = 'succeeded' AND r.closed_at >= TIMESTAMP '{FROM}' AND r.closed_at <= TIMESTAMP '{TO}' GROUP BY ALL),
  reviewed AS (SELECT *, CASE WHEN alerts = 0 THEN 'missed_signal' WHEN correct > wrong THEN 'confirmed_signal' WHEN wrong > correct THEN 'false_positive' ELSE 'inconclusive' END AS verdict, coalesce(round(greatest(correct, wrong) / nullif(correct + wrong, 0), 4), 0) AS confidence FROM judged)"""


def _reviewed(t):
    """A row for each reviewed market of the window: verdict, confidence, alerts, mean move and cost."""
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    m = t.returns("ret_6h")  # first, so that the markets are read off the trades written for it
    r = reviews(t).where((F.col("status") == "succeeded") & (F.col("closed_at") >= at(FROM)) & (F.col("closed_at") <= at(TO))).select(F.col("market_id").alias("_m"), F.col("closed_at").alias("reviewed_at"), "model", "cost")
    j = r.join(m, (F.col("market_id") == F.col("_m")) & (F.col("sent_at") <= F.col("reviewed_at")), "left")
    d = j.groupBy(F.col("_m").alias("market_id"), "reviewed_at", "model", "cost").agg(
        F.count("dedup_key").alias("alerts"), F.count_if(F.col("outcome_status") == "correct").alias("correct"), F.count_if(F.col("outcome_status") == "wrong").alias("wrong"), (rounding.rounded(F.avg("clv_6h"), 4) + 0.0).alias("avg_clv_6h"))
    verdict = F.when(F.col("alerts") == 0, "missed_signal").when(F.col("correct") > F.col("wrong"), "confirmed_signal").when(F.col("wrong") > F.col("correct"), "false_positive").otherwise("inconclusive")
    sure = F.coalesce(rounding.rounded(F.try_divide(F.greatest("correct", "wrong"), F.col("correct") + F.col("wrong")), 4), F.lit(0.0))
    return d.withColumns({"verdict": verdict, "confidence": sure})


@query("""SELECT count(*) AS reviewed, count(*) FILTER (verdict = 'confirmed_signal') AS confirmed, count(*) FILTER (verdict = 'false_positive') AS false_positive, count(*) FILTER (verdict IN ('inconclusive', 'no_edge', 'missed_signal')) AS inconclusive, round(avg(cost), 6) AS mean_cost, round(coalesce(sum(cost), 0), 6) AS total_cost FROM reviewed""", MEASURED_SQL + REVIEWED_SQL)
def panel_stats(t):
    """The six single figures in one pass."""
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return _reviewed(t).agg(F.count("*").alias("reviewed"), is_("confirmed_signal").alias("confirmed"), is_("false_positive").alias("false_positive"), is_("inconclusive", "no_edge", "missed_signal").alias("inconclusive"),
                            rounding.rounded(F.avg("cost"), 6).alias("mean_cost"), rounding.rounded(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"))


@query("""SELECT 'verdict' AS series, date_trunc('day', reviewed_at)::TIMESTAMP AS day, verdict AS metric, count(*)::DOUBLE AS value FROM reviewed GROUP BY ALL UNION ALL SELECT 'cost', date_trunc('day', reviewed_at)::TIMESTAMP, model, round(sum(cost), 6) FROM reviewed GROUP BY ALL""", MEASURED_SQL + REVIEWED_SQL)
def panel_series(t):
    """Reviews by verdict and cost by model, a point a day, as long rows."""
    d = _reviewed(t).withColumn("day", F.date_trunc("day", "reviewed_at").cast("timestamp_ntz"))
    x = d.select("day", F.explode(F.array(F.struct(F.lit("verdict").alias("series"), F.col("verdict").alias("metric"), F.lit(1.0).alias("v")), F.struct(F.lit("cost").alias("series"), F.col("model").alias("metric"), F.col("cost").alias("v")))).alias("x"))
    return x.groupBy("x.series", "day", "x.metric").agg(rounding.rounded(F.sum("x.v"), 6).alias("value")).select("series", "day", "metric", "value")


@query("""SELECT verdict, rank, market_id, reviewed_at, confidence, alerts, avg_clv_6h FROM (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY confidence DESC, reviewed_at DESC, market_id) AS rank FROM reviewed WHERE verdict IN ('confirmed_signal', 'false_positive')) WHERE rank <= 20""", MEASURED_SQL + REVIEWED_SQL)
def panel_top_markets(t):
    """The surest confirmed and false positive markets."""
    w = Window.partitionBy("verdict").orderBy(F.desc("confidence"), F.desc("reviewed_at"), "market_id")
    d = kept(_reviewed(t)).where(F.col("verdict").isin("confirmed_signal", "false_positive")).withColumn("rank", F.row_number().over(w))
    return d.where("rank <= 20").select("verdict", "rank", "market_id", "reviewed_at", "confidence", "alerts", "avg_clv_6h")
