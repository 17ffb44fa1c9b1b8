"""Statements on keyed tables, by kind: inserts, upserts, guarded updates, point reads and bounded lists.

Each has an entry of its own, with its own key, guard, order and rules for columns, laid over one log of
rows (`log`) or over the trade domain. A statement of one key becomes one pass over all keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradeflow.operators import state
from tradeflow.plans.named import ORACLE, QUERIES
from tradeflow.sources import sink
from tradeflow.sources.scratch import scratch
from tradeflow.sources.trades import ALERTS_SQL, DECISIONS_SQL, MARKETS_SQL, Domain

#: Rows of any keyed table: id, key, kind, time, a value, an optional value, a text (empty, null or not) and a state.
LOG = """SELECT event_id AS id, user_id AS k, event_type AS kind, ts AS tm, value AS v, CASE WHEN event_id % 4 <> 0 THEN value END AS opt,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS txt,
  CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'done' ELSE 'sent' END AS status, event_id % 4 AS attempts,
  CASE WHEN event_id % 7 = 0 THEN ts END AS stamp FROM events"""
LATE, EARLY = "TIMESTAMP_NTZ '2024-01-28 00:00:00'", "TIMESTAMP_NTZ '2024-01-03 00:00:00'"


def _log(t: Domain):
    return t.spark.sql(LOG.replace("FROM events", "FROM {events}"), events=t.table("events"))


def _plain(text: str) -> str:
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP")


def _register(name: str, run, sql: str) -> None:
    QUERIES[name] = lambda spark, folder: run(Domain(spark, folder))
    ORACLE[name] = _plain(sql)


# ---------------------------------------------------------------- upserts

#: name: (key, {column: (rule, value)}). Rules: last (newest not null), filled (newest not empty), first (frozen), max, min, count.
UPSERTS = {
    "upsert_market_link": ({"src": "k", "dst": "k % 20", "link_type": "kind"}, {"confidence": ("last", "v"), "updated_at": ("max", "tm"), "created_at": ("min", "tm")}),
    "upsert_holder_snapshot": ({"condition": "k % 50", "token": "kind", "day": "CAST(tm AS DATE)", "wallet": "k"}, {"shares": ("last", "v"), "captured_at": ("max", "tm")}),
    "upsert_market_risk_score": ({"condition": "k", "version": "id % 2"}, {"ambiguity": ("last", "v / 100"), "reasons": ("last", "txt"), "active_from": ("max", "tm")}),
    "upsert_wallet_thesis_line": ({"wallet": "k", "condition": "k % 30", "side": "CASE WHEN id % 2 = 0 THEN 'BUY' ELSE 'SELL' END", "lookback": "id % 3"}, {"usd": ("last", "v"), "trades": ("count", "1"), "newest": ("max", "tm")}),
    "upsert_book_feature_bar": ({"condition": "k % 50", "token": "kind", "seconds": "CASE WHEN id % 2 = 0 THEN 60 ELSE 300 END", "bar_day": "CAST(tm AS DATE)"}, {"mid": ("last", "v"), "low": ("min", "v"), "high": ("max", "v"), "updates": ("count", "1")}),
    "upsert_alert_strategy_dimensions": ({"alert": "k"}, {"odds_bucket": ("last", "CASE WHEN v < 33 THEN 'low' WHEN v < 66 THEN 'mid' ELSE 'high' END"), "kind_bucket": ("last", "kind"), "created_at": ("min", "tm")}),
    "upsert_category": ({"external_id": "k"}, {"label": ("filled", "txt"), "enabled": ("first", "id % 2 = 0"), "seen_at": ("max", "tm")}),
    "upsert_event_catalyst": ({"event": "k % 50", "kind": "kind", "title": "id % 3"}, {"source": ("filled", "txt"), "confidence": ("max", "v / 100"), "expected_at": ("last", "tm")}),
    "upsert_event_annotation": ({"event": "k % 50", "hash": "concat(kind, CAST(k AS STRING))"}, {"title": ("last", "txt"), "score": ("last", "opt"), "first_seen": ("min", "tm"), "last_seen": ("max", "tm")}),
    "upsert_event_page_fetch_state": ({"event": "k"}, {"status": ("last", "status"), "hash": ("filled", "txt"), "fetched_at": ("max", "tm"), "fetches": ("count", "1")}),
    "upsert_market": ({"condition": "k"}, {"question": ("filled", "txt"), "deleted": ("last", "id % 11 = 0"), "first_at": ("min", "tm"), "last_at": ("max", "tm"), "liquidity": ("last", "opt")}),
    "upsert_market_outcome": ({"market": "k", "token": "kind"}, {"label": ("last", "CASE WHEN id % 2 = 0 THEN 'Yes' ELSE 'No' END")}),
    "upsert_news_processed_item": ({"item_hash": "concat(kind, CAST(k % 100 AS STRING))"}, {"decision": ("last", "status"), "first_seen": ("min", "tm"), "last_seen": ("max", "tm"), "times": ("count", "1")}),
    "upsert_daily_report": ({"report_date": "CAST(tm AS DATE)"}, {"body": ("last", "kind"), "score": ("last", "opt"), "generated_at": ("max", "tm")}),
    "upsert_annotation_ranking": ({"period": "CAST(tm AS DATE)", "event": "k % 50", "hash": "kind"}, {"rank": ("last", "id % 10"), "score": ("last", "v")}),
    "upsert_prediction_evaluation": ({"prediction": "k", "horizon": "kind"}, {"price": ("last", "v"), "hit": ("last", "v > 50"), "evaluated_at": ("max", "tm")}),
    "upsert_prediction_feedback": ({"prediction": "k", "horizon": "kind"}, {"move": ("last", "opt"), "verdict": ("filled", "txt"), "recorded_at": ("max", "tm")}),
    "upsert_prediction_usefulness": ({"prediction": "k"}, {"score": ("last", "v"), "samples": ("count", "1"), "updated_at": ("max", "tm")}),
    "upsert_market_prediction": ({"event": "k % 50", "condition": "k"}, {"thesis": ("filled", "txt"), "state": ("last", "status"), "confidence": ("max", "v / 100"), "touched_at": ("max", "tm")}),
    "upsert_repricing_signal": ({"event": "k % 50", "condition": "k", "hash": "kind"}, {"strength": ("last", "v"), "baseline": ("first", "v"), "note": ("filled", "txt"), "edge": ("last", "opt")}),
    "upsert_market_ai_cache": ({"surface": "kind", "cache_key": "k"}, {"answer": ("last", "status"), "expires_at": ("max", "tm"), "writes": ("count", "1")}),
    "upsert_semantic_dedupe": ({"surface": "kind", "dedupe_key": "k % 100"}, {"send_count": ("count", "1"), "last_text": ("filled", "txt"), "last_sent": ("max", "tm")}),
}


def _upsert(key: dict, columns: dict):
    def run(t):
        d = _log(t).selectExpr("id", "tm AS _at", *[f"{e} AS {c}" for c, e in key.items()], *[f"{'CAST(1 AS BIGINT)' if how == 'count' else e} AS {c}" for c, (how, e) in columns.items()])
        rules = {c: "sum" if how == "count" else how for c, (how, _) in columns.items()}
        return state.upsert(d.where("id % 3 <> 0"), d.where("id % 3 = 0"), list(key), "_at", rules)

    fold = {"last": "arg_max({e}, (tm, {e})) FILTER ({e} IS NOT NULL)", "filled": "arg_max({e}, (tm, {e})) FILTER ({e} <> '')", "first": "arg_min({e}, (tm, {e}))", "max": "max({e})", "min": "min({e})", "count": "count(*)"}
    parts = [f"{e} AS {c}" for c, e in key.items()] + [f"{fold[how].format(e=f'({e})')} AS {c}" for c, (how, e) in columns.items()]
    return run, f"WITH log AS ({LOG}) SELECT {', '.join(parts)} FROM log GROUP BY {', '.join(str(i + 1) for i in range(len(key)))}"


# ---------------------------------------------------------------- guarded updates

#: name: (guard, {column: new value}); columns that are not set stay, rows outside the guard stay.
NEXT = "tm + INTERVAL 1 HOUR"
UPDATES = {
    "mark_detection_result": ("status IN ('pending', 'running')", {"status": "CASE WHEN v >= 50 THEN 'done' ELSE 'failed' END", "attempts": "attempts + 1", "stamp": "tm"}),
    "reset_stale_sending": (f"status = 'running' AND tm < {LATE}", {"status": "'pending'"}),
    "touch_outcome_unavailable": ("status = 'pending' AND v < 20", {"stamp": NEXT}),
    "mark_reaction_applied": ("status IN ('pending', 'failed') AND k % 3 <> 0", {"status": "CASE WHEN v < 10 THEN 'failed' ELSE 'done' END", "stamp": "CASE WHEN v < 10 THEN stamp ELSE tm END"}),
    "mark_category_enabled": ("k % 5 = 0", {"status": "'enabled'"}),
    "set_catalyst_status": ("kind = 'purchase'", {"status": "'active'"}),
    "finish_review_succeeded": ("status = 'running' AND k % 3 = 0", {"status": "'succeeded'", "v": "round(v * 2, 6)", "stamp": "tm"}),
    "finish_review_failed": ("status = 'running' AND k % 3 = 1", {"status": "'failed'", "attempts": "attempts + 1", "stamp": NEXT}),
    "finish_review_skipped": ("status = 'running' AND k % 3 = 2", {"status": "'skipped'", "v": "CAST(0 AS DOUBLE)"}),
    "begin_backfill": ("status IN ('pending', 'failed')", {"status": "'running'", "stamp": "tm", "attempts": "attempts + 1"}),
    "complete_backfill": ("status = 'running'", {"status": "CASE WHEN v > 90 THEN 'partial' ELSE 'done' END", "stamp": "tm"}),
    "fail_backfill": ("status = 'running' AND v < 50", {"status": "'failed'", "attempts": "attempts + 1"}),
    "reset_stale_backfills": (f"status = 'running' AND coalesce(stamp, tm) < {LATE}", {"status": "'pending'", "stamp": "CAST(NULL AS TIMESTAMP_NTZ)"}),
    "mark_market_purged": (f"status = 'done' AND stamp IS NULL AND tm < {LATE}", {"stamp": "tm", "v": "CAST(0 AS DOUBLE)"}),
    "requeue_resumed_market": ("status = 'done' AND stamp IS NOT NULL", {"status": "'pending'", "stamp": "CAST(NULL AS TIMESTAMP_NTZ)", "attempts": "CAST(0 AS BIGINT)"}),
    "touch_news_ai_called": ("k % 7 = 0", {"stamp": NEXT}),
    "finish_news_run": ("status = 'running'", {"status": "CASE WHEN v < 5 THEN 'failed' ELSE 'done' END", "stamp": NEXT}),
    "touch_processed_item": ("kind = 'view'", {"stamp": "tm", "attempts": "attempts + 1"}),
    "set_ws_connected": ("k IN (1, 2, 3, 5, 8, 13, 21)", {"status": "'connected'", "stamp": "tm"}),
    "finish_gap_recovery": ("status = 'running' AND kind = 'error'", {"status": "'recovered'", "stamp": NEXT}),
    "mark_work_failed": ("status = 'running'", {"status": "'pending'", "stamp": "tm + INTERVAL 1 MINUTE", "attempts": "attempts + 1"}),
    "archive_prediction": ("status = 'done' AND stamp IS NULL", {"stamp": "tm", "status": "'archived'"}),
    "mark_prediction_stale": (f"status IN ('pending', 'running') AND tm < {EARLY}", {"status": "'stale'", "stamp": "tm"}),
    "touch_prediction_evolution": ("status <> 'done'", {"stamp": "tm"}),
    "mark_report_failed": ("status = 'running'", {"status": "'failed'", "attempts": "attempts + 1"}),
    "mark_report_sent": ("status IN ('running', 'failed') AND v > 10", {"status": "'sent'", "stamp": "tm"}),
    "reset_stale_detection_claims": (f"status IN ('pending', 'failed') AND stamp IS NOT NULL AND stamp < {LATE} - INTERVAL 10 DAY", {"stamp": "CAST(NULL AS TIMESTAMP_NTZ)"}),
    "touch_market_ai_cache": (f"status = 'done' AND tm + INTERVAL 12 DAY > {LATE}", {"attempts": "attempts + 1", "stamp": LATE}),
    "update_shadow_outcome_status": ("status IN ('pending', 'running') AND opt IS NOT NULL", {"status": "CASE WHEN opt >= 40 THEN 'resolved_correct' ELSE 'resolved_wrong' END", "stamp": "tm"}),
    "finish_unified_run": ("status = 'running'", {"status": "'done'", "v": "round(v + 1, 6)", "stamp": NEXT}),
}
CHANGED = ("status", "attempts", "stamp", "v")


def _update(guard: str, sets: dict):
    """Every row with the columns that the statement may write: those inside the guard changed, the others as they were."""

    def run(t):
        return state.updated(_log(t), F.expr(guard), {c: F.expr(e) for c, e in sets.items()}).select("id", *CHANGED)

    cols = [f"CASE WHEN {guard} THEN {sets[c]} ELSE {c} END AS {c}" if c in sets else c for c in CHANGED]
    return run, f"WITH log AS ({LOG}) SELECT id, {', '.join(cols)} FROM log"


# ---------------------------------------------------------------- point reads: all asked keys in one join

#: name: (asked keys, table with `key`).
READS = {
    "get_trader_by_wallet": ("SELECT DISTINCT k % 40 AS key FROM {log}", "SELECT k AS key, min(tm) AS first_seen, max(tm) AS last_seen FROM {log} GROUP BY k"),
    "get_trader_by_id": ("SELECT DISTINCT id AS key FROM {log} WHERE id % 50 = 0", "SELECT id AS key, k AS wallet, tm FROM {log}"),
    "get_alert_by_id": ("SELECT DISTINCT id + 1 AS key FROM {log} WHERE id % 20 = 0", "SELECT id AS key, kind, status, v FROM {log} WHERE kind <> 'view'"),
    "get_alert_outcome_analysis": ("SELECT DISTINCT k AS key FROM {log}", "SELECT k AS key, count(*) AS versions, max(v) AS score FROM {log} WHERE status = 'done' GROUP BY k"),
    "get_category_by_external_id": ("SELECT DISTINCT kind AS key FROM {log}", "SELECT kind AS key, count(*) AS n FROM {log} WHERE v >= 10 GROUP BY kind"),
    "get_event_page_fetch_state": ("SELECT DISTINCT k AS key FROM {log} WHERE k % 3 = 0", "SELECT k AS key, max(tm) AS fetched_at, count(*) AS fetches FROM {log} WHERE kind = 'click' GROUP BY k"),
    "get_market_close_review": ("SELECT DISTINCT k AS key FROM {log} WHERE k % 2 = 0", "SELECT k AS key, max(tm) AS reviewed_at, count(*) AS n FROM {log} WHERE status = 'done' GROUP BY k"),
    "get_market_by_condition": ("SELECT DISTINCT concat('c', CAST(k AS STRING)) AS key FROM {log} WHERE id % 9 = 0", "SELECT concat('c', CAST(k AS STRING)) AS key, min(tm) AS start_at FROM {log} GROUP BY 1"),
    "get_market_by_id": ("SELECT DISTINCT k * 2 AS key FROM {log}", "SELECT k AS key, max(v) AS liquidity FROM {log} GROUP BY k"),
    "get_event_news_fingerprint": ("SELECT DISTINCT k % 60 AS key FROM {log}", "SELECT k AS key, sha2(concat(min(kind), max(kind)), 256) AS fingerprint, max(tm) AS changed_at FROM {log} GROUP BY k"),
    "get_news_processed_item": ("SELECT DISTINCT concat(kind, CAST(k % 100 AS STRING)) AS key FROM {log} WHERE id % 5 = 0", "SELECT concat(kind, CAST(k % 100 AS STRING)) AS key, count(*) AS times FROM {log} WHERE id % 2 = 0 GROUP BY 1"),
    "get_live_market_state": ("SELECT DISTINCT k AS key FROM {log} WHERE kind = 'error'", "SELECT k AS key, max(tm) AS updated_at, max(opt) AS best FROM {log} WHERE kind = 'view' GROUP BY k"),
    "get_daily_report": ("SELECT DISTINCT CAST(tm AS DATE) AS key FROM {log}", "SELECT CAST(tm AS DATE) AS key, count(*) AS items FROM {log} WHERE v > 99 GROUP BY 1"),
    "get_prediction_usefulness": ("SELECT DISTINCT k AS key FROM {log} WHERE k % 4 = 0", "SELECT k AS key, round(avg(v), 6) AS score FROM {log} WHERE status <> 'failed' GROUP BY k"),
    "get_market_prediction": ("SELECT DISTINCT k AS key FROM {log} WHERE k % 4 = 1", "SELECT k AS key, max(v) AS confidence, max(tm) AS touched_at FROM {log} WHERE kind = 'purchase' GROUP BY k"),
    "get_semantic_dedupe": ("SELECT DISTINCT k % 100 AS key FROM {log}", "SELECT k % 100 AS key, count(*) AS send_count, max(tm) AS last_sent FROM {log} WHERE status = 'sent' GROUP BY 1"),
}


def _read(keys: str, table: str):
    text = f"SELECT q.key, s.key IS NOT NULL AS found, s.* FROM ({keys}) q LEFT JOIN ({table}) s ON s.key = q.key"

    def run(t):
        log = _log(t)
        return t.spark.sql(keys, log=log).alias("q").join(t.spark.sql(table, log=log).withColumnRenamed("key", "_k"), F.col("q.key") == F.col("_k"), "left").withColumn("found", F.col("_k").isNotNull()).drop("_k")

    text = text.replace("s.*", "s.* EXCLUDE (key)").replace("{log}", "log").replace("sha2(", "sha256(").replace(", 256)", ")")
    return run, f"WITH log AS ({LOG}) {text}"


# ---------------------------------------------------------------- lists

TOP = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS r FROM {{log}} WHERE {where}) AS x WHERE r <= {n}"


def _top(cols: str, by: str, order: str, where: str = "true", n: int = 1) -> str:
    return TOP.format(cols=cols, by=by, order=order, where=where, n=n)


LISTS = {
    "claim_undetected_trades": f"SELECT id, k, attempts + 1 AS attempts, {LATE} AS claimed_at FROM {{log}} WHERE status IN ('pending', 'failed') AND (stamp IS NULL OR stamp < {LATE} - INTERVAL 10 DAY) ORDER BY tm DESC, id DESC LIMIT 200",
    "claim_realtime_work": f"SELECT id, k, kind, attempts + 1 AS attempts FROM {{log}} WHERE status IN ('pending', 'running') AND (status = 'pending' OR tm + INTERVAL 5 DAY < {LATE}) AND attempts < 3 ORDER BY attempts, tm, id LIMIT 200",
    "list_event_catalysts": _top("event, id, kind, tm", "k % 50", "tm, id", "true", 20).replace("SELECT *,", "SELECT *, k % 50 AS event,"),
    "list_active_event_catalysts": _top("event, id, kind, status, tm", "k % 50", "v DESC, id", f"status IN ('pending', 'running') AND tm >= {EARLY}", 20).replace("SELECT *,", "SELECT *, k % 50 AS event,"),
    "count_predictions_since": f"SELECT count(*) AS n FROM {{log}} WHERE kind = 'view' AND tm >= {LATE}",
    "count_predictions_for_event_since": f"SELECT k % 50 AS event, count(*) AS n FROM {{log}} WHERE kind = 'view' AND tm >= {LATE} GROUP BY k % 50",
    "latest_alert_analysis": "SELECT k AS alert, version, id, status, v, tm FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tm, id) AS version, row_number() OVER (PARTITION BY k ORDER BY tm DESC, id DESC) AS r FROM {log} WHERE kind = 'click') AS x WHERE r = 1",
    "insert_alert_analysis": "SELECT id, k AS alert, v, coalesce(old, 0) + row_number() OVER (PARTITION BY k ORDER BY id) AS version FROM {log} LEFT JOIN (SELECT k AS _k, count(*) AS old FROM {log} WHERE id % 10 = 0 GROUP BY k) AS o ON k = _k WHERE id % 10 <> 0",
    "get_market_ai_cache": f"SELECT kind AS surface, k AS cache_key, id, v FROM (SELECT *, row_number() OVER (PARTITION BY kind, k ORDER BY tm DESC, id) AS r FROM {{log}}) AS x WHERE r = 1 AND tm + INTERVAL 3 DAY > {LATE}",
    "alerts_for_reaction": "SELECT id, status, stamp FROM {log} WHERE status IN ('pending', 'failed') AND kind <> 'view' ORDER BY stamp DESC NULLS LAST, id LIMIT 100",
    "stale_work_deleted": f"SELECT kind, count(*) AS n, min(tm) AS oldest FROM {{log}} WHERE tm >= {LATE} GROUP BY kind",
    "latest_intelligence_report": _top("kind, id, tm", "kind", "tm DESC, id"),
    "latest_report_by_period": _top("period, id, status, tm", "CAST(tm AS DATE)", "tm DESC, id", "status = 'sent'").replace("SELECT *,", "SELECT *, CAST(tm AS DATE) AS period,"),
    "active_risk_score": _top("k, id, v, tm", "k", "tm DESC, id", "status <> 'failed'"),
    "active_risk_score_of_condition": _top("condition, id, v", "k % 50", "tm DESC, id", "status IN ('done', 'sent')").replace("SELECT *,", "SELECT *, k % 50 AS condition,"),
    "risk_score_candidates": "SELECT m.k, s.scored_at FROM (SELECT DISTINCT k FROM {log}) m LEFT JOIN (SELECT k, max(tm) AS scored_at FROM {log} WHERE kind = 'error' GROUP BY k) s ON m.k = s.k ORDER BY s.scored_at NULLS FIRST, m.k LIMIT 100",
    "repricing_triggers": f"SELECT id, k, tm FROM {{log}} WHERE kind = 'purchase' AND tm >= {LATE} ORDER BY tm, id LIMIT 200",
    "recent_decisions_of_condition": _top("k, id, tm, status", "k", "tm DESC, id", f"tm >= {EARLY}", 5),
    "repricing_windows_open": f"SELECT id, k, tm FROM {{log}} WHERE status = 'running' AND tm + INTERVAL 1 DAY <= {LATE} ORDER BY tm, id LIMIT 200",
    "bookbar_candidates": "SELECT k, kind, max(tm) AS newest FROM {log} WHERE status <> 'failed' GROUP BY k, kind ORDER BY newest DESC, k, kind LIMIT 100",
    "recent_book_feature_bars": _top("k, kind, id, v", "k, kind", "tm DESC, id", f"tm >= {EARLY}", 3),
    "enabled_categories": "SELECT kind, count(*) AS n FROM {log} WHERE status IN ('done', 'sent') GROUP BY kind ORDER BY kind",
    "all_categories": "SELECT kind, min(id) AS id FROM {log} GROUP BY kind ORDER BY id",
    "recent_news_runs": "SELECT id, status, tm FROM {log} WHERE kind = 'click' ORDER BY tm DESC, id LIMIT 50",
    "news_decisions_by_run": "SELECT k AS run, id, row_number() OVER (PARTITION BY k ORDER BY v DESC, id) AS rank FROM {log} WHERE kind = 'click'",
    "latest_ranking_of_period": "SELECT period, k, rank FROM (SELECT CAST(tm AS DATE) AS period, k, row_number() OVER (PARTITION BY CAST(tm AS DATE) ORDER BY v DESC, id) AS rank FROM {log}) AS x WHERE rank <= 10",
    "predictions_for_archival": f"SELECT id, status, tm FROM {{log}} WHERE status IN ('done', 'failed') AND stamp IS NULL AND tm < {LATE} ORDER BY tm, id LIMIT 200",
    "predictions_for_stale_signal": f"SELECT id, status, tm FROM {{log}} WHERE status NOT IN ('done', 'failed') AND tm < {EARLY} ORDER BY tm, id LIMIT 200",
    "horizons_recorded": "SELECT DISTINCT k AS prediction, kind AS horizon FROM {log} WHERE opt IS NOT NULL",
    "predictions_for_feedback": f"SELECT id, status, tm FROM {{log}} WHERE status IN ('pending', 'running', 'sent') AND tm <= {LATE} ORDER BY tm, id LIMIT 200",
    "top_usefulness": "SELECT s.k, s.score, p.newest FROM (SELECT k, round(avg(v), 6) AS score FROM {log} GROUP BY k) s JOIN (SELECT k, max(tm) AS newest FROM {log} WHERE status <> 'failed' GROUP BY k) p ON s.k = p.k ORDER BY s.score DESC, p.newest DESC, s.k LIMIT 50",
    "prediction_state_history": _top("k, id, status, tm", "k", "tm DESC, id", "true", 10),
    "repricing_signals_of_event": "SELECT event, id, stamp FROM (SELECT k % 50 AS event, id, stamp, row_number() OVER (PARTITION BY k % 50 ORDER BY stamp DESC NULLS LAST, id) AS r FROM {log}) AS x WHERE r <= 20",
    "processed_hashes_known": "SELECT DISTINCT sha2(concat(kind, CAST(k % 100 AS STRING)), 256) AS item_hash FROM {log} WHERE id % 2 = 0 AND k % 100 IN (SELECT k % 100 FROM {log} WHERE id % 2 = 1)",
}

#: Lists over the trade domain: (common tables in SQL, relations, statement).
DOMAIN_LISTS = {
    "alerts_for_drift": (ALERTS_SQL, ("alerts",), "SELECT dedup_key, sent_at FROM {alerts} WHERE sent_at + INTERVAL 1 DAY <= TIMESTAMP_NTZ '2001-06-01 00:00:00' ORDER BY sent_at, dedup_key LIMIT 200"),
    "wallet_co_trade_rows": (ALERTS_SQL, ("trades", "markets"), "SELECT t.trader_id, m.event_id, t.side, t.traded_at, t.order_id, t.line_no FROM {trades} t JOIN {markets} m ON t.market_id = m.market_id WHERE t.traded_at >= TIMESTAMP_NTZ '2001-06-01 00:00:00' AND t.trader_id IS NOT NULL AND m.event_id IS NOT NULL"),
    "standalone_resolved_outcomes": (DECISIONS_SQL, {"decisions": "unmeasured"}, "SELECT dedup_key, outcome_status, CASE market_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' END AS winner FROM {decisions} WHERE linked_key IS NULL AND outcome_status <> 'unresolved'"),
    "markets_for_collection": (MARKETS_SQL, ("markets",), "SELECT market_id, start_at FROM {markets} WHERE market_id % 6 <> 1 AND n_trades >= 10"),
    "update_shadow_decision_values": (DECISIONS_SQL, {"decisions": "once"}, "SELECT dedup_key, round(coalesce(CASE WHEN market_id % 2 = 0 THEN CAST(1 AS DOUBLE) END, clv_15m), 6) + 0.0 AS clv_15m, round(clv_1h, 6) + 0.0 AS clv_1h, round(clv_6h, 6) + 0.0 AS clv_6h, CASE WHEN clv_15m IS NULL OR clv_1h IS NULL OR clv_6h IS NULL OR clv_24h IS NULL THEN 'partial' ELSE 'done' END AS state FROM {decisions}"),
    "candidate_replay": (ALERTS_SQL, ("alerts", "markets"), "SELECT a.severity, a.kind, CASE WHEN a.sent_at >= m.end_at - INTERVAL 60 DAY THEN 'late' ELSE 'early' END AS phase, count(*) AS n, round(sum(a.notional), 2) AS usd FROM {alerts} a JOIN {markets} m ON a.market_id = m.market_id GROUP BY 1, 2, 3"),
    "strategy_replay": (DECISIONS_SQL, ("decisions",), "SELECT strategy, level, count(*) AS n, count(clv_6h) AS measured, round(avg(clv_6h), 6) AS mean_cents, round(avg(CASE WHEN outcome_status = 'correct' THEN CAST(1 AS DOUBLE) WHEN outcome_status = 'wrong' THEN CAST(0 AS DOUBLE) END), 6) AS hit_rate FROM {decisions} GROUP BY strategy, level"),
    "cluster_distribution": (ALERTS_SQL, ("alerts",), "SELECT trades_in_day, count(*) AS clusters, max(wallets) AS most_wallets, round(max(usd), 2) AS largest FROM (SELECT category_id, sent_at, count(*) AS trades_in_day, count(DISTINCT trader_id) AS wallets, sum(notional) AS usd FROM {alerts} GROUP BY category_id, sent_at) AS x GROUP BY trades_in_day"),
}


def _list(text: str):
    run = lambda t: t.spark.sql(text, log=_log(t))
    return run, f"WITH log AS ({LOG}) " + text.replace("{log}", "log").replace("sha2(", "sha256(").replace(", 256)", ")")


def _domain_list(tables: str, relations: tuple | dict, text: str):
    # A relation may be read from a view of the domain that leaves out what the statement does not ask for.
    views = dict(relations) if isinstance(relations, dict) else {r: r for r in relations}
    run = lambda t: t.spark.sql(text, **{r: getattr(t, v) for r, v in views.items()})
    out = text
    for r in relations:
        out = out.replace("{" + r + "}", r)
    return run, f"WITH {tables} {out}"


# ---------------------------------------------------------------- inserts

#: name: columns of an append-only table.
INSERTS = {
    "insert_shadow_decision": {"strategy": "kind", "decision": "status", "subject": "k", "score": "v", "created_at": "tm"},
    "insert_repricing_window": {"condition": "k", "trigger_kind": "kind", "opened_at": "tm", "base_price": "v / 100"},
    "insert_promotion_review": {"strategy": "kind", "eligible": "v > 50", "reviewed_at": "tm", "samples": "attempts"},
    "insert_ai_request_log": {"surface": "kind", "tokens": "id % 1000", "cost": "v / 1000", "status": "status", "created_at": "tm"},
    "insert_event_page_snapshot": {"event": "k % 50", "hash": "txt", "captured_at": "tm"},
    "insert_event_page_market": {"snapshot": "id % 500", "condition": "k", "question": "txt", "price": "opt"},
    "insert_close_review_running": {"condition": "k", "status": "'running'", "started_at": "tm"},
    "insert_news_run": {"trigger_kind": "kind", "items": "attempts", "started_at": "tm"},
    "insert_news_decision": {"run": "k % 30", "rank": "attempts", "verdict": "status", "score": "v"},
    "insert_ws_event": {"asset": "kind", "market": "k", "price": "opt", "received_at": "tm"},
    "insert_gap_recovery": {"asset": "kind", "gap_from": "tm", "reason": "status"},
    "insert_prediction_transition": {"prediction": "k", "from_state": "status", "to_state": "kind", "changed_at": "tm"},
    "insert_price_snapshot": {"condition": "k", "price": "v / 100", "sampled_at": "tm"},
    "insert_repricing_thesis": {"event": "k % 50", "thesis": "txt", "confidence": "v / 100"},
    "insert_unified_decision": {"run": "k % 30", "condition": "k", "action": "status", "edge": "opt"},
    "insert_unified_run": {"trigger_kind": "kind", "status": "'running'", "started_at": "tm"},
}


def _insert(columns: dict):
    def run(t):
        """Two batches, the second delivered twice, through the writer; the table's rows as they are read back."""
        path = f"{scratch(t.spark)}/insert-{uuid.uuid4().hex}"
        d = _log(t).selectExpr("id", *[f"{e} AS {c}" for c, e in columns.items()])
        for batch in (0, 1, 1):
            sink.append(d.where(f"id % 2 = {batch}"), path, f"b{batch}")
        return t.spark.read.parquet(path).select("id", *columns)

    return run, f"WITH log AS ({LOG}) SELECT id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM log"


#: name: (key, columns) of tables where the first writer of a key wins.
FIRST_WINS = {
    "insert_intelligence_report": ({"period_key": "CAST(tm AS DATE)"}, {"body": "kind", "score": "v"}),
    "try_create_signal_report": ({"period": "CAST(tm AS DATE)", "surface": "kind"}, {"state": "'pending'", "first_id": "id", "score": "v"}),
    "insert_outcome_analysis": ({"alert": "k"}, {"verdict": "status", "created_at": "tm"}),
}


def _first(key: dict, columns: dict):
    def run(t):
        d = _log(t).selectExpr("id", *[f"{e} AS {c}" for c, e in key.items()], *[f"{e} AS {c}" for c, e in columns.items()])
        old, names = d.where("id % 10 = 0"), list(key)
        known = state.new_rows(old, old.limit(0), names, [F.col("id")])
        return known.unionByName(state.new_rows(d.where("id % 10 <> 0"), known, names, [F.col("id")])).drop("id")

    parts = ", ".join(f"{e} AS {c}" for c, e in {**key, **columns}.items())
    keys = ", ".join(key)
    return run, f"WITH log AS ({LOG}), d AS (SELECT id, {parts} FROM log) SELECT * EXCLUDE (id, r) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN id % 10 = 0 THEN 0 ELSE 1 END, id) AS r FROM d) WHERE r = 1"


for _table, _make in ((UPSERTS, _upsert), (UPDATES, _update), (READS, _read), (DOMAIN_LISTS, _domain_list), (FIRST_WINS, _first)):
    for _name, _spec in _table.items():
        _register(_name, *_make(*_spec))
for _table, _make in ((LISTS, _list), (INSERTS, _insert)):
    for _name, _spec in _table.items():
        _register(_name, *_make(_spec))
