"""Queries over text and JSON: rule risk, regimes, fingerprints, page fields, outcome mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.operators import detectors, state
from tradeflow.plans.named import query
from tradeflow.sources import records

#: Words of the driver's texts in place of the fixed ones, which do not occur there.
MARKERS = [("licensed", 0.45, "a", "procedural"), ("version", 0.20, "b", "procedural"), ("general", 0.20, "b", "procedural"), ("token", 0.10, "c", "wording"), ("released", 0.30, "d", "source")]
SOURCES = ["apache", "public license"]
REGIMES = {"first": [("licensed", 0.2), ("mit ", 0.1)], "second": [("version", 0.2), ("rights", 0.3)], "third": [("token", 0.4)]}

_HIT = lambda w: f"(CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END)"
_SUM = lambda m: " + ".join(f"{x} * {_HIT(w)}" for w, x in m)
_COUNT = lambda k: " + ".join(_HIT(w) for w, _, _, c in MARKERS if c == k)


@query(f"""SELECT doc_id, ambiguity, CASE WHEN ambiguity >= 0.7 THEN 'block_both' WHEN ambiguity >= 0.6 THEN 'block_cheap_tail' ELSE 'allow' END AS action, procedural, wording FROM (SELECT doc_id, p AS procedural, w AS wording, CAST(round(greatest(0, least(1, base + CASE WHEN p >= 3 THEN 0.10 WHEN p >= 2 THEN 0.05 ELSE 0 END - CASE WHEN named THEN 0.05 ELSE 0 END)), 6) AS DOUBLE) AS ambiguity FROM
  (SELECT doc_id, {_SUM([(w, x) for w, x, _, _ in MARKERS])} AS base, {_COUNT("procedural")} AS p, {_COUNT("wording")} AS w, {" OR ".join(f"contains(t, '{s}')" for s in SOURCES)} AS named FROM (SELECT doc_id, lower(text) AS t FROM documents)))""")
def rules_risk(t):
    d = detectors.rules_risk(t.table("documents"), ["text"], markers=MARKERS, sources=SOURCES)
    return d.select("doc_id", "ambiguity", "action", "procedural", "wording")


@query(f"""SELECT doc_id, CASE WHEN best < 0.2 THEN 'other' WHEN s3 = best THEN 'third' WHEN s2 = best THEN 'second' ELSE 'first' END AS regime, CAST(CASE WHEN best < 0.2 THEN 0 ELSE best END AS DOUBLE) AS regime_score FROM (SELECT *, greatest(s1, s2, s3) AS best FROM (SELECT doc_id, {", ".join(f"round({_SUM(m)}, 6) AS s{i}" for i, m in enumerate(REGIMES.values(), 1))} FROM (SELECT doc_id, lower(text) AS t FROM documents)))""")
def market_regime(t):
    return detectors.regime(t.table("documents"), ["text"], REGIMES).select("doc_id", "regime", "regime_score")


_SUM60 = lambda i: f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)"


@query(f"""SELECT source, lang, sha256(concat_ws('|', count(*), {", ".join(_SUM60(i) for i in range(4))})) AS fingerprint, count(*) AS n
  FROM (SELECT source, lang, sha256(concat_ws('|', trim(CAST(doc_id AS VARCHAR)), trim(CAST(n_chars AS VARCHAR)))) AS h FROM documents) GROUP BY ALL""")
def news_fingerprints(t):
    return state.fingerprint(t.table("documents"), ["source", "lang"], ["doc_id", "n_chars"])


@query("""SELECT user_id, event_id, changed, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS repeats FROM (SELECT *, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT user_id, event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS changed FROM events))""")
def change_detection(t):
    return state.changes(t.table("events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "changed", "repeats")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'track\((\d+)\)', 1) AS build, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def page_fields(t):
    return t.table("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r"track\((\d+)\)", 1).alias("build"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS INT))::BIGINT AS k FROM events GROUP BY event_type")
def event_properties(t):
    k = records.lenient_number(F.get_json_object("props", "$.k"))
    return t.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).cast("long").alias("k"))


@query("""SELECT event_id, CASE WHEN v IN ('view', 'click') THEN v WHEN lower(v) IN ('view', 'click') THEN lower(v) WHEN v = 'Sign Up' THEN 'view' END AS outcome, CASE WHEN v IN ('view', 'click') THEN 1.0 WHEN lower(v) IN ('view', 'click') THEN 0.85 WHEN v = 'Sign Up' THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence
  FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'signup' THEN 'Sign Up' ELSE event_type END AS v FROM events)""")
def outcome_mapping(t):
    """Labels to outcomes by a falling chain: exact, folded, group title, none."""
    v = F.when(F.col("event_type") == "click", "CLICK").when(F.col("event_type") == "signup", "Sign Up").otherwise(F.col("event_type"))
    return records.mapped_outcome(t.table("events").select("event_id", v.alias("label")), ["view", "click"], {"Sign Up": "view"}).select("event_id", "outcome", "confidence")


#: Markets with titles, outcomes and tokens over the suppliers; labels and tokens that ask for them over the events.
TITLED = """SELECT s_suppkey AS condition_id, s_nationkey AS event_id, concat('T', CAST(s_suppkey % 7 AS STRING)) AS title, CASE WHEN s_suppkey % 2 = 0 THEN array('Yes', 'No') ELSE array('Up', 'Down') END AS outcomes,
  array(concat('k', CAST(s_suppkey AS STRING), 'a'), concat('k', CAST(s_suppkey AS STRING), 'b')) AS tokens FROM {supplier}"""
ASKED = """SELECT event_id AS id, event_id % 12 + 1 AS condition_id, CASE user_id % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' Up ' WHEN 3 THEN 'T3' WHEN 4 THEN 't5' WHEN 5 THEN '' WHEN 6 THEN 'other' END AS label,
  CASE WHEN event_id % 9 = 0 THEN concat('k', CAST(user_id % 15 AS STRING), 'b') WHEN event_id % 9 = 1 THEN '' END AS token FROM {events}"""


@query("""SELECT id, asked_id, f.c AS condition_id, f.i AS outcome_index, f.o AS outcome, f.s AS confidence, f.r AS reason FROM (SELECT id, asked_id, CASE
    WHEN tc IS NOT NULL THEN {'c': tc, 'i': 1, 'o': tos[2], 's': 1.0, 'r': 'token_match'} WHEN outcomes IS NULL THEN {'c': NULL, 'i': NULL, 'o': NULL, 's': 0.0, 'r': 'unknown_condition_id'}
    WHEN l = '' THEN {'c': asked_id, 'i': 0, 'o': outcomes[1], 's': 0.6, 'r': 'binary_default'} WHEN list_contains(outcomes, l) THEN {'c': asked_id, 'i': list_position(outcomes, l) - 1, 'o': l, 's': 1.0, 'r': 'exact_label'}
    WHEN lower(l) IN (lower(outcomes[1]), lower(outcomes[2])) THEN {'c': asked_id, 'i': CASE WHEN lower(l) = lower(outcomes[1]) THEN 0 ELSE 1 END, 'o': CASE WHEN lower(l) = lower(outcomes[1]) THEN outcomes[1] ELSE outcomes[2] END, 's': 0.85, 'r': 'case_insensitive_label'}
    WHEN lower(l) = lower(title) THEN {'c': asked_id, 'i': 0, 'o': outcomes[1], 's': 0.7, 'r': 'group_item_title'} WHEN sc IS NOT NULL THEN {'c': sc, 'i': 0, 'o': so[1], 's': 0.7, 'r': 'group_item_title'}
    ELSE {'c': NULL, 'i': NULL, 'o': NULL, 's': 0.0, 'r': 'label_not_found'} END AS f
  FROM (SELECT a.id, a.condition_id AS asked_id, coalesce(trim(a.label), '') AS l, m.*, k.condition_id AS tc, k.outcomes AS tos, s.condition_id AS sc, s.outcomes AS so FROM asked a LEFT JOIN titled m ON m.condition_id = a.condition_id
    LEFT JOIN titled k ON k.tokens[2] = a.token LEFT JOIN (SELECT event_id AS e, lower(title) AS t, min(condition_id) AS condition_id, arg_min(outcomes, condition_id) AS outcomes FROM titled GROUP BY 1, 2) s ON s.e = m.event_id AND s.t = lower(trim(a.label))))""",
       f"titled AS ({TITLED.replace('array(', 'list_value(').replace('{supplier}', 'supplier')}), asked AS ({ASKED.replace('{events}', 'events')})")
def outcomes_resolved(t):
    """Which outcome of which market a label or token means, with the way it was found."""
    markets, asked = t.spark.sql(TITLED, supplier=t.table("supplier")), t.spark.sql(ASKED, events=t.table("events"))
    return records.resolved_outcomes(asked, markets).select("id", "asked_id", "condition_id", "outcome_index", "outcome", "confidence", "reason")
