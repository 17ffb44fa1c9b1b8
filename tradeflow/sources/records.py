"""Parsing of records whose fields drift: numbers as strings, arrays as JSON strings, stream events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = "array<struct<price:string,size:string>>"
#: A line of the feed; unknown fields are ignored, missing ones are null.
EVENT_SCHEMA = f"event_type string, asset_id string, market string, bids {LEVEL}, asks {LEVEL}, price string, size string, side string, best_bid string, best_ask string, timestamp string, hash string"


def lenient_number(c: Column) -> Column:
    """A number or a string of one; null otherwise."""
    return F.trim(c.cast("string")).try_cast("double")


def lenient_bool(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1", "yes", "t"), True).when(s.isin("false", "0", "no", "f", ""), False)


def string_array(c: Column) -> Column:
    """An array that arrives as a JSON string; an empty array where it does not parse."""
    return F.coalesce(F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def event_time(c: Column) -> Column:
    """Milliseconds, or seconds below 1e12."""
    n = c.try_cast("double")
    return F.timestamp_micros(F.when(n < 1e12, n * 1_000_000).otherwise(n * 1_000).cast("long"))


def feed_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON to typed events with best bid, best ask and mid; lines that do not parse are kept with a null type.

    Best is the highest bid and the lowest ask of the levels, else what the event itself says."""
    e = lines.select(F.from_json(F.col(value), EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    price = lambda levels: F.transform(levels, lambda x: x["price"].try_cast("double"))
    bid = F.coalesce(F.array_max(price(F.col("bids"))), F.col("best_bid").try_cast("double"))
    ask = F.coalesce(F.array_min(price(F.col("asks"))), F.col("best_ask").try_cast("double"))
    e = e.withColumns({"bid": bid, "ask": ask, "at": event_time(F.col("timestamp")), "last": F.when(F.col("event_type") == "last_trade_price", F.col("price").try_cast("double"))})
    return e.withColumn("mid", F.when(F.col("bid").isNotNull() & F.col("ask").isNotNull(), (F.col("bid") + F.col("ask")) / 2))


def event_markets(pages: DataFrame, value: str = "value") -> DataFrame:
    """Markets of an event page: its queries hold lists of markets with arrays as JSON strings."""
    schema = "pageProps struct<dehydratedState:struct<queries:array<struct<state:struct<data:struct<markets:array<struct<conditionId:string,question:string,outcomes:string,outcomePrices:string,clobTokenIds:string>>>>>>>>"
    q = pages.select(F.from_json(F.col(value), schema).alias("p")).select(F.explode("p.pageProps.dehydratedState.queries").alias("q"))
    m = q.select(F.explode("q.state.data.markets").alias("m")).select("m.*")
    return m.select("conditionId", "question", string_array(F.col("outcomes")).alias("outcomes"), F.transform(string_array(F.col("outcomePrices")), lambda x: x.try_cast("double")).alias("prices"), string_array(F.col("clobTokenIds")).alias("tokens"))


def mapped_outcome(d: DataFrame, outcomes: list[str], titles: dict[str, str], label: str = "label") -> DataFrame:
    """Adds outcome and confidence: exact 1, same but for case 0.85, by group title 0.7, else none 0."""
    c = F.col(label)
    exact, fold, title = c.isin(*outcomes), F.lower(c).isin(*[o.lower() for o in outcomes]), c.isin(*titles)
    folded = F.element_at(F.create_map(*[x for o in outcomes for x in (F.lit(o.lower()), F.lit(o))]), F.lower(c))
    titled = F.element_at(F.create_map(*[x for k, v in titles.items() for x in (F.lit(k), F.lit(v))]), c)
    return d.withColumns({"outcome": F.when(exact, c).when(fold, folded).when(title, titled), "confidence": F.when(exact, 1.0).when(fold, 0.85).when(title, 0.7).otherwise(0.0)})


def resolved_outcomes(asked: DataFrame, markets: DataFrame) -> DataFrame:
    """asked with condition, outcome_index, outcome, confidence and reason of the market's outcome it means.

    asked: condition_id, label, token (null or empty: not given). markets, a row a condition_id: event_id, title, outcomes
    and tokens (arrays of one order). A known token decides (1). Else the label: none means the first outcome (0.6), then
    exact (1), same but for case (0.85), the market's own title (0.7) and the title of the event's market of smallest
    condition (0.7). Nothing is guessed beyond that. Three equi-joins on keys, no candidates in between."""
    m = markets.select("condition_id", "event_id", F.lower(F.trim("title")).alias("_title"), "outcomes", "tokens")
    a = asked.withColumns({"_label": F.coalesce(F.trim("label"), F.lit("")), "_token": F.nullif(F.trim("token"), F.lit(""))})
    held = m.select(F.col("condition_id").alias("_tc"), F.col("outcomes").alias("_to"), F.posexplode("tokens").alias("_ti", "_key")).withColumn("_key", F.nullif(F.trim("_key"), F.lit("")))
    held = held.where("_key is not null").groupBy("_key").agg(F.min(F.struct("_tc", "_ti", "_to")).alias("_t"))
    d = a.join(held, F.col("_token") == F.col("_key"), "left").join(m, "condition_id", "left")
    first = m.where("_title <> ''").groupBy(F.col("event_id").alias("_se"), F.col("_title").alias("_st")).agg(F.min(F.struct("condition_id", "outcomes")).alias("_s"))
    d = d.join(first, (F.col("event_id") == F.col("_se")) & (F.lower("_label") == F.col("_st")), "left")
    trimmed = F.transform("outcomes", F.trim)
    exact = F.array_position(trimmed, F.col("_label"))
    fold = F.array_position(F.transform(trimmed, F.lower), F.lower("_label"))
    answer = lambda c, i, o, sure, why: F.struct(c.alias("c"), i.cast("int").alias("i"), F.get(o, i.cast("int")).alias("o"), F.lit(sure).alias("s"), F.lit(why).alias("r"))
    here, none = F.col("condition_id"), F.lit(None)
    found = F.when(F.col("_t").isNotNull(), answer(F.col("_t._tc"), F.col("_t._ti"), F.col("_t._to"), 1.0, "token_match"))
    found = found.when(F.col("outcomes").isNull(), answer(none.cast(asked.schema["condition_id"].dataType), none, F.array(F.lit("")), 0.0, "unknown_condition_id"))
    found = found.when(F.col("_label") == "", answer(here, F.lit(0), F.col("outcomes"), 0.6, "binary_default"))
    found = found.when(exact > 0, answer(here, exact - 1, F.col("outcomes"), 1.0, "exact_label")).when(fold > 0, answer(here, fold - 1, F.col("outcomes"), 0.85, "case_insensitive_label"))
    found = found.when(F.lower("_label") == F.col("_title"), answer(here, F.lit(0), F.col("outcomes"), 0.7, "group_item_title"))
    found = found.when(F.col("_s").isNotNull(), answer(F.col("_s.condition_id"), F.lit(0), F.col("_s.outcomes"), 0.7, "group_item_title"))
    found = found.otherwise(answer(none.cast(asked.schema["condition_id"].dataType), none, F.array(F.lit("")), 0.0, "label_not_found"))
    d = d.withColumn("_f", found)
    own = [c for c in asked.columns if c != "condition_id"]
    return d.select(F.col("condition_id").alias("asked_id"), *own, F.col("_f.c").alias("condition_id"), F.col("_f.i").alias("outcome_index"), F.col("_f.o").alias("outcome"), F.col("_f.s").alias("confidence"), F.col("_f.r").alias("reason"))
