"""Resolution of not-modified revisits (operator 5).

A revisit record (status 304) has no body. It is joined, by canonical URL, to the latest full
response captured before it; if the validators agree it takes that response's payload and
headers, with those headers that a 304 may update taken from the revisit.

At scale: bodies are never shuffled, only validators, digests and headers. A URL that holds any
share of the captures is cut at `buckets` quantiles of capture time; captures of one moment are one row
there. The last response is found within (url, bucket), and the last one of earlier buckets is carried over
by a window with one row per bucket.

Records without a URL or time resolve to nothing (`orphan`). Captures at the same moment are not
"earlier"; of several responses at one moment the one with the largest record id counts.
Repeated rows stay repeated. Header names are compared in lower case; of names that differ in case only, the
last one of the map counts. Bodies are no columns here, so very long ones do not matter; other columns
of `records` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import ascii_lower, cut

#: Header fields that a 304 response may carry and a cache updates from it.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical(url: Column) -> Column:
    """Scheme, www or m label, default ports, fragment, tracking parameters and a last slash go;
    the host is lower-cased and the other parameters are sorted."""
    u = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(u, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(ascii_lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(?:www|m)\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)="))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit(""))))


def lower_names(headers: Column) -> Column:
    """Lower-cased names; of equal ones the last."""
    e = F.transform(F.map_entries(headers), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    last = F.transform(F.array(e), lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])))[0]
    return F.map_from_entries(last)


def resolved(records: DataFrame, buckets: int = 256) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, target_id, outcome, digest, headers.

    records: record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, digest,
    headers map<string,string>. outcome: resolved; mismatch (validators differ or there are
    none); orphan (no earlier full response)."""
    r = records.select(
        "record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "digest",
        lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"))
    r = cut(r)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = r.where(F.col("ts").isNotNull()).agg(F.percentile_approx(at, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    usable = r.where(F.col("ts").isNotNull() & F.col("canonical_url").isNotNull())
    usable = usable.withColumn("_b", F.size(F.filter(bounds, lambda b: b <= at)).cast("int"))
    of = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    # One row per url and moment: its last response, null if it has none.
    points = usable.groupBy("canonical_url", "_b", "ts").agg(F.max_by(of, F.when(F.col("kind") == "response", F.col("record_id"))).alias("_here"), F.max(F.col("kind") == "response").alias("_any"))
    points = points.withColumn("_here", F.when(F.col("_any"), F.col("_here"))).drop("_any")
    last = points.where("_here is not null").groupBy("canonical_url", "_b").agg(F.max_by("_here", "ts").alias("_last"))
    # The last response of earlier buckets, for every bucket that has a row.
    seen = points.select("canonical_url", "_b").distinct().join(last, ["canonical_url", "_b"], "left")
    over = Window.partitionBy("canonical_url").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select("canonical_url", "_b", F.last("_last", ignorenulls=True).over(over).alias("_carried"))
    # Rows before that of the moment: only earlier responses count.
    within = Window.partitionBy("canonical_url", "_b").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    found = points.withColumn("_near", F.last("_here", ignorenulls=True).over(within)).drop("_here").join(carried, ["canonical_url", "_b"], "left")
    d = usable.where(F.col("kind") == "revisit").join(found, ["canonical_url", "_b", "ts"], "left")
    d = d.withColumn("_t", F.coalesce("_near", "_carried"))
    lost = r.where((F.col("kind") == "revisit") & (F.col("ts").isNull() | F.col("canonical_url").isNull()))
    d = d.unionByName(lost, allowMissingColumns=True)
    # A strong or weak etag decides where both have one, else the modification time.
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same = (F.when(F.col("etag").isNotNull() & F.col("_t.etag").isNotNull(), tag(F.col("etag")) == tag(F.col("_t.etag")))
            .otherwise(F.coalesce(F.col("last_modified") == F.col("_t.last_modified"), F.lit(False))))
    outcome = F.when(F.col("_t").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    ok = F.col("outcome") == "resolved"
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    base = F.map_filter("_t.headers", lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    return d.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", F.when(ok, F.col("_t.record_id")).alias("target_id"), "outcome",
        F.when(ok, F.col("_t.digest")).alias("digest"), F.when(ok, F.map_concat(base, updates)).otherwise(F.col("headers")).alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """WARC records laid over the pages table: every page is a full response, captured at a time
    given by its id, and is revisited a day later under another spelling of its URL. Every tenth
    revisit has a changed validator; every seventh response has no etag, only a date."""
    p = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + p * 60)
    modified = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + p), "yyyy-MM-dd HH:mm:ss")
    base = pages.select("page_id", "url", digest.alias("digest"), ts.alias("ts"), modified.alias("modified"),
                        F.when(p % 7 != 0, F.concat(F.lit('"'), digest, F.lit('"'))).alias("tag"))
    heads = lambda **k: F.map_filter(F.create_map(*[x for n, c in k.items() for x in (F.lit(n.replace("_", "-")), c)]), lambda k, v: v.isNotNull())
    response = base.select((p * 2).alias("record_id"), "url", "ts", F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.col("modified").alias("last_modified"), "digest",
                           heads(Content_Type=F.lit("text/html"), ETag=F.col("tag"), Server=F.lit("a"), Expires=F.lit("0")).alias("headers"))
    changed = p % 10 == 3
    tag = F.when(changed, F.lit('"changed"')).otherwise(F.col("tag"))
    revisit = base.select(
        (p * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "https://"), F.when(p % 2 == 0, F.lit("#again")).otherwise(F.lit(""))).alias("url"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"),
        F.when(changed, F.lit("later")).otherwise(F.col("modified")).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        heads(Date=F.date_format(F.col("ts"), "yyyy-MM-dd"), ETag=tag, Server=F.lit("b"), Expires=F.lit("60")).alias("headers"))
    return response.unionByName(revisit)
