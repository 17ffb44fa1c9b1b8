import random
from datetime import datetime, timedelta

from tradeflow.llm import warc

SCHEMA = "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>"
T0 = datetime(2024, 1, 1)


def brute(rows):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and r[1] is not None and x[1] is not None and r[2] is not None and x[2] is not None and x[1].rstrip("/").lower() == r[1].rstrip("/").lower() and x[2] < r[2]]
        if not before:
            out[r[0]] = (None, "orphan")
            continue
        x = max(before, key=lambda x: (x[2], x[0]))
        same = r[4] == x[4] if r[4] and x[4] else (r[5] is not None and r[5] == x[5])
        out[r[0]] = (x[0], "resolved") if same else (None, "mismatch")
    return out


def test_matches_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        url = "http://hot.example/" if r.random() < 0.5 else f"http://h{r.randrange(20)}.example/"
        rows.append((i, None if r.random() < 0.02 else url, None if r.random() < 0.02 else T0 + timedelta(minutes=r.randrange(200)), r.choice(["response", "revisit"]), r.choice([None, '"a"', '"b"']), r.choice([None, "x", "y"]), f"d{i}", {"ETag": "e", "Server": "s"}))
    want = brute(rows)
    for buckets in (4, 256):
        got = {x["record_id"]: (x["target_id"], x["outcome"]) for x in warc.resolved(spark.createDataFrame(rows, SCHEMA), buckets).collect()}
        assert got == want


def test_headers_merge(spark):
    rows = [(1, "http://www.a.b/c?utm_source=f&b=2&a=1#x", T0, "response", 'W/"q"', None, "dig", {"Server": "old", "Expires": "0", "Content-Type": "t"}),
            (2, "https://a.b/c/?a=1&b=2", T0 + timedelta(1), "revisit", '"q"', None, None, {"server": "new", "expires": "9", "Date": "d"})]
    x = warc.resolved(spark.createDataFrame(rows, SCHEMA)).first()
    assert (x["target_id"], x["outcome"], x["digest"]) == (1, "resolved", "dig")
    assert x["headers"] == {"server": "old", "expires": "9", "content-type": "t", "date": "d"}


def test_empty_table_and_repeats(spark):
    one = (1, "http://a.b/", T0, "revisit", None, None, None, None)
    assert warc.resolved(spark.createDataFrame([], SCHEMA)).count() == 0
    assert warc.resolved(spark.createDataFrame([one, one], SCHEMA)).count() == 2


def test_names_that_differ_in_case(spark):
    rows = [(1, "http://a.b/", T0, "response", '"q"', None, "dig", None), (2, "http://a.b/", T0 + timedelta(1), "revisit", '"q"', None, None, None)]
    heads = "if(record_id = 1, map('ETag', 'x', 'etag', 'y', 'Server', 's'), map('EXPIRES', '1', 'Expires', '2', 'expires', '3')) AS headers"
    d = spark.createDataFrame(rows, SCHEMA).drop("headers").selectExpr("*", heads)
    assert warc.resolved(d).first()["headers"] == {"etag": "y", "server": "s", "expires": "3"}


def test_clashing_columns_and_one_moment(spark):
    """All captures of a hot url at two moments; further columns named like those used inside."""
    rows = [(i, "http://hot/", T0 + timedelta(i % 2), "response" if i % 3 else "revisit", '"q"', None, f"d{i}", None) for i in range(300)]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _b", "2 AS canonical_url", "3 AS outcome", "4 AS target_id")
    got = {x["record_id"]: (x["target_id"], x["outcome"]) for x in warc.resolved(d).collect()}
    assert got == brute(rows)
