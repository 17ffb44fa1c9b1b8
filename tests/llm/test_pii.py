import hashlib
import re

from tradeflow.llm import pii


def run(spark, texts, key="k"):
    d = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key)
    return {r["doc_id"]: (r["text"], r["n_replaced"]) for r in d.collect()}


def luhn_ok(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 if x > 4 else x * 2 for x in d[1::2])) % 10 == 0


CASES = ["mail re.55@mail4.example.com now", "ip 97.51.17.173 end", "call +1 (017) 555-7713 or", "card 4111 1111 1111 1111.", "raw 9807915762804495 x", "born 1984-02-29 and 12/25/2001 and 25/12/2001 and 03.04.1999",
         "ssn 123-45-6789", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "iban GB82 WEST 1234 5698 7654 32"]


def test_formats_stay_and_values_go(spark):
    got = run(spark, CASES)
    for i, t in enumerate(CASES):
        new, n = got[i]
        assert n >= 1 and new != t
        if i not in (1, 5):
            assert re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t)))
    assert luhn_ok(got[3][0]) and luhn_ok(got[4][0])
    assert all(0 <= int(x) <= 255 for x in re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+)", got[1][0]).groups())
    assert re.search(r"born \d{4}-02-29 ", got[5][0])
    iban = re.sub(" ", "", got[8][0][5:])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_linked_across_documents_and_keyed(spark):
    t = ["a 9807915762804495 b", "x 9807915762804495!! y", "other 4111111111111111"]
    got, other = run(spark, t), run(spark, t, "another key")
    num = lambda s: re.search(r"\d{16}", s[0]).group()
    assert num(got[0]) == num(got[1]) != num(got[2])
    assert num(got[0]) != num(other[0])


def test_permutations_have_no_collisions(spark):
    from pyspark.sql import functions as F

    n = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert n.select(pii.feistel_text(F.col("v"), "t", "k", ["0123456789"]).alias("p")).distinct().count() == 10_000
    d = spark.range(200 * 365).select(pii.feistel_pair((F.col("id") / 365).cast("int"), F.col("id") % 365, 200, 365, "d", "k").alias("p"))
    assert d.distinct().count() == 200 * 365
    late = spark.sql("select date_format(d, 'dd/MM/yyyy') v from (select explode(sequence(date'1900-01-01', date'2099-12-31')) d) where day(d) > 12")
    out = late.select(pii.pseudonym(F.col("v"), "k").alias("p"))
    assert out.distinct().count() == late.count() and out.where("int(substring(p, 1, 2)) <= 12").count() == 0


def test_odd_inputs(spark):
    got = run(spark, [None, "", "no value here", "999.1.2.3 and 2001-13-45", "@", "1" * 5000, "GB00 WEST 1234 5698 7654 32"])
    assert got[0] == (None, 0) and got[1] == ("", 0) and got[2] == ("no value here", 0)
    assert got[3][0] == "999.1.2.3 and 2001-13-45" and got[4] == ("@", 0)
    assert re.fullmatch(r"[0-9]{5000}", got[5][0]) and got[6] == ("GB00 WEST 1234 5698 7654 32", 0)
    d = spark.createDataFrame([(1, "x@y.com", 5)], "doc_id long, text string, n_replaced long")
    assert pii.pseudonymised(d, "k").columns == ["doc_id", "text", "n_replaced"]


def number(key, kind, *parts):
    return int(hashlib.sha256("|".join(map(str, (key, kind, *parts))).encode()).hexdigest()[:12], 16)


def digits(v, kind, key, back=False):
    """The network on digits, forwards and backwards, plainly."""
    a, b, m, k = int(v[: len(v) // 2]), int(v[len(v) // 2 :]), len(v) // 2, len(v) - len(v) // 2
    for r in range(1, pii.ROUNDS + 1):
        if back:
            r = pii.ROUNDS + 1 - r
            a, b, m, k = (b - number(key, kind, r, a)) % 10**k, a, k, m
        else:
            a, b, m, k = b, (a + number(key, kind, r, b)) % 10**m, k, m
    return f"{a:0{m}d}{b:0{k}d}"


def shifted(v, kind, key, back=False):
    """The network on letters and digits by class, likewise."""
    def turn(half, other, r, sign):
        ks = "".join(hashlib.sha256("|".join(map(str, (key, kind, r, j, other))).encode()).hexdigest() for j in (0, 1))
        out = ""
        for i, c in enumerate(half):
            x = int(ks[i % 64 * 2 : i % 64 * 2 + 2], 16) * sign
            own = next((s for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in s), None)
            out += own[(own.index(c) + x) % len(own)] if own else c
        return out

    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    for r in range(1, pii.ROUNDS + 1):
        if back:
            a, b = turn(b, a, pii.ROUNDS + 1 - r, -1), a
        else:
            a, b = b, turn(a, b, r, 1)
    return a + b


def test_networks_match_the_plain_ones_and_run_backwards(spark):
    import random

    r = random.Random(3)
    key = pii.digest("k")
    cards = ["".join(r.choice("0123456789") for _ in range(r.randrange(12, 19))) for _ in range(60)]
    names = ["".join(r.choice("abcXYZ019._é") for _ in range(r.randrange(1, 140))) for _ in range(60)]
    d = spark.createDataFrame(list(zip(cards, names, strict=True)), "c string, n string")
    for x in d.select("c", "n", pii.feistel_digits(d["c"], "card", key).alias("pc"), pii.feistel_text(d["n"], "email", key, ["0123456789", pii._LOWER, pii._UPPER]).alias("pn")).collect():
        assert x["pc"] == digits(x["c"], "card", key) and digits(x["pc"], "card", key, True) == x["c"]
        assert x["pn"] == shifted(x["n"], "email", key) and shifted(x["pn"], "email", key, True) == x["n"]


def test_only_valid_numbers_are_replaced(spark):
    left = ["order 1234567890123456", "at 1700000000000", "isbn 9780306406157", "ssn 000-00-0000", "ssn 666-12-3456", "ssn 900-12-3456", "ip 1.2.3.256", "on 2023-02-30"]
    got = run(spark, left)
    assert [got[i] for i in range(len(left))] == [(t, 0) for t in left]
    got = run(spark, ["ssn 123-45-6789", "Über.müller7@x.de"])
    area, group, serial = map(int, got[0][0][4:].split("-"))
    assert 1 <= area <= 899 and area != 666 and group > 0 and serial > 0 and got[0][1] == 1
    assert re.fullmatch(r"Ü[a-z]{3}\.[a-z]ü[a-z]{4}[0-9]@x\.de", got[1][0]) and got[1][1] == 1


def test_rows_without_an_id_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a@b.de", 1), (3, "a@b.de", 2), (3, "a@b.de", 2), (3, None, 2)], "doc_id long, text string, found int")
    got = pii.pseudonymised(d, "k")
    assert got.columns == ["doc_id", "found", "text", "n_replaced"]
    assert [r["n_replaced"] for r in got.collect()] == [1, 1, 1, 0] and got.select("text").distinct().count() == 2
    assert pii.pseudonymised(d.limit(0), "k").count() == 0
