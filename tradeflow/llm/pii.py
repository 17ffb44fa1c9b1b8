"""Format-preserving pseudonyms for personal data (operator 2), in DataFrame functions only.

Values are found by pattern and validated: check digits of card and account numbers, octets up to 255, real
dates of 1900 to 2099, social security numbers of issued ranges; what fails stays as it is. Each value is
replaced by a keyed permutation of its own format, a Feistel network whose round function is SHA-256 of
key, kind, round and the other half. Equal values get equal pseudonyms in all documents, different ones
different pseudonyms, and the network run backwards with the key restores them. Pseudonyms are valid
where the values are. Letters of the local part of an address that are not ASCII stay.

At scale: no shuffle and no state; one pass over the text. Texts without a digit, an @ or a long
hexadecimal run skip the search. The key is an argument; plans hold a digest of it, not the key.

Null texts stay null, empty ones empty, with n_replaced 0; very long texts are searched whole. Repeated
rows, and rows of one id, are each replaced on their own; all columns but `text` and n_replaced stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
KINDS = {"email": EMAIL, "ip": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "iban": IBAN, "secret": SECRET, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
MAYBE = r"[0-9@]|[a-f]{32}|[A-F]{32}"
ROUNDS = 8

_DIGITS, _LOWER, _UPPER, _HEX_LOWER, _HEX_UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdef", "ABCDEF"


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once: as a lambda's variable it is not repeated where it is used."""
    return F.transform(F.array(value), use)[0]


def _hash(key: str, kind: str, r: Column, *half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), *[h.cast("string") for h in half]), 256)


def _number(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def _shift(c: Column, k: Column, alphabets: list[str]) -> Column:
    out = c
    for a in alphabets:
        at = F.call_function("instr", F.lit(a), c)
        out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + k, F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
    return out


def feistel_text(value: Column, kind: str, key: str, alphabets: list[str]) -> Column:
    """Permutes a string within its length and each character's class: halves swap, and each
    character of one half is shifted within its alphabet by the hash of the other."""
    half = F.floor(F.length(value) / 2).cast("int")

    def step(s, r):
        ks = F.concat(_hash(key, kind, r, F.lit(0), s["b"]), _hash(key, kind, r, F.lit(1), s["b"]))
        n = F.length(s["a"])
        char = lambda k, i: _shift(F.substring(s["a"], i, F.lit(1)), F.conv(F.substring(k, F.pmod(i - 1, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int"), alphabets)
        # Bound as a lambda's variable the hashes are worked out once a round, not once a character.
        chars = F.when(n > 0, _let(ks, lambda k: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: char(k, i)), "")))
        return F.struct(s["b"].alias("a"), F.coalesce(chars, F.lit("")).alias("b"))

    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    # An even number of rounds: the halves end on their own sides, so lengths and classes stay.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def feistel_pair(a: Column, b: Column, m: int, n: int, kind: str, key: str) -> Column:
    """Permutes Z_m x Z_n: the parts are shifted in turn by the hash of the other. Struct a, b."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s, r):
        x = F.pmod(s["a"] + _number(_hash(key, kind, r, F.lit("a"), s["b"])), F.lit(m).cast("long"))
        return F.struct(x.alias("a"), F.pmod(s["b"] + _number(_hash(key, kind, r, F.lit("b"), x)), F.lit(n).cast("long")).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)


def feistel_digits(value: Column, kind: str, key: str) -> Column:
    """Permutes a string of 2 to 36 digits within its length: the halves are numbers."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    tens = F.array(*[F.lit(10**i).cast("long") for i in range(19)])

    def step(s, r):
        x = F.pmod(s["a"] + _number(_hash(key, kind, r, s["b"])), F.get(tens, s["m"]))
        return F.struct(s["b"].alias("a"), x.alias("b"), s["k"].alias("m"), s["m"].alias("k"))

    start = F.struct(F.substring(value, F.lit(1), half).cast("long").alias("a"), F.substring(value, half + 1, n).cast("long").alias("b"), half.alias("m"), (n - half).alias("k"))
    digits = lambda c, m: F.lpad(c.cast("string"), m, F.lit("0"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(digits(s["a"], s["m"]), digits(s["b"], s["k"])))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """The digits put one by one where `shape` has digits."""
    s = F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("o"), F.lit(0).alias("i")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["o"], F.substring(digits, s["i"] + 1, F.lit(1))).alias("o"), (s["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["i"].alias("i"))),
    )
    return s["o"]


def luhn(body: Column) -> Column:
    """The check digit that body needs."""
    n = F.length(body)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when(F.pmod(n - i, F.lit(2)) == 0, _doubled(F.substring(body, i, F.lit(1)).cast("int"))).otherwise(F.substring(body, i, F.lit(1)).cast("int")))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _doubled(d: Column) -> Column:
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def _card(v: Column, key: str) -> Column:
    """Numbers of 13 to 19 digits with a right check digit; the new one is right as well."""
    d = _digits(v)
    body, last = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, F.length(d), F.lit(1)).cast("int")
    new = _let(feistel_digits(body, "card", key), lambda x: F.concat(x, luhn(x).cast("string")))
    return F.when(luhn(body) == last, _let(new, lambda x: _refill(v, x))).otherwise(v)


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001: permuted among those."""
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    issued = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = feistel_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999, "ssn", key)
    shown = lambda p: F.format_string("%03d-%02d-%04d", p["a"] + F.when(p["a"] >= 665, 2).otherwise(1), (p["b"] / 9_999).cast("long") + 1, p["b"] % 9_999 + 1)
    return F.when(issued, _let(p, shown)).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    d = _digits(v)
    n = F.length(d)
    return _let(F.concat(F.substring(d, F.lit(1), n - 10), feistel_digits(F.substring(d, n - 9, F.lit(10)), "phone", key)), lambda x: _refill(v, x))


def _ip(v: Column, key: str) -> Column:
    o = F.split(v, r"\.")
    part = lambda i: F.get(o, F.lit(i)).cast("int")
    p = feistel_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, "ip", key)
    new = lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])
    return F.when(F.forall(o, lambda x: x.cast("int") <= 255), _let(p, new)).otherwise(v)


def _date(v: Column, key: str) -> Column:
    iso = F.substring(v, 5, 1) == "-"
    slash = F.substring(v, 3, 1) == "/"
    y = F.when(iso, F.substring(v, 1, 4)).otherwise(F.substring(v, 7, 4)).cast("int")
    a, b = F.substring(v, 1, 2).cast("int"), F.substring(v, 4, 2).cast("int")
    # With slashes the month comes first unless only the other order is a date.
    first_month = slash & (a <= 12)
    m = F.when(iso, F.substring(v, 6, 2).cast("int")).when(first_month, a).otherwise(b)
    d = F.when(iso, F.substring(v, 9, 2).cast("int")).when(first_month, b).otherwise(a)
    text = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    real = F.try_to_date(text(y, m, d), "yyyy-MM-dd").isNotNull() & y.between(1900, 2099)
    leap = (m == 2) & (d == 29)
    p = feistel_pair(y - 1900, F.dayofyear(F.try_to_date(text(F.lit(2001), m, d), "yyyy-MM-dd")) - 1, 200, 365, "date", key)
    q = feistel_pair(F.floor((y - 1904) / 28), F.pmod(F.floor((y - 1904) / 4), F.lit(7)), 7, 7, "leap day", key)
    # A day-first date with slashes is known by its day over 12, and is permuted among those.
    late = slash & ~first_month
    before = F.array(*[F.lit(x) for x in (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)])  # days over 12 before each month
    u = feistel_pair(y - 1900, F.get(before, m - 1) + d - 13, 200, 221, "late date", key)
    late_month = lambda b: F.size(F.filter(before, lambda x: x <= b))
    made = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    new = (F.when(leap, _let(q, lambda q: made(1904 + 28 * q["a"] + 4 * q["b"], F.lit(2), F.lit(29))))
           .when(late, _let(u, lambda u: _let(late_month(u["b"]), lambda k: made(1900 + u["a"], k, u["b"] - F.get(before, k - 1) + 13))))
           .otherwise(_let(p, lambda p: _let(F.date_add(F.lit("2001-01-01").cast("date"), p["b"].cast("int")), lambda day: made(1900 + p["a"], F.month(day), F.dayofmonth(day))))))

    def shown(n):
        return (F.when(iso, F.format_string("%04d-%02d-%02d", n["y"], n["m"], n["d"]))
                .when(first_month, F.format_string("%02d/%02d/%04d", n["m"], n["d"], n["y"]))
                .when(slash, F.format_string("%02d/%02d/%04d", n["d"], n["m"], n["y"]))
                .otherwise(F.format_string("%02d.%02d.%04d", n["d"], n["m"], n["y"])))

    out = _let(new, shown)
    return F.when(real, out).otherwise(v)


def _mod97(s: Column) -> Column:
    val = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("^[0-9]$"), a * 10).otherwise(a * 100) + val(c), F.lit(97)))


def _iban(v: Column, key: str) -> Column:
    s = F.replace(v, F.lit(" "), F.lit(""))
    body = F.substring(s, F.lit(5), F.length(s))
    country = F.substring(s, 1, 2)
    valid = _mod97(F.concat(body, F.substring(s, 1, 4))) == 1
    check = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    flat = _let(feistel_text(body, "iban", key, [_DIGITS, _UPPER]), lambda new: F.concat(country, check(new), new))
    shown = lambda flat: F.when(F.instr(v, " ") > 0, F.trim(F.regexp_replace(flat, "(.{4})", "$1 "))).otherwise(flat)
    return F.when(valid, _let(flat, shown)).otherwise(v)


def digest(key: str) -> str:
    """What the networks are keyed with."""
    return hashlib.sha256(f"pseudonyms|{key}".encode()).hexdigest()


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one value; key is a digest()."""
    full = lambda p: v.rlike(f"^(?:{p})$")
    at = F.call_function("instr", v, F.lit("@"))
    local = feistel_text(F.substring(v, F.lit(1), at - 1), "email", key, [_DIGITS, _LOWER, _UPPER])
    return (
        F.when(at > 0, F.concat(local, F.substring(v, at, F.length(v))))
        .when(full(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), _ip(v, key))
        .when(full(DATE), _date(v, key))
        .when(full(SSN), _ssn(v, key))
        .when(full(PHONE), _phone(v, key))
        .when(full(IBAN), _iban(v, key))
        .when(full(SECRET), feistel_text(v, "secret", key, [_DIGITS, _HEX_LOWER, _HEX_UPPER]))
        .otherwise(_card(v, key))
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the values in `text` replaced, and n_replaced: how many were."""
    key = digest(key)
    keep = [c for c in docs.columns if c not in ("n_replaced", text)]
    t = F.col(text)

    def rebuilt(x):
        # Between two values stands one part of the text; all of them are bound once for the row.
        joined = lambda new: F.concat(F.get(x["parts"], F.lit(0)), F.array_join(F.zip_with(new, F.slice(x["parts"], 2, F.size(new)), lambda v, p: F.concat(v, p)), ""))
        changed = lambda new: F.size(F.filter(F.zip_with(x["found"], new, lambda a, b: a != b), lambda c: c))
        return F.when(F.size(x["found"]) > 0, _let(F.transform(x["found"], lambda v: pseudonym(v, key)), lambda new: F.struct(joined(new).alias("text"), changed(new).cast("long").alias("n"))))

    found = F.struct(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)).alias("found"), F.split(t, ANY, -1).alias("parts"))
    d = docs.withColumn("_new", F.when(t.rlike(MAYBE), _let(found, rebuilt)))
    # A generator of one row keeps the column from being worked out once for each use.
    d = d.withColumn("_new", F.explode(F.array("_new")))
    return d.select(*keep, F.coalesce("_new.text", t).alias(text), F.coalesce("_new.n", F.lit(0).cast("long")).alias("n_replaced"))
