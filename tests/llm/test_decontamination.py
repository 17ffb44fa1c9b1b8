import random

import pytest

from tradeflow.llm import decontamination as dc


def finder(items):
    return dc.Finder(items, 0.1, 5, 20, 4, 11, 0.2)


def distance(a, b):
    """Least edits of a to a stretch of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_infix_distance_is_exact():
    r = random.Random(1)
    for _ in range(200):
        a = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(0, 25)))
        most = r.randrange(0, 6)
        want = distance(a, b)
        assert dc.infix_distance(a, b, most)[0] == (want if want <= most else most + 1)


def test_gram_count_loses_no_stretch():
    r = random.Random(5)
    for _ in range(300):
        a = "".join(r.choice("abcdé") for _ in range(r.randrange(24, 80)))
        most, z = int(0.1 * len(a)), list(a)
        for _ in range(most):
            p = r.randrange(len(z))
            z[p : p + 1] = r.choice([[], ["x"], [z[p], "y"]])
        held = [a[i : i + dc.CHARS] for i in range(len(a) - dc.CHARS + 1)]
        assert dc.can_hold(held, "some " + "".join(z) + " more", most)
    assert not dc.can_hold(held, "the the the the the the the the the the the the", most)


@pytest.fixture(scope="module")
def world():
    r = random.Random(7)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ed", "nd", "ha"]) for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randrange(15, 60))) for i in range(120)]
    docs, truth = [], set()
    for i, t in items:
        z = list(t)
        for _ in range(int(r.choice([0, 0.03, 0.06, 0.08]) * len(t))):
            p = r.randrange(len(z))
            z[p : p + 1] = r.choice([[], ["x"], ["y", "z"]])
        docs.append((i, text(40) + "\n" + "".join(z).replace(" ", "\n", 1) + " " + text(30)))
    docs += [(1000 + i, text(100)) for i in range(100)]
    for d, t in docs:
        n = dc.normal(t).decode()
        for i, x in items:
            m = dc.normal(x).decode()
            if dc.infix_distance(m, n, int(0.1 * len(m)))[0] <= int(0.1 * len(m)):
                truth.add((d, i))
    return docs, items, truth


def test_recall_against_brute_force(spark, world):
    docs, items, truth = world
    got = dc.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs <= truth and len(pairs) == len(got)
    assert len(pairs) >= 0.9 * len(truth) and len(truth) >= 110


def test_clean_leaves_clean_documents(spark, world):
    docs, items, truth = world
    left = {r["doc_id"] for r in dc.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d for d, _ in docs if d >= 1000} - {d for d, _ in truth} <= left


@pytest.mark.parametrize("even", [False, True])
def test_recall_at_the_full_ratio(even):
    """A tenth of the characters edited, at random places and evenly spread, in items of 30 to 400 characters."""
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "ré", "ed", "nd", "ha"]) for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randrange(6, 70))) for i in range(100)]
    docs = []
    for _, t in items:
        z, m = list(t), len(t) // 10
        for p in sorted(([int((k + 0.5) * len(z) / m) for k in range(m)] if even else r.sample(range(len(z)), m)), reverse=True):
            z[p : p + 1] = r.choice([[], ["x"], ["y", z[p]], ["q"]])
        docs.append(text(25) + " " + "".join(z) + " " + text(25))
    got = {(d, i) for d, i, _, _ in finder(items).hits(docs)}
    assert sum((i, i) in got for i in range(100)) >= 90


def test_text_without_spaces():
    """Items in the middle of a line of Chinese or of one long run, exact and edited."""
    r = random.Random(4)
    han = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    items = [(i, han(40)) for i in range(20)] + [(20, han(6)), (21, '{"key":"value","other":[1,2,3,4,5,6,7]}')]
    docs = [han(50) + t + han(50) for _, t in items[:21]] + ['{"a":' + items[21][1] + ',"b":0}' * 3]
    docs += [han(30) + t[:7] + "x" + t[8:20] + t[22:] + han(30) for _, t in items[:20]]
    got = {(d, i) for d, i, _, _ in finder(items).hits(docs)}
    assert {(i, i) for i in range(22)} <= got and sum((22 + i, i) in got for i in range(20)) >= 18


def test_shared_grams_are_left_out():
    """Items with a long common beginning are still told apart and found."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 8)))
    items = [(i, "which of the following statements is true " + " ".join(word() for _ in range(20))) for i in range(150)]
    docs = ["so " + t[:60] + "z" + t[61:] + " end" for _, t in items]
    got = {(d, i) for d, i, _, _ in finder(items).hits(docs)}
    assert got == {(i, i) for i in range(150)}


def test_odd_inputs(spark):
    items = spark.createDataFrame([(1, "short item"), (2, None), (3, ""), (4, "a longer item of the benchmark that is to be found whole"), (5, "a longer item of the benchmark that is to be found whole")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "here a (Short  item), stands"), (4, "shortitem"), (5, "x " * 30_000 + "a longer item of the benchmark that is to be found whole"), (6, "a short items"), (None, "short item"), (3, "here a short item")],
                                 "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item_id", "2 AS edits")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in dc.found(docs, items).collect())
    # A short item is found with its one edit (4) and inside a word (6), as any item is.
    assert got == [(0, 1), (3, 1), (4, 1), (5, 4), (5, 5), (6, 1)]
    assert dc.found(docs.limit(0), items).count() == 0
    assert dc.found(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, world):
    """Items in several passes: other walks, the same recall."""
    docs, items, truth = world
    got = dc.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=9_000).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs <= truth and len(pairs) >= 0.9 * len(truth)


def test_edited_item_beside_an_exact_one():
    """A list of test items: windows of the exact neighbour hold more grams, but none of the edited item."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(180)]
    docs, truth = [], set()
    for k in range(60):
        parts = []
        for i, rate in ((3 * k, 0), (3 * k + 1, r.choice([0.03, 0.05, 0.08])), (3 * k + 2, r.choice([0.02, 0.06]))):
            z = list(items[i][1])
            for _ in range(int(rate * len(z))):
                p = r.randrange(len(z))
                z[p : p + 1] = r.choice([[], ["x"], ["y", "z"]])
            parts.append("".join(z))
            truth.add((k, i))
        docs.append(" ".join([text(30), *parts, text(30)]))
    got = {(d, i) for d, i, _, _ in finder(items).hits(docs)}
    assert got <= truth and len(got) >= 0.9 * len(truth)


def test_short_items_with_edits_lose_nothing():
    """Items under 24 bytes at the full ratio, inside words and at the ends of texts, against every stretch of the text."""
    r = random.Random(9)
    items = [(i, "".join(r.choice("abcdeé ") for _ in range(r.randrange(3, 24))).strip() or "abc") for i in range(60)]
    items = [(i, t) for i, t in items if len(dc.normal(t)) < dc.LEAST] + [(900, "the quick brown fox")]
    docs = ["we saw the quick brown fix here today", "thequick brown fox", "no such thing", ""]
    for _, t in items:
        z = list(t)
        for _ in range(int(0.1 * len(t)) + r.choice([0, 0, 1])):
            p = r.randrange(len(z) or 1)
            z[p : p + 1] = r.choice([[], ["x"], ["y", "z"]])
        docs += ["".join(z), "some" + "".join(z) + "more", "".join(r.choice("abcdeé ") for _ in range(300)) + "".join(z)]
    finder = dc.Finder(items, 0.1, 5, 20, 4, 11, 0.2)
    got: dict = {}
    for d, i, _, k in finder.hits(docs):
        got[d, i] = min(k, got.get((d, i), 99))
    want = {}
    for d, t in enumerate(docs):
        t = dc.normal(t).decode()
        for i, x in items:
            x = dc.normal(x).decode()
            best = dc.infix_distance(x, t, int(0.1 * len(x)))[0] if t else 99
            if best <= int(0.1 * len(x)):
                want[d, i] = best
    assert got == want and got[0, 900] == 1 and got[1, 900] == 1
    assert {k for k in dc.Finder([(1, "cat")], 0.1, 5, 20, 4, 11, 0.2, whole_words=True).hits(["concatenate", "a cat."])} == {(1, 1, 5, 0)}
