import random

from tradeflow.llm import jaccard
from tradeflow.llm.graph import components


def sets(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    label = {i: i for i in s}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids, links = sorted(s), dict.fromkeys(s, 0)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
                    links[a] += 1
                    links[b] += 1
    return {i: (len(s[i]), find(i), links[i]) for i in ids}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    shared = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(140)]
    for _ in range(60):  # near copies with zero to five changes
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(40):  # a passage that many texts share
        rows.append(" ".join([word() for _ in range(r.randrange(5, 120))] + shared + [word() for _ in range(5)]))
    for n in (1, 2, 3, 4, 5, 6, 30):
        t = " ".join(word() for _ in range(n))
        rows += [t, t.upper(), t + " " + word()]
    rows += ["", None, "   ", "\n\t", rows[0], rows[0], "x " * 4000]
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    rows = corpus()
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == brute(rows)


def test_frequent_elements_matter_only_for_speed(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(jaccard, "MAX_HOT", 10)
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = spark.createDataFrame([(1, "a b c d e f", 0, 0), (2, "a b c d e f", 0, 0)], "doc_id long, text string, n long, grp long")
    assert {r["component_id"] for r in jaccard.linked(d).collect()} == {1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_packing_is_exact():
    import numpy as np

    x = np.array([0, 1, 255, 2**40 - 1, 2**63], np.uint64)
    assert (jaccard._unpack(jaccard._pack(x), 5) == x).all()


def test_rows_without_an_id(spark):
    d = spark.createDataFrame([(None, "a b c d e f g h i j k l m n o p"), (5, "a b c d e f g h i j k l m n o p"), (None, "other words than the first"), (7, "A b c d e f g h i j k l m n o p q")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.linked(d).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (7, 5)]


def test_links_in_small_blocks(spark, monkeypatch):
    """Components cut into many blocks: the same links."""
    rows = corpus(9)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == brute(rows)
    assert "n_links" not in jaccard.linked(spark.createDataFrame(rows[:3], "doc_id long, text string"), counts=False).columns


def test_common_elements():
    import numpy as np

    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(300), r.randrange(0, 200))), np.uint64) for _ in range(70)]
    got = jaccard.common_elements(sets)
    assert all(got[a, b] == len(set(sets[a]) & set(sets[b])) for a in range(70) for b in range(70) if a != b)
