import re

from tradeflow.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at, labels = [], set()
    for p, label in licenses.PHRASES.items():
        ps = p.split()
        hits = [i for i in range(len(w) - len(ps) + 1) if w[i : i + len(ps)] == ps]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = ["Licensed under CC BY-NC 4.0.", "cc  by cc-by ccby CC\nBY", "All rights\treserved! all rights reserved", "the GNU General Public License, version 3.", "general  public, license general public",
         "Released under the MIT License.", "", None, "...", "é à ü Ünïcode cc by É", "x" * 200_000, "word " * 30_000 + "Licensed under the Apache License, Version 2.0.",
         "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
         "permission is hereby granted to nobody", "a b c", "0cc by1 cc by"]


def test_base_places_match_brute_force(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scanned(d).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_spans_vote_on_merged_diagonals(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.scanned(d).collect()}
    assert labels[0] == "cc-by,cc-by-nc-4.0" and labels[3] == "gpl,gpl-3.0" and labels[5] == "mit" and labels[11] == "apache-2.0" and labels[12] == "mit"  # one word put in
    assert labels[13] == "" and labels[14] == ""
    span = licenses.license_spans(d).where("doc_id = 11 and similarity = 1").first()
    assert (span["start_word"], span["end_word"]) == (30_000, 30_007)


def test_anchors_lose_nothing(spark, monkeypatch):
    """The same spans with every text searched."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lambda: {tuple(r) for r in licenses.license_spans(docs).collect()}
    some = rows()
    monkeypatch.setattr(licenses, "anchors", lambda *a: [""])
    assert rows() == some and some


def aligned(template, words):
    """Least edits of the template to a stretch of words, by the plain table."""
    row = [0] * (len(words) + 1)
    for i, t in enumerate(template, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j - 1] + (t != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_verified_spans_match_the_plain_alignment(spark):
    import random

    r = random.Random(6)
    filler = lambda n: [r.choice(["the", "license", "under", "a", "word", "of", "version"]) for _ in range(n)]
    docs = []
    for i in range(120):
        t = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randrange(0, 4)):
            p = r.randrange(len(t))
            t[p : p + 1] = r.choice([[], ["x"], [t[p], "y"]])
        docs.append((i, " ".join(filler(r.randrange(30)) + t + filler(r.randrange(30)))))
    spans = licenses.license_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    assert len({s["doc_id"] for s in spans}) > 80
    for s in spans:
        t = licenses.TEMPLATES[s["template"]][1].split()
        want = 1 - aligned(t, text[s["doc_id"]].split()) / len(t)
        assert s["similarity"] <= want + 1e-9 and s["similarity"] >= 0.7
    # Whole templates are always found, and are as alike as the plain alignment says.
    best = {}
    for s in spans:
        best[s["doc_id"], s["template"]] = max(best.get((s["doc_id"], s["template"]), 0), s["similarity"])
    for i, t in docs:
        for k, (_, x) in enumerate(licenses.TEMPLATES):
            if f" {x} " in f" {t} ":
                assert best[i, k] == 1


def test_scrambled_words_are_no_span(spark):
    """The k-grams of a template one after another hold all its k-grams, but not the template."""
    t = licenses.TEMPLATES[0][1].split()
    d = spark.createDataFrame([(1, " ".join(" ".join(t[i : i + 3]) for i in range(len(t) - 2)))], "doc_id long, text string")
    assert licenses.scanned(d).first()["labels"] == ""


def test_rows_of_one_id_and_without_an_id(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    d = spark.createDataFrame([(1, notice, 7), (1, "nothing at all", 7), (None, notice + " cc by", 7), (None, None, 7), (2, notice, 7), (2, notice, 7)], "doc_id long, text string, label int")
    got = sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in licenses.scanned(d).collect())
    assert got == [(0, "", 0.0), (0, "apache-2.0,cc-by", 1.0), (1, "", 0.0), (1, "apache-2.0", 1.0), (2, "apache-2.0", 1.0), (2, "apache-2.0", 1.0)]


def test_empty_table(spark):
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string, n_words long")).count() == 0
