"""License scan by diagonal voting (operator 7), in DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the k-gram positions of the
templates. A hit votes for the diagonal (position in text - position in template); votes are
summed per (document, template, diagonal), neighbouring diagonals (words put in or left out)
are merged, and a merged run that holds enough of the template's k-grams is verified in place: the words
around its fullest diagonal must contain the template within an edit distance of words.

At scale: the template side has a fixed size that is checked (`MAX_TEMPLATE_GRAMS`) before it is
broadcast; with more it is an ordinary shuffle join. Only hits, which are few, are shuffled, by
document. A license line that a third of all documents share is spread by doc_id. Texts are read a second
time only where a run is to be verified, beside a table of runs; a verification touches a stretch of words as
long as the template, whatever the length of the text.

Null and empty texts have no words, no places and no labels, score 0. Rows are told apart by id and text:
rows of one id with other texts, and rows without an id, have their own labels; repeated rows have the same.
The templates are an argument (label, text in lower-case words); the default is a short list of common notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the result contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licenses and notices; the label is what a verified span reports.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
K = 3
#: The characters between words: ASCII but for letters and digits (upper-case letters are gone by then).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))
MAX_TEMPLATE_GRAMS = 200_000


def template_grams(spark: SparkSession, templates, k: int = K) -> tuple[DataFrame, int]:
    rows = []
    for t, (label, text) in enumerate(templates):
        words = text.split()
        rows += [(t, label, len(words) - k + 1, i, *words[i : i + k]) for i in range(len(words) - k + 1)]
    cols = [f"w{i} string" for i in range(k)]
    d = spark.createDataFrame(rows, f"template int, label string, n_grams int, tpos int, {', '.join(cols)}")
    return d.select("template", "label", "n_grams", "tpos", F.xxhash64(*[f"w{i}" for i in range(k)]).alias("gram")), len(rows)


def template_words(spark: SparkSession, templates) -> DataFrame:
    return spark.createDataFrame([(t, text.split()) for t, (_, text) in enumerate(templates)], "template int, twords array<string>")


def infix_distance(template: Column, words: Column) -> Column:
    """Least edit distance, in words, of the template to a stretch of words: the rows of the table are
    folded one after another, each from the row before."""
    size = F.size(words)

    def row(before, t):
        cell = lambda cur, j: F.least(F.get(before, j - 1) + F.when(F.get(words, j - 1) == t, 0).otherwise(1), F.get(before, j) + 1, F.get(cur, j - 1) + 1)
        return F.aggregate(F.sequence(F.lit(1), size), F.array(F.get(before, F.lit(0)) + 1), lambda cur, j: F.concat(cur, F.array(cell(cur, j))))

    zero = F.transform(F.sequence(F.lit(0), size), lambda j: F.lit(0))
    return F.when(size > 0, F.aggregate(template, zero, row, F.array_min)).otherwise(F.size(template))


def _words(docs: DataFrame) -> DataFrame:
    """Adds _words, the words of the lower-cased text in _low. Splitting at the characters between words,
    once those at both ends are gone, gives what matching words one by one gives, at a fraction of the cost.

    lower() folds more letters than A-Z, but never a word character to another class, and no phrase
    has the letter that it makes from the Kelvin sign."""
    inner = F.btrim(F.col("_low"), F.lit(BETWEEN))
    return docs.withColumn("_words", F.when(inner != "", F.split(inner, GAP)).otherwise(F.array().cast("array<string>")))


def _lowered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))


#: Words that texts of any kind hold; the last choice for an anchor.
STOP = frozenset("a all and any are as by following for free from in is it may of on or person public that the this to under use version with without work you".split())


def anchors(templates, k: int, coverage: float) -> list[str]:
    """Words without which no template can reach the coverage: the k-grams that hold none of them are
    too few. One word a template where that will do, long and uncommon ones first."""
    chosen: set[str] = set()
    for _, text in templates:
        words = text.split()
        grams = [frozenset(words[i : i + k]) for i in range(len(words) - k + 1)]
        plain = lambda w: w in STOP or len(w) == 1
        rank = lambda w: (-min(len(w), 7), w)
        missed = lambda ws: sum(not (g & ws) for g in grams)
        own: set[str] = set()
        while grams and missed(chosen | own) >= coverage * len(grams):
            left = set(words) - chosen - own
            left = {w for w in left if not plain(w)} or left
            enough = [w for w in left if missed(chosen | own | {w}) < coverage * len(grams)]
            own.add(min(enough, key=rank) if enough else min(left, key=lambda w: (missed(chosen | own | {w}), *rank(w))))
        chosen |= own
    return sorted(chosen)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=None, k: int = K,
                  slack: int = 2, coverage: float = 0.6, similarity: float = 0.7) -> DataFrame:
    """Verified spans: id, _row (hash of the text), template, label, start and end word, similarity.

    coverage: share of a template's k-grams that a run must hold to be verified. similarity: least value of
    1 - edit distance / words of the template."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    grams, size = template_grams(spark, templates, k)
    # A text without any anchor word cannot hold a span, so its grams are not made; nothing is lost.
    may = F.lit(False)
    for w in anchors(templates, k, coverage):
        may = may | F.col("_low").contains(w)
    texts = _lowered(docs, id_col, text).where(may)
    d = _words(texts).where(F.size("_words") >= k)
    # Positions are exploded and each gram is hashed from the array in generated code.
    rolled = d.select("_id", "_row", "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - k)).alias("pos"))
    rolled = rolled.select("_id", "_row", "pos", F.xxhash64(*[F.get("_words", F.col("pos") + j) for j in range(k)]).alias("gram"))
    side = F.broadcast(grams) if size <= MAX_TEMPLATE_GRAMS else grams
    keys = ["_id", "_row", "template"]
    hits = rolled.join(side, "gram").select(*keys, "label", "n_grams", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diag"))
    votes = hits.groupBy(*keys, "label", "n_grams", "diag").agg(F.collect_set("tpos").alias("tposs"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # A diagonal holds at most n_grams template positions, so the set is bounded by the template.
    w = Window.partitionBy(*keys).orderBy("diag")
    votes = votes.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(w) <= slack, 0).otherwise(1))
    votes = votes.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The fullest diagonal of a run is where it is verified.
    main = F.max_by(F.struct("diag", "lo", "hi"), F.struct(F.size("tposs"), -F.col("diag"))).over(Window.partitionBy(*keys, "_run"))
    votes = votes.withColumn("_main", main)
    runs = votes.select(*keys, "label", "n_grams", "_run", "_main", "diag", "lo", "hi", F.explode("tposs").alias("tpos"))
    near = F.abs(F.col("diag") - F.col("_main.diag")) <= slack + F.floor(F.col("n_grams") / 4)
    runs = runs.groupBy(*keys, "label", "n_grams", "_run", "_main").agg(
        F.count_distinct("tpos").alias("covered"), F.min(F.when(near, F.col("lo"))).alias("lo"), (F.max(F.when(near, F.col("hi"))) + k - 1).alias("hi"))
    runs = runs.where(F.col("covered") / F.col("n_grams") >= coverage).join(F.broadcast(template_words(spark, templates)), "template")  # as many rows as templates
    found = runs.groupBy("_id", "_row").agg(F.collect_list(F.struct("template", "label", F.col("_main.diag").alias("diag"), "lo", "hi", "twords")).alias("_runs"))
    found = found.withColumnsRenamed({"_id": "_fid", "_row": "_frow"})
    # The texts of the runs, once each: rows of one id and text are the same.
    texts = texts.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_row") == F.col("_frow"))).dropDuplicates(["_id", "_row"])

    def checked(r):
        pad = slack + F.floor(F.size(r["twords"]) / 4).cast("int")
        start = F.greatest(r["diag"] - pad, F.lit(0))
        around = F.slice(F.col("_words"), start + 1, F.size(r["twords"]) + 2 * pad)
        alike = 1 - infix_distance(r["twords"], around) / F.size(r["twords"])
        return F.struct(r["template"].alias("template"), r["label"].alias("label"), r["lo"].cast("long").alias("start_word"), r["hi"].cast("long").alias("end_word"), alike.alias("similarity"))

    spans = _words(texts).select("_id", "_row", F.explode(F.transform("_runs", checked)).alias("s")).select(F.col("_id").alias(id_col), "_row", "s.*")
    return spans.where(F.col("similarity") >= similarity)


def base_places(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """n_words and the places of the fixed phrases: n_base, first_word, last_word, labels."""
    d = _words(_lowered(docs, id_col, text))
    # A text with a phrase contains its words' letters; the rest need no search.
    maybe = F.lit(False)
    for p in PHRASES:
        has = F.lit(True)
        for w in p.split():
            has = has & F.col("_low").contains(w)
        maybe = maybe | has
    d = d.withColumn("_maybe", maybe).drop("_low")
    d = d.withColumn("n_words", F.size("_words").cast("long"))

    def at(phrase):
        words = phrase.split()

        def hit(w, i):
            c = w == words[0]
            for j, x in enumerate(words[1:], 1):
                c = c & F.coalesce(F.get(F.col("_words"), i + j) == x, F.lit(False))
            return c

        marked = F.transform("_words", lambda w, i: F.when(hit(w, i), i))
        return F.filter(marked, lambda i: i.isNotNull())

    for j, p in enumerate(PHRASES):
        d = d.withColumn(f"_p{j}", F.when(F.col("_maybe"), at(p)).otherwise(F.array().cast("array<int>")))
    ps = [f"_p{j}" for j in range(len(PHRASES))]
    labels = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(ps, PHRASES.values(), strict=True)]))
    return d.select(
        F.col("_id").alias(id_col), "_row", "n_words", sum((F.size(p) for p in ps), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[F.array_min(p) for p in ps]).cast("long").alias("first_word"),
        F.greatest(*[F.array_max(p) for p in ps]).cast("long").alias("last_word"),
        labels.alias("base_list"),
    )


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document: base places and labels, the method's labels, score, number of spans.

    score is the largest similarity of a verified span to its template, and 1 where a base
    phrase stands; 0 where there is neither."""
    base = base_places(docs, id_col, text)
    spans = license_spans(docs, id_col, text, **kw)
    own = spans.groupBy(F.col(id_col).alias("_oid"), F.col("_row").alias("_orow")).agg(F.collect_set("label").alias("own_list"), F.max("similarity").alias("best"), F.count("*").alias("n_spans"))
    j = base.join(own, F.col(id_col).eqNullSafe(F.col("_oid")) & (F.col("_row") == F.col("_orow")), "left")
    both = F.array_sort(F.array_union("base_list", F.coalesce("own_list", F.array().cast("array<string>"))))
    return j.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort(F.array_distinct("base_list"))).alias("base_labels"),
        F.concat_ws(",", both).alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
