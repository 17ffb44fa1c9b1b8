import numpy as np

from tradeflow.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = tx.fit(docs, labels)
    from pyspark.sql import functions as F

    held = tx.scored(docs, model).join(labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0), "doc_id").select("score", "predicted", "toxic").toPandas()
    hit = held[held.toxic == 1]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.98
    assert hit.predicted.mean() > 0.75
    order = held.score.rank()
    n1, n0 = len(hit), len(held) - len(hit)
    assert (order[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9


def test_label_model_finds_good_voters():
    r = np.random.default_rng(0)
    y = r.random(3000) < 0.3
    good = np.where(r.random(3000) < 0.9, y, ~y) * 2 - 1
    twin = np.where(r.random(3000) < 0.95, good, -good)  # correlated with good
    other = np.where(r.random(3000) < 0.8, y, ~y) * 2 - 1
    noise = np.where(r.random(3000) < 0.5, 1, -1)
    p, acc, corr = tx.label_model(np.stack([good, twin, other, noise], 1).astype(np.int8), 0.3)
    assert ((p > 0.5) == y).mean() > 0.85
    assert acc[0] > acc[3] and corr[0, 1] > corr[0, 3]


def test_odd_inputs(spark):
    model = tx.fitted(["you idiot", "fine text here"] * 10, np.array([1, 0] * 10), 0.5)
    d = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "you idiot", 0.2), (3, "you idiot", 0.2), (4, "word " * 50_000, 0.0)], "doc_id long, text string, score double")
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in tx.scored(d, model).collect()]
    assert len(got) == 5 and all(0 <= s <= 1 and p in (0, 1) for _, s, p in got)
    s = {i: x for i, x, _ in got}
    assert s[1] == s[2] and s[3] > s[2]
    assert tx.scored(d.limit(0), model).count() == 0


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    for rows in ([], [(1, None)], [(1, 1), (2, 1)]):
        m = tx.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert tx.scored(docs, m).count() == 2
