import random
import re

import numpy as np
from pyspark.sql import functions as F

from tradeflow.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in win:
        count[x] = count.get(x, 0) + 1
    covered = {i + j for i, x in enumerate(win) if count[x] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_counts_match_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(0, 40))) for _ in range(150)]
    texts += ["a\n\n b\na\n\ta\n", "#*$%&|<>", None, "", " \t\n", "\x0b\x0c x \r\n x", "é ü 😀 x", "the the " * 3000, "a\u00a0b c", "x" * 100_000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for x in quality.judged(d).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute(texts[x["doc_id"]])
        assert not (x["base_failed"] and x["kept"])


def test_estimate_withstands_outliers(spark):
    r = np.random.default_rng(1)
    rows = [("g", *map(float, v)) for v in r.normal([1.6, 0.1, 0.1, 0.1], 0.01, (700, 4))] + [("g", *map(float, v)) for v in r.normal([3.0, 1.2, 1.0, 1.0], 0.01, (150, 4))]
    d = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in quality.STATS)).withColumn("_salt", (F.rand(1) * quality.SALTS).cast("int"))
    est = quality.mcd(d).orderBy("log_det").first()
    assert abs(est["mu_0"] - 1.6) < 0.01 and abs(est["mu_1"] - 0.1) < 0.01 and est["m_n"] <= 700


def test_cholesky_is_that_of_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 4)) @ r.normal(size=(4, 4))
    d = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{s} double" for s in quality.STATS))
    m = quality._estimated(d.groupBy("grp").agg(*quality._sums()), ["grp"]).first()
    c = np.cov(x.T, bias=True) + np.diag([quality.FLOOR[s] ** 2 for s in quality.STATS])
    low = np.linalg.cholesky(c)
    assert all(abs(m[f"l_{i}_{j}"] - low[i, j]) < 1e-8 for i in range(4) for j in range(i + 1))


def test_clean_texts_are_kept(spark):
    sf = "/root/testdata/sf0.1"
    d = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = d[(d.quality == 1) & ~d.base_failed]
    assert good.kept.mean() > 0.97
    bad = d[(d.quality == 0) & (d.n_symbols > 0.1 * d.word_chars)]
    assert bad.kept.mean() < 0.35


def test_missing_columns_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k", None, None, 3)], "doc_id long, text string, lang string, source string, n_words int")
    assert quality.judged(d).first()["kept"] is True
    assert quality.judged(d.drop("lang", "source")).count() == 1
    assert quality.judged(d.limit(0)).count() == 0


def test_word_length_alone_rejects(spark):
    """Ten robust deviations out in word length and nothing else, to either side; two deviations out is kept."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    text = lambda a, b: " ".join(word(r.randrange(a, b)) for _ in range(200))
    rows = [(i, text(3, 8), "en", "s") for i in range(400)] + [(1000, text(6, 11), "en", "s"), (1001, text(2, 4), "en", "s")]
    got = {x["doc_id"]: x for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    n = np.array([np.log(got[i]["word_chars"] / got[i]["n_words"]) for i in range(400)])
    mad = 1.4826 * np.median(abs(n - np.median(n)))
    for i in (1000, 1001):
        assert abs(np.log(got[i]["word_chars"] / got[i]["n_words"]) - np.median(n)) > 10 * mad
        assert not got[i]["base_failed"] and not got[i]["kept"]
    assert all(got[i]["kept"] for i in range(400) if abs(n[i] - np.median(n)) < 2 * mad)


def test_consistency_of_the_scatter(spark):
    """On normal rows the estimate's deviations are those of all rows, not those of the nearest part."""
    assert abs(quality.consistency(1.0) - 1) < 1e-9
    rows = [("g", *map(float, v)) for v in np.random.default_rng(5).normal(0.5, 0.2, (4000, 4))]
    d = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in quality.STATS)).withColumn("_salt", (F.rand(1) * quality.SALTS).cast("int"))
    est = quality.mcd(d).orderBy("log_det").first()
    assert abs(est["l_0_0"] - 0.2) < 0.015


def test_estimate_is_that_of_an_exact_search(spark):
    """In small groups the kept rows' determinant is as small as that of many random starts, each run to its end."""
    r = np.random.default_rng(7)
    groups = {f"g{k}": np.vstack([r.normal([1.6, 0.2, 0.2, 0.2], 0.1, (45, 4)) @ np.diag([1, 1 + k, 1, 1]), r.normal(1.4, 0.2, (12, 4))]) for k in range(3)}
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    d = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in quality.STATS)).withColumn("_salt", (F.rand(1) * quality.SALTS).cast("int"))
    got = {x["grp"]: x for x in quality.mcd(d).orderBy(F.desc("log_det")).collect()}

    def exact(x):
        h, best = int(np.ceil(0.75 * len(x))), None
        for _ in range(300):
            keep = r.choice(len(x), 6, replace=False)
            for _ in range(30):
                mu, c = x[keep].mean(0), np.cov(x[keep].T, bias=True) + 1e-12 * np.eye(4)
                z = x - mu
                new = np.argsort(np.einsum("ij,ij->i", z @ np.linalg.inv(c), z))[:h]
                if len(new) == len(keep) and set(new) == set(keep):
                    break
                keep = new
            det = np.linalg.slogdet(np.cov(x[keep].T, bias=True))[1]
            best = min(best or (det, mu), (det, mu), key=lambda t: t[0])
        return best

    for g, x in groups.items():
        det, mu = exact(x)
        assert max(abs(got[g][f"mu_{i}"] - mu[i]) for i in range(4)) < 0.05, (g, mu)


def test_the_distance_alone_decides(spark):
    """Far out on the good side of a statistic nothing counts; a text is kept exactly if its distance is within the cutoff."""
    rows = [(i, f"some words{i % 7} of # a text ## that has {'more ' * (i % 3)} symbols * here and there {i}", "en", "s") for i in range(300)] + [(900, "a text of the same words but without any symbols in it at all here", "en", "s"), (901, "# * % & " * 30, "en", "s"), (None, None, None, None)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS grp", "2 AS kept")).collect()
    assert all(x["kept"] == (not x["base_failed"] and x["distance"] <= 23.5) for x in got)
    assert not {x["doc_id"]: x for x in got}[None]["kept"]
