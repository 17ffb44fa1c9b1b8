"""Toxicity by weak supervision (operator 1).

Voters are lexicons and patterns: seed lists of several languages, shouting and direct address,
and lists mined from labelled rows (words and word beginnings that occur mostly in toxic texts). Lists are mined
on four fifths of the sample and vote on the fifth, in turn, so no voter has seen the labels of the rows it votes on.
Each votes toxic, clean or abstains. A generative label model estimates the voters' accuracies
by expectation-maximisation over the unknown true class, from the votes alone, and pairwise correlations from the
voters' residuals given it, by which correlated voters share their weight. A logistic classifier
is trained on the posterior labels, and on them only, and scores every whole text. Labels thus do three things:
they give the share of toxic rows, choose words for the mined lists, and split the sample by class.

Fitting takes at most `sample` labelled rows of each class, those of the smallest hashes, on the
driver; the model is at most `features` weights. At scale: fitting reads doc_id and the sampled
texts; scoring is one pass of Arrow batches with no shuffle, and memory of one batch.

Null and empty texts have no features and get the score of the intercept. Very long texts are scored whole.
Repeated rows score alike; other columns stay, but for score and predicted.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEEDS = [
    frozenset("idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless disgusting clown dumb fool imbecile".split()),
    frozenset("dumm idiot idioten trottel abschaum widerlich wertlos versager arschloch blödmann ekelhaft".split()),
    frozenset("imbécile crétin débile minable dégoûtant ordure abruti connard nul pathétique".split()),
    frozenset("estúpido imbécil tonto basura asqueroso inútil patético perdedor escoria payaso".split()),
]
ADDRESS = re.compile(r"\b(?:you(?:'re| are| r)?|du bist|tu es|vous êtes|eres|shut up|kill yourself|go to hell)\b", re.I)
_EDGE = re.compile(r"[\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7)


def words_of(text: str) -> set[str]:
    return {w for w in _EDGE.split(text.lower()) if w}


def features_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


def features_in(text: str) -> set[str]:
    return {f for w in words_of(text) for f in features_of(w)}


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    intercept: float
    accuracies: list[float] = field(default_factory=list)
    correlations: np.ndarray | None = None

    def scorer(self):
        """Scores texts; a word's weight is worked out once per batch of known words."""
        known: dict[str, tuple[float, float]] = {}

        def weight(w: str) -> float:
            x = known.get(w)
            if x is None:
                if len(known) > 100_000:
                    known.clear()
                x = known[w] = sum(self.weights.get(f, 0.0) for f in features_of(w))
            return x

        def score(text) -> float:
            z = self.intercept + sum(map(weight, words_of(text))) if isinstance(text, str) else self.intercept
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


def candidates(texts: list[str], y: np.ndarray, least: int = 4) -> list[set[str]]:
    """Per text its features of those that at least `least` toxic texts hold.

    Memory follows the vocabulary of the toxic sample."""
    pos: Counter = Counter()
    for t, toxic in zip(texts, y, strict=True):
        if toxic:
            pos.update(features_in(t))
    may = {f for f, n in pos.items() if n >= least}
    return [features_in(t) & may for t in texts]


def mined(feats: list[set[str]], y: np.ndarray, features: int, least: int = 4) -> list[str]:
    """Features that occur in at least `least` toxic texts, by their smoothed log odds."""
    pos: Counter = Counter()
    neg: Counter = Counter()
    for fs, toxic in zip(feats, y, strict=True):
        (pos if toxic else neg).update(fs)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    odds = {f: (np.log((a + 0.5) / (n1 + 1)) - np.log((neg[f] + 0.5) / (n0 + 1))) * np.sqrt(a + neg[f]) / np.sqrt(a + neg[f] + 8) for f, a in pos.items() if a >= least}
    return sorted((f for f in odds if odds[f] > 1.5), key=lambda f: (-odds[f], f))[:features]


def votes_of(texts: list[str], feats: list[set[str]], lists: list[frozenset]) -> np.ndarray:
    """Rows of votes: 1 toxic, -1 clean, 0 abstains."""
    out = np.zeros((len(texts), len(SEEDS) + 2 + len(lists)), dtype=np.int8)
    for i, (t, fs) in enumerate(zip(texts, feats, strict=True)):
        row = [1 if fs & s else 0 for s in SEEDS]
        row.append(1 if ADDRESS.search(t) and any(fs & s for s in SEEDS) else 0)
        upper = sum(c.isupper() for c in t)
        row.append(1 if len(t) > 20 and upper > 0.6 * len(t) and "!" in t and any(fs & s for s in SEEDS) else 0)
        hits = [len(fs & s) for s in lists]
        # A mined list speaks for toxic where it is met, and for clean where not: one voter with both votes.
        row += [1 if h else -1 for h in hits]
        out[i] = row
    return out


def label_model(votes: np.ndarray, prior: float, start: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic per row, accuracy per voter, correlation of voters given the class.

    The E step adds log likelihood ratios of the votes, each divided by the sum of its positive
    correlations, so that voters that copy each other count once; it starts where any voter says toxic. The M step counts votes by
    posterior with a small prior. The correlation of two voters is that of their residuals under
    the posterior of the other voters: their own votes must not say what the class is."""
    n, m = votes.shape
    base = np.log(prior / (1 - prior))
    logistic_of = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p = np.clip(start if start is not None else np.where((votes > 0).any(1), 0.8, 0.1), 0.02, 0.98)
    corr, acc = np.eye(m), np.zeros(m)
    for step in range(rounds):
        share = np.maximum(1.0, np.maximum(corr, 0).sum(1))
        llr, means = np.zeros((n, m)), np.zeros((2, m))
        for j in range(m):
            for v in (-1, 0, 1):
                is_v = votes[:, j] == v
                a = (p[is_v].sum() + 0.5) / (p.sum() + 1.5)
                b = ((1 - p[is_v]).sum() + 0.5) / ((1 - p).sum() + 1.5)
                llr[is_v, j] = np.log(a) - np.log(b)
                means[:, j] += v * b, v * a
            cast = votes[:, j] != 0
            acc[j] = float(np.where(votes[cast, j] > 0, p[cast], 1 - p[cast]).mean()) if cast.any() else 0.5
        total = (llr / share).sum(1)
        if step % 5 == 4:
            r0, r1 = votes - means[0], votes - means[1]
            for j in range(m):
                for k in range(j):
                    q = logistic_of(total - llr[:, j] / share[j] - llr[:, k] / share[k] + base)
                    # Less what independent voters would show because q is not sure.
                    unsure = (2 * q * (1 - q)).mean() * np.prod(means[1, [j, k]] - means[0, [j, k]])
                    cov = (q * r1[:, j] * r1[:, k] + (1 - q) * r0[:, j] * r0[:, k]).mean() - unsure
                    vj, vk = (p * r1[:, j] ** 2 + (1 - p) * r0[:, j] ** 2).mean(), (p * r1[:, k] ** 2 + (1 - p) * r0[:, k] ** 2).mean()
                    corr[j, k] = corr[k, j] = np.clip(cov / np.sqrt(vj * vk), -1, 1) if vj * vk > 1e-12 else 0.0
        new = logistic_of(total + base)
        settled = step > 5 and np.abs(new - p).max() < 1e-4
        p = new
        if settled:
            break
    return p, acc, corr


def logistic(rows: list[dict[int, int]], target: np.ndarray, weight: np.ndarray, m: int, rounds: int = 400, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse counts; full-batch Adam."""
    if not rows:
        return np.zeros(m), 0.0
    idx = np.array([j for r in rows for j in r], dtype=np.int64)
    val = np.array([x for r in rows for x in r.values()], dtype=np.float64)
    own = np.array([i for i, r in enumerate(rows) for _ in r], dtype=np.int64)
    w, b, n = np.zeros(m), 0.0, weight.sum()
    mw, vw, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(own, weights=w[idx] * val, minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        gw = np.bincount(idx, weights=g[own] * val, minlength=m) + ridge * w / len(rows)
        gb = g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr, c1, c2 = 0.05, 1 - 0.9**t, 1 - 0.99**t
        w -= lr * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def fitted(texts: list[str], y: np.ndarray, prior: float, features: int = 3_000, lists: int = 10, folds: int = 5) -> ToxicityModel:
    """Mines voters, fits the label model, trains the classifier on posterior labels.

    prior is the share of toxic rows in the population; the sample may be balanced."""
    prior = min(max(prior, 0.01), 0.99)
    if not len(y) or y.min() == y.max():
        lex = {w: 4.0 for s in SEEDS for w in s}
        return ToxicityModel(lex, float(np.log(prior / (1 - prior))) if not len(y) else -2.0)
    held = candidates(texts, y)
    vocabulary = mined(held, y, features)
    sampled_prior = float(y.mean())
    # The sample is ordered by id, which says nothing of the class: every folds-th row is a part.
    part = np.arange(len(texts)) % folds
    votes = np.zeros((len(texts), len(SEEDS) + 2 + lists), np.int8)
    seed_words = frozenset().union(*SEEDS)
    seeds = [words_of(t) & seed_words for t in texts]
    for k in range(folds):
        others, own = np.flatnonzero(part != k), np.flatnonzero(part == k)
        words = mined([held[i] for i in others], y[others], features)
        # Each mined voter takes every lists-th feature: about equally good, and not independent.
        groups = [frozenset(words[i::lists]) for i in range(lists)]
        votes[own] = votes_of([texts[i] for i in own], [held[i] | seeds[i] for i in own], groups)
    target, acc, corr = label_model(votes, sampled_prior)
    index = {f: i for i, f in enumerate(vocabulary)}
    # A feature counts once for each distinct word that has it, as in scoring.
    rows = [dict(sorted(Counter(index[f] for w in words_of(t) for f in features_of(w) if f in index).items())) for t in texts]
    weight = np.where(y > 0, prior / sampled_prior, (1 - prior) / (1 - sampled_prior))
    w, b = logistic(rows, target, weight, len(vocabulary))
    return ToxicityModel({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, float(b), [float(a) for a in acc], corr)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2_000, id_col: str = "doc_id", text: str = "text", **kw) -> ToxicityModel:
    """Fits on labelled rows whose crc32 of the id is no multiple of 5, at most `sample` of each class."""
    usable = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0)).select(id_col, F.col("toxic").cast("int").alias("_y"))
    prior = usable.agg(F.avg("_y")).first()[0]
    picked = None
    for y in (0, 1):
        top = usable.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample)
        picked = top if picked is None else picked.unionByName(top)
    # At most 2 x sample ids are broadcast; the driver gets their texts.
    rows = docs.select(id_col, F.col(text).alias("_t")).join(F.broadcast(picked), id_col).toPandas()
    rows = rows.sort_values(id_col, kind="stable")
    return fitted([t or "" for t in rows["_t"]], rows["_y"].to_numpy(dtype=np.int64), float(prior if prior is not None else 0.05), **kw)


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # at most `features` weights

    # Texts become Python objects one at a time: memory is that of one Arrow batch.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = ToxicityModel(*shared.value).scorer()
        for b in batches:
            at = b.schema.get_field_index(text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(t.as_py()) for t in b.column(at)], pa.float64())], [*b.schema.names, "score"])

    d = docs.drop("score", "predicted")
    d = d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField("score", T.DoubleType())]))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
