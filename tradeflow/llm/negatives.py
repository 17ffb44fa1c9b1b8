"""Hard negatives of anchors by exact inner products, most of which are never computed (operator 12).

Vectors are integers, floor(scale * x). They are turned into the principal axes of a sample's second moments (an orthogonal
rotation, which keeps inner products). Products are summed over the leading axes first; what the others can add
is at most the product of the residual norms, plus a slack for rounding (`slack`). A pair whose bound lies outside
what its anchor still looks for is dropped at once, the others are summed further, and those left are verified by integer
products. The sample decides how early pairs are dropped, never the result.

Rows and anchors are cut into tiles of bounded size by a hash of their ids. Each tile of rows meets each tile of
anchors in one task, which holds the two, walks the rows in blocks and keeps for an anchor its best so far, the bar for
later blocks. Tasks give a few rows an anchor; the few of all tiles are ranked by windows that cut before they shuffle. Two
rounds: the positives of each anchor (same label), then for each positive the best of other labels between two shares of
its score. No label, vector or id is a key of a shuffle of rows, so none can be a hot one.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Of rows with one id the one of
the smallest label, then vector, counts. Vectors shorter than the longest are continued by zeros. Ties in score go to the
smaller id. Products must fit a long a hundred times over, else an error says so. Empty tables and tables without anchors
give no rows; an anchor with fewer other rows has fewer positives; one with none is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import cut
from .vectors import floored, matrix, usable

#: Rows that the axes are fitted on, on average.
SAMPLE = 4_096
#: Components of a tile of rows and of anchors; rows that are compared at a time; pairs that are summed further at a time.
TILE_ROWS, TILE_ANCHORS, BLOCK, PAIRS = 1 << 21, 1 << 17, 512, 1 << 16
LEAST = np.iinfo(np.int64).min


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the leading one first."""
    if not len(sample):
        return np.eye(sample.shape[1])
    x = sample.astype(np.float64)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def slack(turn: np.ndarray) -> float:
    """Times the product of two norms: what rounding of rotated vectors, their products and norms can amount to, and how
    far the axes are from orthogonal."""
    d = len(turn)
    return 8 * d**1.5 * np.finfo(np.float64).eps + 2 * float(np.linalg.norm(turn.T @ turn - np.eye(d)))


class Side:
    """Vectors, their rotation and the norms of what is left after each of some numbers of leading axes."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, turn: np.ndarray):
        self.ids, self.whole, self.turned = ids, whole, whole.astype(np.float64) @ turn
        d = whole.shape[1]
        self.stages = sorted({max(1, d // 4), max(1, d // 2)} & set(range(1, d + 1)))
        self.rests = [np.sqrt((self.turned[:, m:] ** 2).sum(axis=1)) for m in self.stages]
        self.norm = np.sqrt((self.turned**2).sum(axis=1))

    def part(self, rows) -> Side:
        out = object.__new__(Side)
        out.ids, out.whole, out.turned, out.stages, out.norm = self.ids[rows], self.whole[rows], self.turned[rows], self.stages, self.norm[rows]
        out.rests = [r[rows] for r in self.rests]
        return out


def products(a: Side, x: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", a.whole[i[k : k + PAIRS]], x.whole[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]])


def between(a: Side, x: Side, lo: np.ndarray, hi: np.ndarray, meets: np.ndarray, loose: float, verified: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of `meets` and their products with lo[i] <= product <= hi[i]."""
    if not a.stages:
        i, j = np.nonzero(meets)
        part = np.zeros(len(i))
    for k, m in enumerate(a.stages):
        if not k:
            part = a.turned[:, :m] @ x.turned[:, :m].T
            rest = np.outer(a.rests[0], x.rests[0]) + np.outer(loose * a.norm, x.norm)
            i, j = np.nonzero((part + rest >= lo[:, None]) & (part - rest <= hi[:, None]) & meets)
            part = part[i, j]
            continue
        before, kept = a.stages[k - 1], []
        for p in range(0, len(i), PAIRS):
            u, v = i[p : p + PAIRS], j[p : p + PAIRS]
            s = part[p : p + PAIRS] + np.einsum("ij,ij->i", a.turned[u, before:m], x.turned[v, before:m])
            rest = a.rests[k][u] * x.rests[k][v] + loose * a.norm[u] * x.norm[v]
            part[p : p + PAIRS] = s
            kept.append((s + rest >= lo[u]) & (s - rest <= hi[u]))
        kept = np.concatenate([np.zeros(0, bool), *kept])
        i, j, part = i[kept], j[kept], part[kept]
    if verified is not None:
        verified.append(len(i))
    score = products(a, x, i, j)
    fits = (score >= lo[i]) & (score <= hi[i])
    return i[fits], j[fits], score[fits]


class Best:
    """The `k` best (score, id) of each of n lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(of):
            return
        touched = np.unique(of)
        all_of = np.concatenate([np.repeat(touched, self.k), of])
        all_s, all_i = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((all_i, ~all_s, all_of))
        starts = np.searchsorted(all_of[order], touched)
        take = order[(starts[:, None] + np.arange(self.k)[None, :])]
        self.score[touched], self.ids[touched] = all_s[take], all_i[take]

    def bar(self) -> np.ndarray:
        """The least score that may still enter a list."""
        return self.score[:, -1]


def _labels(a: pa.Table, x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    both = pd.factorize(np.concatenate([a["label"].to_numpy(), x["label"].to_numpy()]))[0]
    return both[: len(a)], both[len(a) :]


def positives(a: pa.Table, x: pa.Table, turn: np.ndarray, k: int, verified: list | None = None) -> Best:
    """Of each anchor the k best other rows of its label."""
    width, loose = len(turn), slack(turn)
    la, lx = _labels(a, x)
    anchors, rows = Side(a["id"].to_numpy(), matrix(a["q"], width), turn), Side(x["id"].to_numpy(), matrix(x["q"], width), turn)
    best = Best(len(a), k)
    for label in np.unique(la):
        mine, theirs = np.flatnonzero(la == label), np.flatnonzero(lx == label)
        own = anchors.part(mine)
        for b in range(0, len(theirs), BLOCK):
            block = rows.part(theirs[b : b + BLOCK])
            other = own.ids[:, None] != block.ids[None, :]
            bar = best.bar()[mine]
            if own.stages and len(block.ids) > 2 * k and (bar == LEAST).any():
                # The rows of largest leading part, verified, give a first bar.
                m = own.stages[-1]
                lead = np.where(other, own.turned[:, :m] @ block.turned[:, :m].T, -np.inf)
                some = np.argpartition(lead, len(block.ids) - k, axis=1)[:, -k:]
                i, j = np.repeat(np.arange(len(mine)), k), some.ravel()
                seen = np.where(other[i, j], products(own, block, i, j), LEAST).reshape(-1, k).min(axis=1)
                bar = np.maximum(bar, seen)
            lo = np.where(bar == LEAST, -np.inf, bar.astype(np.float64))
            i, j, s = between(own, block, lo, np.full(len(mine), np.inf), other, loose, verified)
            best.add(mine[i], s, block.ids[j])
    return best


def negatives(a: pa.Table, x: pa.Table, turn: np.ndarray, k: int, low: int, high: int, verified: list | None = None) -> Best:
    """Of each anchor and each of its positive scores (column `scores`) the k best rows of other labels between low and high
    hundredths of that score; list i * width + j is that of anchor i and its j-th score."""
    width, loose = len(turn), slack(turn)
    la, lx = _labels(a, x)
    anchors, rows = Side(a["id"].to_numpy(), matrix(a["q"], width), turn), Side(x["id"].to_numpy(), matrix(x["q"], width), turn)
    given = a["scores"].combine_chunks()
    sizes = np.diff(given.offsets.to_numpy())
    many = int(sizes.max(initial=0))
    held = np.arange(many)[None, :] < sizes[:, None]
    scores = matrix(given, many)
    least, most = -((-low * scores) // 100), (high * scores) // 100
    held &= least <= most
    best = Best(len(a) * many, k)
    for b in range(0, len(x), BLOCK):
        block = rows.part(slice(b, b + BLOCK))
        bar = np.maximum(least, best.bar().reshape(len(a), many))
        lo, hi = np.where(held, bar, np.inf).min(axis=1, initial=np.inf), np.where(held, most, -np.inf).max(axis=1, initial=-np.inf)
        i, j, s = between(anchors, block, lo, hi, la[:, None] != lx[None, b : b + BLOCK], loose, verified)
        for n in range(many):
            fits = held[i, n] & (s >= bar[i, n]) & (s <= most[i, n])
            best.add(i[fits] * many + n, s[fits], block.ids[j[fits]])
    return best


def _met(anchors: DataFrame, rows: DataFrame, tiles: tuple[int, int], run, schema: str) -> DataFrame:
    """run(anchors, rows) for every tile of anchors and every tile of rows."""
    n_a, n_x = tiles
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own, though both may be of one table
    a = anchors.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(n_a)).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))))
    x = rows.withColumn("_x", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_x)).cast("int")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))
    return a.groupBy("_a", "_x").cogroup(x.groupBy("_a", "_x")).applyInArrow(run, schema)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label: str = "label", vector: str = "vector", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score (longs, rank an int).

    anchors: which rows are anchors. For each of an anchor's n_positives best rows of its label the n_negatives best rows of
    other labels whose score is at least `low` and at most `high` hundredths of the positive's."""
    spark = rows.sparkSession
    d = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable(vector))
    d = d.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label).alias("label"), floored(vector, scale).alias("q")).alias("_v"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    d = cut(d.groupBy("id").agg(F.min("_v").alias("_v"), F.max("_anchor").alias("anchor")).select("id", "_v.label", "_v.q", "anchor"))
    facts = d.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("q")).alias("width"), F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("most")).first()
    n, width = facts["n"], facts["width"] or 0
    if 100 * width * (facts["most"] or 0) ** 2 >= 2**63:
        raise ValueError(f"a hundred inner products of {width} components up to {facts['most']} do not fit a long")
    some = d.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < F.lit(int(min(1, SAMPLE / max(n, 1)) * (1 << 30)))).select("q").toArrow()
    turn = spark.sparkContext.broadcast(axes(matrix(some["q"], width)))
    size = min(max(1, TILE_ROWS // max(width, 1)), max(1_024, n // 64))
    tiles = (max(1, -(-facts["anchors"] // max(1, TILE_ANCHORS // max(width, 1)))), max(1, -(-n // size)))

    def same(a: pa.Table, x: pa.Table) -> pa.Table:
        best = positives(a, x, turn.value, n_positives)
        i, j = np.nonzero(best.score != LEAST)
        return pa.table({"anchor_id": a["id"].to_numpy()[i], "id": best.ids[i, j], "score": best.score[i, j]})

    def other(a: pa.Table, x: pa.Table) -> pa.Table:
        best = negatives(a, x, turn.value, n_negatives, low, high)
        i, j = np.nonzero(best.score != LEAST)
        many = max(1, len(best.score) // max(len(a), 1))
        return pa.table({"anchor_id": a["id"].to_numpy()[i // many], "place": (i % many).astype(np.int32), "id": best.ids[i, j], "score": best.score[i, j]})

    of = d.where("anchor").select("id", "label", "q")
    near = _ranked(_met(of, d.select("id", "label", "q"), tiles, same, "anchor_id long, id long, score long"), ["anchor_id"], n_positives)
    near = cut(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near")))  # n_positives at most
    asked = of.join(near, F.col("id") == F.col("anchor_id")).select("id", "label", "q", F.col("near.score").alias("scores"))
    far = _met(asked, d.select("id", "label", "q"), tiles, other, "anchor_id long, place int, id long, score long")
    far = _ranked(far, ["anchor_id", "place"], n_negatives)
    p = F.get("near", F.col("place"))
    return far.join(near, "anchor_id").select("anchor_id", p["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), p["score"].alias("positive_score"), F.col("score").alias("negative_score"))
