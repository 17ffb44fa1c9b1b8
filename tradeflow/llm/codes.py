"""Product codes of integer vectors, each part's nearest entry found in a ball tree (operator 13).

A vector of integers, floor(scale * x), is cut into equal parts. The codebook of a part position starts as that part of the
vectors of smallest id; a round assigns every part to its nearest entry (squared distance, ties to the lower index) and puts
each entry at the floor of its parts' mean; an entry without parts stays.

The entries of a position stand in a tree of balls with integer centres and radii rounded up. A search first walks down
to the leaf of nearer centres, whose entries give a bound, then visits every ball that the bound does not rule out:
distance to the centre less the radius at most the bound, both rounded so that no ball is ruled out wrongly, equality
included. Distances to entries are integers. Searches run in Arrow batches, all parts of a position at once.

A round is one pass over all rows: a task gives sums and counts of its parts, a row for each position and entry, which are summed
map-side; the driver gets as many rows as there are entries. The sums over labels combine map-side too and are joined to the
rows on the label, nulls to nulls, where Spark may broadcast the sums by size or split a label that many rows share.

Rows whose vector is null or has a null or non-finite component are dropped; all others get a code, also those with a null id
or label. Null ids come after all others, ties in id are ordered by vector. Repeated rows are rows of their own. Vectors
shorter than the longest, and the last parts if the length is no multiple of their number, are continued by zeros.
With fewer rows than entries the codebooks are shorter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import cut
from .vectors import floored, matrix, usable

LEAF = 4
EPS = np.finfo(np.float64).eps


class BallTree:
    """Nearest entries of points, exactly: (index, squared distance), ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.centre, self.radius, self.below, self.members = [], [], [], []
        self._add(np.arange(len(entries)))
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)
        self.left, self.right = np.array([b[0] for b in self.below]), np.array([b[1] for b in self.below])
        self.visited = 0

    def _add(self, own: np.ndarray) -> int:
        """Adds the ball of the entries `own`, which are in ascending order."""
        at, points = len(self.centre), self.entries[own]
        centre = np.rint(points.mean(axis=0)).astype(np.int64)
        reach = ((points - centre) ** 2).sum(axis=1)
        self.centre.append(centre)
        self.radius.append(np.nextafter(np.sqrt(float(reach.max())) * (1 + EPS), np.inf))
        self.below.append((-1, -1))
        self.members.append(own)
        one = points[reach.argmax()]
        two = points[((points - one) ** 2).sum(axis=1).argmax()]
        near = ((points - one) ** 2).sum(axis=1) <= ((points - two) ** 2).sum(axis=1)
        if len(own) > LEAF and not near.all():
            self.below[at] = (self._add(own[near]), self._add(own[~near]))
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaf = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(self.left[leaf] >= 0)).size:
            a, b = self.left[leaf[inner]], self.right[leaf[inner]]
            p = points[inner]
            nearer = ((p - self.centres[a]) ** 2).sum(axis=1) <= ((p - self.centres[b]) ** 2).sum(axis=1)
            leaf[inner] = np.where(nearer, a, b)
        best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))
        for at in np.unique(leaf):
            self._look(at, np.flatnonzero(leaf == at), points, best, index)
        stack = [(0, np.arange(len(points)))]
        while stack:
            at, asked = stack.pop()
            gap = np.sqrt(((points[asked] - self.centres[at]) ** 2).sum(axis=1).astype(np.float64))
            bound = np.sqrt(best[asked].astype(np.float64))
            asked = asked[gap * (1 - 4 * EPS) - self.radii[at] * (1 + 4 * EPS) <= bound * (1 + 4 * EPS)]
            if not asked.size:
                continue
            if self.left[at] < 0:
                self._look(at, asked[leaf[asked] != at], points, best, index)
            else:
                stack += [(self.left[at], asked), (self.right[at], asked)]
        return index, best

    def _look(self, at: int, asked: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """The entries of a leaf against the points asked for."""
        own = self.members[at]
        self.visited += len(asked) * len(own)
        far = ((points[asked][:, None, :] - self.entries[own][None, :, :]) ** 2).sum(axis=2)
        first = far.argmin(axis=1)
        least, entry = far[np.arange(len(asked)), first], own[first]
        better = (least < best[asked]) | (least == best[asked]) & (entry < index[asked])
        best[asked[better]], index[asked[better]] = least[better], entry[better]


def _assigned(vectors: np.ndarray, trees: list[BallTree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By position: the parts, their entries and squared distances."""
    width = vectors.shape[1] // len(trees)
    for p, tree in enumerate(trees):
        parts = np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])
        yield parts, *tree.nearest(parts)


def _sums(batches: Iterator[pa.RecordBatch], trees: list[BallTree], width: int) -> Iterator[pa.RecordBatch]:
    """position, entry, n and the sum of each component over the task's rows."""
    entries, part = len(trees[0].entries), width // len(trees)
    count, total = np.zeros((len(trees), entries), np.int64), np.zeros((len(trees), entries, part), np.int64)
    for b in batches:
        for p, (parts, index, _) in enumerate(_assigned(matrix(b.column(0), width), trees)):
            count[p] += np.bincount(index, minlength=entries)
            np.add.at(total[p], index, parts)
    p, e = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *[pa.array(total[p, e, c]) for c in range(part)]], ["position", "entry", "n", *[f"s{c}" for c in range(part)]])


def _coded(batches: Iterator[pa.RecordBatch], trees: list[BallTree], width: int) -> Iterator[pa.RecordBatch]:
    hexes = np.array([f"{i:02x}" for i in range(256)], object)
    for b in batches:
        code, error = np.full(b.num_rows, "", object), np.zeros(b.num_rows, np.int64)
        for _, index, far in _assigned(matrix(b.column(2), width), trees):
            code += hexes[index]
            error += far
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])


def fitted(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks, position by entry by component, of rows (id, q); q is of `width` components, a multiple of parts."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()
    part = width // parts
    books = matrix(first["q"], width).reshape(-1, parts, part).transpose(1, 0, 2).copy()
    for _ in range(rounds if books.shape[1] else 0):
        trees = rows.sparkSession.sparkContext.broadcast([BallTree(b) for b in books])
        sums = rows.select("q").mapInArrow(lambda it, t=trees: _sums(it, t.value, width), "position int, entry int, n long, " + ", ".join(f"s{c} long" for c in range(part)))
        for r in sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(part)]).collect():  # parts * entries rows
            books[r["position"], r["entry"]] = [r[f"s{c}"] // r["n"] for c in range(part)]
    return books


def digest(books: np.ndarray) -> str:
    """Hash of all components in decimal by position, entry and place, with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "vector", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances summed over the parts), label_error (error summed over
    the rows of the label) and codebooks_sha256 (`digest`)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    d = cut(rows.where(usable(vector)).select(F.col(id_col).alias("id"), F.col(label).alias("label"), floored(vector, scale).alias("q")))
    width = parts * max(1, -(-(d.agg(F.max(F.size("q"))).first()[0] or 0) // parts))
    books = fitted(d, width, parts, entries, rounds)
    trees = d.sparkSession.sparkContext.broadcast([BallTree(b) for b in books] if books.shape[1] else [])
    schema = T.StructType([d.schema["id"], d.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = cut(d.mapInArrow(lambda it: _coded(it, trees.value, width), schema))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
