"""N-gram Jaccard join as a grouped prefix join (operator 6).

Each text is the set of its word 5-grams. Two sets with a Jaccard similarity of at least 75 %
share an element among the first n - ceil(0.75 n) + 1 of each, in any one order of elements. The
order here puts elements that occur in many texts last, by that number. Documents with identical prefixes and
size are one group; groups that share a prefix element are candidates; candidate groups are
expanded to their distinct sets, and pairs of sets are verified exactly, on words.

Which elements are frequent comes from a count over all texts (of 40 bits of their hashes; since
any order is right, a collision costs time only). At most MAX_HOT are frequent: the least power
of two for which this holds is the bound on a list of other elements, within which all pairs are
candidates. In the lists of frequent elements, which groups of near copies bring about, each set
is paired with a hub; sets that this leaves in different components are then paired exactly.

Every document gets the number of documents it is linked with, itself not counted. A link joins sets of
one component, so the components are cut into blocks of bounded size; each pair of blocks of one component
is one task's work, which counts common elements of all its pairs of sets at once and hands out sums, not
pairs. Copies count through the size of their class.

At scale: texts are hashed in Arrow batches; counts travel as sorted, compressed runs, prefixes
as (element, document) rows, of one document of each group that a task meets. Exact copies collapse before postings are joined. No task holds a
list of a frequent element: hubs are minima combined map-side.

Null and empty texts and texts without words have an empty set and link with nothing, not even
with each other. Repeated rows (one id twice) are one node. Rows without an id get the class and
component of their set, null if no row with an id has or links to it, and its links with rows that have one.
Of very long texts the whole set is compared; a block holds at least one set, of whatever size.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .util import cut, ids_of

WORDS = 5
#: Least count of a frequent element, and how many of them there can be (8 bytes each are broadcast).
LEAST_HOT, MAX_HOT = 16, 1_000_000
KEY_BITS = 40
#: Most elements and most sets of a block in which links are counted (a block of one larger set aside).
BLOCK_ELEMENTS, BLOCK_SETS = 400_000, 2_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of other bytes than space and 9 to 13: what bytes.split() gives."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, WORDS)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(32)
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _count_runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per flush and bucket: sorted distinct keys as compressed gaps, and their counts."""

    def flush(parts):
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        edges = np.searchsorted(keys, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(KEY_BITS)) // np.uint64(buckets))
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
        yield pa.record_batch([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([int(hi - lo) for _, lo, hi in rows], pa.int32()),
            pa.array([_pack(np.diff(keys[lo:hi], prepend=np.uint64(0))) for _, lo, hi in rows], pa.binary()),
            pa.array([_pack(counts[lo:hi].astype(np.uint64)) for _, lo, hi in rows], pa.binary()),
        ], ["bucket", "n", "keys", "counts"])

    parts, size = [], 0
    for b in batches:
        for t in b.column(0):
            s = shingles(words_of(t.as_py())) >> np.uint64(64 - KEY_BITS)
            parts.append(s)
            size += len(s)
            if size >= 1_000_000:
                yield from flush(parts)
                parts, size = [], 0
    if size:
        yield from flush(parts)


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, so that the high bytes compress."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel()


def _frequent(table: pa.Table) -> pa.Table:
    """The keys of a bucket that LEAST_HOT texts or more hold."""
    keys, counts = [], []
    for n, k, c in zip(table["n"].to_pylist(), table["keys"], table["counts"], strict=True):
        keys.append(np.cumsum(_unpack(k.as_py(), n), dtype=np.uint64))
        counts.append(_unpack(c.as_py(), n).astype(np.int64))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(counts, first)
    hot = total >= LEAST_HOT
    return pa.table({"key": keys[first][hot].astype(np.int64), "df": total[hot]})


def frequent_keys(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the frequent elements, at most MAX_HOT of them, and in how many texts each is."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # About a megabyte of text, some 200,000 elements, to a bucket.
    buckets = int(max(64, min(100_000, size // 1_000_000)))
    runs = docs.select(text).mapInArrow(lambda b: _count_runs(b, buckets), "bucket int, n int, keys binary, counts binary")
    hot = cut(runs.groupBy("bucket").applyInArrow(_frequent, "key long, df long"))
    levels = {r["l"]: r["c"] for r in hot.groupBy(F.floor(F.log2("df")).alias("l")).agg(F.count("*").alias("c")).collect()}
    level = min(levels, default=0)
    while sum(c for k, c in levels.items() if k >= level) > MAX_HOT:
        level += 1
    rows = hot.where(F.col("df") >= F.lit(2**level)).toPandas().sort_values("key")
    return rows["key"].to_numpy(dtype=np.uint64), rows["df"].to_numpy(dtype=np.int64)


def _ordered(text: str | None, hot: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The set of a text, its prefix in two parts (other and frequent elements), and how many of
    its elements are not frequent."""
    s = shingles(words_of(text))
    n = len(s)
    p = prefix_length(n) if n else 0
    if not len(hot) or not n:
        return s, s[:p], s[:0], n
    k = s >> np.uint64(64 - KEY_BITS)
    at = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
    is_hot = hot[at] == k
    cold, warm = s[~is_hot], s[is_hot]
    return s, cold[:p], warm[np.argsort(df[at[is_hot]], kind="stable")[: max(0, p - len(cold))]], len(cold)


def _group(n: int, cold: np.ndarray, warm: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(cold.tobytes() + warm.tobytes(), seed=n) - (1 << 63)


def _members(batches: Iterator[pa.RecordBatch], hot: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document: set size, how many of its elements are not frequent, hashes of set and group; and,
    once a group and task, the frequent part of the prefix and the place where it starts."""
    given: set[int] = set()
    for b in batches:
        out = []
        for t in b.column(1):
            s, cold, warm, few = _ordered(t.as_py(), hot, df)
            g = _group(len(s), cold, warm)
            if len(given) > 500_000:
                given.clear()
            out.append((len(s), few, xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), g, len(cold), warm.view(np.int64) if len(warm) and g not in given else None))
            given.add(g)
        cols = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
        yield pa.record_batch([b.column(0), *cols, pa.array([r[5] for r in out], pa.list_(pa.int64()))], ["doc_id", "n", "few", "cls", "grp", "at", "common"])


def _postings(batches: Iterator[pa.RecordBatch], hot: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The other prefix elements with their place, of one document of each group that this task meets."""
    given: set[int] = set()
    for b in batches:
        ids = b.column(0).to_pylist()
        parts, size = [], 0
        for doc, t in zip(ids, b.column(1), strict=True):
            s, e, warm, _ = _ordered(t.as_py(), hot, df)
            g = _group(len(s), e, warm)
            if not len(e) or doc is None or g in given:
                continue
            if len(given) > 500_000:
                given.clear()
            given.add(g)
            parts.append((e, np.full(len(e), doc), np.full(len(e), len(s), np.int32), np.arange(len(e), dtype=np.int32)))
            size += len(e)
            if size >= 200_000:
                yield _rows(parts)
                parts, size = [], 0
        if parts:
            yield _rows(parts)


def _rows(parts: list) -> pa.RecordBatch:
    e, doc, n, i = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.record_batch([pa.array(e.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(n), pa.array(i)], ["e", "doc", "n", "i"])


def _pairs_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of elements to pairs of documents that share one and can be alike by size and place.

    A run of one element is shorter than the least count of a frequent one; a run that a batch
    cuts is carried over to the next."""
    rest = [np.zeros(0, np.int64) for _ in range(4)]
    for b in batches:
        cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns, strict=True)]
        end = len(cols[0]) if not len(cols[0]) else int(np.searchsorted(cols[0], cols[0][-1]))
        rest = [c[end:] for c in cols]
        yield from _run_pairs(*[c[:end] for c in cols])
    yield from _run_pairs(*rest)


def _run_pairs(e: np.ndarray, doc: np.ndarray, n: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
    same = e[1:] == e[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(e) else np.zeros(0, bool)
    e, doc, n, i = e[keep], doc[keep], n[keep].astype(np.int64), i[keep].astype(np.int64)
    found, k = [], 1
    while k < len(e):
        at = np.flatnonzero(e[k:] == e[:-k])
        if not len(at):
            break
        x, y = at, at + k
        alike = (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x]) & (7 * np.minimum(n[x] - i[x], n[y] - i[y]) >= 3 * (n[x] + n[y])) & (doc[x] != doc[y])
        x, y = x[alike], y[alike]
        found.append(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])]))
        k += 1
    if found:
        pairs = np.unique(np.concatenate(found, 1), axis=1)
        yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["doc", "doc2"])


def _alike(rows: pd.DataFrame) -> pd.Series:
    out = []
    seen: dict[int, frozenset] = {}

    def grams(i, t):
        if i not in seen:
            if len(seen) > 256:
                seen.clear()
            w = words_of(t)
            k = min(len(w), WORDS)
            seen[i] = frozenset(zip(*[w[j : len(w) - k + 1 + j] for j in range(k)], strict=True)) if w else frozenset()
        return seen[i]

    for a, b, ta, tb in zip(rows["a"], rows["b"], rows["ta"], rows["tb"], strict=True):
        x, y = grams(a, ta), grams(b, tb)
        both = len(x & y)
        out.append(100 * both >= 75 * (len(x) + len(y) - both))
    return pd.Series(out)


def _fits(n: str, m: str):
    """Sizes that allow 75 %."""
    return (F.col(n) * 4 >= F.col(m) * 3) & (F.col(m) * 4 >= F.col(n) * 3)


def _reaches(n: str, i: str, m: str, j: str):
    """Whether sets of sizes n and m whose first common elements stand at i and j can have the overlap
    that 75 % needs, 3/7 of n + m. The first common element of a similar pair always passes."""
    return 7 * F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= 3 * (F.col(n) + F.col(m))


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id and, unless `counts` is
    false, n_links (documents of other ids that it is linked with)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_keys(docs, "text"))  # at most MAX_HOT keys
    rows = cut(docs.mapInArrow(lambda b: _members(b, *shared.value), "doc_id long, n long, few long, cls long, grp long, at long, common array<long>"))
    own = rows.where("n > 0")
    every_class = cut(own.groupBy("grp", "cls", "n").agg(F.min("doc_id").alias("rep"), F.min("few").alias("few"), F.count_distinct("doc_id").alias("copies")))
    classes = every_class.where("rep is not null")
    postings = docs.mapInArrow(lambda b: _postings(b, *shared.value), "e long, doc long, n int, i int")
    group_of = own.select(F.col("doc_id").alias("doc"), "grp").distinct()

    # Other elements: few documents hold each, and all pairs of those are candidates.
    runs = postings.repartition("e").sortWithinPartitions("e")
    pairs = runs.mapInArrow(_pairs_of_runs, "doc long, doc2 long").distinct()
    pairs = pairs.join(group_of, "doc").join(group_of.select(F.col("doc").alias("doc2"), F.col("grp").alias("grp2")), "doc2")
    pairs = pairs.where("grp <> grp2").select(F.least("grp", "grp2").alias("grp"), F.greatest("grp", "grp2").alias("grp2")).distinct()
    # Expanded to the groups' distinct sets.
    c1 = classes.select("grp", F.col("rep").alias("a"), F.col("n").alias("na"))
    c2 = classes.select(F.col("grp").alias("grp2"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    cold = pairs.join(c1, "grp").join(c2, "grp2").where(_fits("na", "nb")).select("a", "b")

    # Frequent elements, and the sets of one group: lists of any length, cut into bands of size.
    # Sets whose sizes allow 75 % are in the same band or in neighbouring ones.
    common = own.where("common is not null").select("grp", "at", F.posexplode("common").alias("i", "e")).select("e", "grp", (F.col("i") + F.col("at")).cast("int").alias("i")).distinct()
    listed = common.join(classes, "grp").select("e", "i", "rep", "n", "few")
    several = classes.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    listed = listed.unionByName(classes.join(several, "grp").select(F.col("grp").alias("e"), F.lit(0).alias("i"), "rep", "n", "few"))
    listed = listed.withColumn("own", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int"))
    listed = cut(listed.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1))))
    # A hub is the set with the least share of elements of its own: of near copies the one with the
    # fewest changes, to which most of the others are near.
    central = F.struct((F.col("few") / F.col("n")).alias("s"), F.xxhash64("rep").alias("h"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("i").alias("hub_i"))
    # Summed in two steps, so that the list of an element is never in one task.
    parts = listed.groupBy("e", "band", F.pmod(F.xxhash64("rep"), F.lit(64)).alias("salt")).agg(F.count("*").alias("k"), F.min(central).alias("_h"))
    # Written first: a join right above an aggregation could not be split at a long list.
    hubs = cut(parts.groupBy("e", "band").agg(F.sum("k").alias("k"), F.min("_h").alias("_h")).where("k > 1").select("e", "band", "_h.hub", "_h.hub_n", "_h.hub_i"))
    star = listed.join(hubs, ["e", "band"]).where(_fits("n", "hub_n") & _reaches("n", "i", "hub_n", "hub_i")).select(F.col("rep").alias("a"), F.col("hub").alias("b"))

    pairs = _pairs(cold.unionByName(star))
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(listed.select(F.col("rep").alias("doc_id")))
    texts = cut(docs.join(ids_of(wanted), "doc_id", "left_semi"))
    edges = _verified(texts, pairs)
    parts = components(edges)
    # What hubs left apart: in lists with several components, sets of all but the largest one
    # are paired with every set of another component.
    tagged = listed.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component", "few")
    per = tagged.groupBy("e", "band", "comp").agg(F.count("*").alias("k"))
    open_lists = cut(per.groupBy("e", "band").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where("parts > 1").drop("parts"))
    tagged = cut(tagged.join(open_lists, ["e", "band"]))
    rest = tagged.where("comp <> main").select("e", "band", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("own").alias("oa"), F.col("comp").alias("ca"))
    every = tagged.select("e", "band", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("own").alias("ob"), F.col("comp").alias("cb"), "main")
    # A pair that shares two bands is taken in the upper one's list.
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & (F.greatest("oa", "ob") == F.col("band"))
    left_over = rest.join(every, ["e", "band"]).where(apart & _fits("na", "nb") & _reaches("na", "ia", "nb", "ib")).select("a", "b")
    more = _verified(texts, _pairs(left_over))
    if not more.isEmpty():
        parts = components(edges.unionByName(more))
    same = own.select("doc_id", "n", "cls", "grp").join(every_class.drop("few"), ["grp", "cls", "n"])
    named = same.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), "copies")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    if not counts:
        return named.unionByName(none).drop("copies")
    others = link_counts(texts, classes.join(parts.withColumnRenamed("node", "rep"), "rep").select("rep", "component", "n", "copies"))
    named = named.join(others.withColumnRenamed("rep", "class_id"), "class_id", "left")
    links = F.col("copies") - F.when(F.col("doc_id").isNotNull(), 1).otherwise(0) + F.coalesce("others", F.lit(0))
    none = none.withColumn("others", F.lit(0).cast("long"))
    return named.unionByName(none).select("doc_id", "n_shingles", "class_id", "component_id", F.when(F.col("n_shingles") > 0, links).otherwise(0).cast("long").alias("n_links"))


def link_counts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, others: how many documents of other classes are linked with the class of rep.

    classes: rep, component, n, copies, of components with several classes; texts has those of every rep."""
    size = classes.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_ELEMENTS, F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    c = classes.join(size, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A set meets each block of its component once: in the pair of that block and its own.
    c = c.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "component", "copies", "own", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"))
    met = c.join(texts.select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"]), "rep")
    return met.groupBy("component", "i", "j").applyInArrow(_count_links, "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))


def _count_links(rows: pa.Table) -> pa.Table:
    """Of a pair of blocks: per set the copies of the sets it is linked with."""
    sets = [shingles(words_of(t.as_py())) for t in rows["text"]]
    own, copies = rows["own"].to_numpy(), rows["copies"].to_numpy()
    crossing = rows["i"][0].as_py() != rows["j"][0].as_py()
    n = np.array([len(s) for s in sets], np.int64)
    both, out = common_elements(sets), np.zeros(len(sets), np.int64)
    for lo in range(0, len(sets), 256):
        part = both[lo : lo + 256].astype(np.int64)
        alike = 100 * part >= 75 * (n[lo : lo + 256, None] + n[None, :] - part)
        alike[np.arange(len(part)), np.arange(lo, lo + len(part))] = False
        if crossing:
            alike &= own[lo : lo + 256, None] != own[None, :]
        out[lo : lo + 256] = alike @ copies
    return pa.table({"rep": rows["rep"], "others": out})


def common_elements(sets: list[np.ndarray], many: int = 24) -> np.ndarray:
    """Size of the intersection of each two sets. Elements that `many` sets hold are columns of a matrix
    that is multiplied with itself, a stretch of columns at a time; the others are added pair by pair."""
    k = len(sets)
    held = np.concatenate(sets) if k else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(held)))
    column = np.repeat(np.arange(len(first)), count)
    both = np.zeros((k, k), np.float32)
    wide = np.flatnonzero(count >= many)
    place = np.full(len(first), -1)
    place[wide] = np.arange(len(wide))
    of = place[column]
    for lo in range(0, len(wide), 2_048):
        here = (of >= lo) & (of < lo + 2_048)
        x = np.zeros((k, min(2_048, len(wide) - lo)), np.float32)
        x[owner[here], of[here] - lo] = 1
        both += x @ x.T
    few = (count[column] > 1) & (of < 0)
    column, owner = column[few], owner[few]
    for d in range(1, many):
        at = np.flatnonzero(column[d:] == column[:-d]) if len(column) > d else ()
        if not len(at):
            break
        np.add.at(both, (owner[at], owner[at + d]), 1)
        np.add.at(both, (owner[at + d], owner[at]), 1)
    return both


def _pairs(candidates: DataFrame) -> DataFrame:
    return cut(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose texts are alike, decided on their words."""
    j = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def alike(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            for k in range(0, len(rows), 500):
                part = rows.iloc[k : k + 500]
                yield part.loc[_alike(part).to_numpy(dtype=bool), ["a", "b"]]

    return cut(j.select("a", "b", "ta", "tb").mapInPandas(alike, "a long, b long").distinct())
