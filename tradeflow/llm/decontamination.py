"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 10).

A text contains an item if some stretch of it is within `ratio` x item length edits of the item
(both lower-cased, white space runs as one space). Item-sized windows of the text are embedded
by the CGK random walk, which turns edit distance into Hamming distance; repeated samples of
embedding positions are the LSH keys, looked up among the items' keys. Each hit is verified by
an exact infix edit distance around the window, unless too few of the item's 5-grams stand there
for any such stretch (an edit changes five at most, so nothing is lost by that).

Which windows are embedded: an edit changes at most 8 (of a longer code point, more) of an item's
8-byte grams and moves those after it by a code point (taken as wide as the item's widest), so a stretch within the edits holds a known number of
the item's grams on neighbouring diagonals (position in the text less position in the item). Where an
item has that many, the windows that start at words there or on one of those diagonals are embedded;
short items are counted by 5-byte grams. Like the count before verification this loses nothing: what
recall is lost is lost by LSH alone, and is measured in the tests at the full ratio, for edits at random
places and for evenly spread ones. Grams that very many items share are left out of an item's count and
taken off what is asked of it, where enough others are left.

Items of nearly one length are compared by their beginnings of one length; verification is of the whole item.

At scale: one pass over documents, no shuffle but for the distinct hits; memory of one slice of an Arrow
batch. The benchmark's tables are made once and broadcast in blocks of at most `block_bytes` of item text;
a larger benchmark is several passes.

Items under 24 bytes are too short to be embedded: with k edits allowed, one of an item's k + 1 pieces stands unedited in any
stretch, so all pieces of all short items are looked up at once and what stands around one is verified. Nothing is lost there.
They are found inside words too, unless `whole_words` is set.

Null and empty texts contain nothing; of very long ones the whole is searched. Repeated rows are found
like one. Null and empty items are skipped; items with equal texts are all reported.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the byte grams that are counted before windows are embedded: long where the item allows it.
LONG, SHORT = 8, 5
LEAST = 24
#: Length of the character grams that are counted before edits are.
CHARS = 5
#: A gram that stands at more places of items is left out where an item can do without it.
COMMON = 64
#: Zero bytes between texts.
APART = 16


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").split())


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """All grams of q bytes of a, as one integer for each position."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q == 8:
        out = np.empty(n, np.uint64)
        for o in range(8):
            k = (len(a) - o) // 8
            out[o::8] = a[o : o + 8 * k].view("<u8")[: len(out[o::8])]
        return out
    out = a[:n].astype(np.uint64)
    for j in range(1, q):
        out = (out << np.uint64(8)) | a[j : n + j]
    return out


class Cgk:
    """Random walks for one set of parameters; the same seed gives the same walks everywhere."""

    def __init__(self, walks: int, tables: int, sampled: int, seed: int):
        self.walks, self.tables, self.sampled, self.seed = walks, tables, sampled, seed

    def keys(self, rows: np.ndarray, length: int) -> np.ndarray:
        """rows: windows of `length` bytes, zero-padded. (windows, walks x tables) keys of uint64."""
        n, w = len(rows), self.walks
        steps = 3 * length // 2
        flat = np.concatenate([rows, np.zeros((n, 1), np.uint8)], 1).ravel().astype(np.int64)
        rng = np.random.default_rng((self.seed, length))
        moves = rng.integers(0, 2, (steps, w * 256), dtype=np.int64)
        at = rng.integers(0, steps, (w, self.tables, self.sampled))
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for (k, t, s), j in np.ndenumerate(at):
            wanted.setdefault(int(j), []).append((k, t, s))
        key = np.zeros((w, self.tables, n), np.uint64)
        i = np.tile(np.arange(n, dtype=np.int64) * (length + 1), (w, 1))
        last = i + length
        table = np.arange(w, dtype=np.int64)[:, None] * 256  # each walk has its own moves
        for j in range(max(wanted) + 1):
            c = flat.take(i)
            for k, t, s in wanted.get(j, ()):
                # A sum of products of sample and its own odd number: order does not matter.
                key[k, t] += (c[k].astype(np.uint64) + np.uint64(1)) * np.uint64(((t * 131 + s + 1) * 0x9E3779B97F4A7C15 | 1) & 0xFFFFFFFFFFFFFFFF)
            i += moves[j].take(c + table)
            if j >= length:
                np.minimum(i, last, out=i)
        key ^= np.arange(w, dtype=np.uint64)[:, None, None] * np.uint64(0x100000001B3)
        return key.reshape(w * self.tables, n).T


def infix_distance(item: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of item to a stretch of text, and where the first best one ends;
    most + 1 if there is none within `most`. Bit-parallel over the item."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << i)
    pv, mv, score, best, end = mask, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        score += (1 if ph & high else 0) - (1 if mh & high else 0)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def can_hold(grams_of_item: list[str], text: str, most: int) -> bool:
    """False only where no stretch of text is within `most` edits of the item: an edit changes at most
    CHARS of the item's grams, and the others must stand in the text."""
    there = {text[i : i + CHARS] for i in range(len(text) - CHARS + 1)}
    return sum(map(there.__contains__, grams_of_item)) >= len(grams_of_item) - CHARS * most


class Seeds:
    """Where the items' grams of one length stand, and how many of an item a stretch must hold."""

    def __init__(self, q: int, own: list[int], texts: list[bytes], least: list[int]):
        self.q = q
        g = [grams(np.frombuffer(texts[k], np.uint8), q) for k in own]
        gram, item = np.concatenate(g), np.repeat(np.array(own), [len(x) for x in g])
        offset = np.concatenate([np.arange(len(x)) for x in g])
        _, back, count = np.unique(gram, return_inverse=True, return_counts=True)
        shared = count[back] > COMMON
        # What stays of the asked number without the shared grams; where it is little, the item keeps them.
        asked = np.array(least, np.int64)
        without = asked - np.bincount(item[shared], minlength=len(asked))
        spare = without >= 4
        asked[spare] = without[spare]
        keep = ~(shared & spare[item])
        gram, item, offset = gram[keep], item[keep], offset[keep]
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.offset, self.asked = gram[order], item[order], offset[order], asked
        self.bits = max(20, min(28, int(np.ceil(np.log2(16 * len(gram) + 1)))))
        self._seen: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_seen": None}  # cheap to make, large to send

    def _slots(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def starts(self, a: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place): places of a where the item may start, by diagonals that hold enough of its grams
        within twice its reach; a place stands for those within the reach."""
        if self._seen is None:
            self._seen = np.zeros(1 << self.bits, bool)
            self._seen[self._slots(self.gram)] = True
        g = grams(a, self.q)
        pos = np.flatnonzero(self._seen[self._slots(g)])
        lo, hi = np.searchsorted(self.gram, g[pos], "left"), np.searchsorted(self.gram, g[pos], "right")
        many = hi - lo
        pos, lo, many = pos[many > 0], lo[many > 0], many[many > 0]
        if not len(pos):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item, diag = self.item[x], np.repeat(pos, many) - self.offset[x]
        key = np.sort((item << np.int64(40)) + diag + 1_000_000)  # diagonals before the first byte count too
        item = key >> np.int64(40)
        held = np.searchsorted(key, key + 2 * reach[item], "right") - np.arange(len(key))
        ok = held >= self.asked[item]
        return item[ok], (key[ok] & np.int64((1 << 40) - 1)) - 1_000_000


class Finder:
    """Finds a block of items in batches of texts."""

    def __init__(self, items: list[tuple[int, str]], ratio: float, walks: int, tables: int, sampled: int, seed: int, band: float, whole_words: bool = False):
        norm = [(i, normal(t)) for i, t in items]
        self.short = [(i, x, int(ratio * len(x))) for i, x in ((i, t.decode("utf-8", "replace")) for i, t in norm if 0 < len(t) < LEAST)]
        self.whole_words = whole_words
        self.pieces = self._pieces()
        self.items = [(i, t) for i, t in norm if len(t) >= LEAST]
        self.text = [t.decode("utf-8", "replace") for _, t in self.items]
        self.most = [int(ratio * len(t)) for t in self.text]
        self.chars = [[t[i : i + CHARS] for i in range(len(t) - CHARS + 1)] for t in self.text]
        self.cgk = Cgk(walks, tables, sampled, seed)
        raw = [t for _, t in self.items]
        # An edit moves what follows by a code point, of as many bytes as the item's widest one.
        self.reach = np.array([m * max(len(c.encode()) for c in set(t)) for m, t in zip(self.most, self.text, strict=True)], np.int64)

        def least(k: int, q: int) -> int:
            widest = sorted((len(c.encode()) for c in self.text[k]), reverse=True)[: self.most[k]]
            return len(raw[k]) - q + 1 - sum(q - 1 + x for x in widest)

        long = [k for k in range(len(raw)) if least(k, LONG) >= 6]
        few = sorted(set(range(len(raw))) - set(long))
        self.seeds = [Seeds(q, own, raw, [max(1, least(k, q)) for k in range(len(raw))]) for q, own in ((LONG, long), (SHORT, few)) if own]
        # Items of nearly one length share a window length: the least of them.
        self.bands: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.band_of = np.zeros(len(raw), np.int64)
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        while order:
            n = len(raw[order[0]])
            own = [k for k in order if len(raw[k]) <= n * (1 + band)]
            order = order[len(own) :]
            self.band_of[own] = len(self.bands)
            rows = np.stack([np.frombuffer(raw[k][:n], np.uint8) for k in own])
            keys = self.cgk.keys(rows, n)
            width = keys.shape[1]
            flat = keys.ravel()
            at = np.argsort(flat, kind="stable")
            self.bands.append((n, flat[at], np.repeat(np.array(own), width)[at], np.tile(np.arange(width), len(own))[at]))

    def _windows(self, a: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per band the places where windows start, and sorted (item, place) of its items as one number."""
        first = (a > 32) & np.concatenate([[True], a[:-1] <= 32])
        # In a run of more than 24 bytes without a space every code point is a start.
        gap = np.concatenate([[0], np.cumsum(a <= 32, dtype=np.int32)])
        inside = np.zeros(len(a), bool)
        if len(a) > LEAST:
            inside[: len(a) - LEAST] = gap[LEAST:-1] == gap[: -LEAST - 1]
            tail = np.flatnonzero(inside)
            inside[np.minimum(tail[:, None] + np.arange(LEAST), len(a) - 1).ravel()] = True
        word = np.flatnonzero(first | (inside & ((a & 0xC0) != 0x80) & (a > 32)))
        item, place = zip(*[s.starts(a, self.reach) for s in self.seeds], strict=True)
        item, place = np.concatenate(item), np.concatenate(place)
        for band in np.unique(self.band_of[item]):
            here = self.band_of[item] == band
            at, r = place[here], self.reach[item[here]] + 1
            # Word starts in any of the intervals, and the diagonals themselves.
            edge = np.zeros(len(word) + 1, np.int32)
            np.add.at(edge, np.searchsorted(word, at - r), 1)
            np.add.at(edge, np.searchsorted(word, at + r, "right"), -1)
            near = word[np.cumsum(edge[:-1]) > 0]
            yield int(band), np.unique(np.concatenate([near, at[(at >= 0) & (at < len(a))]])), np.sort((item[here] << np.int64(40)) + at + 1_000_000)

    def _pieces(self):
        """An automaton of the short items' pieces: (item, offset of the piece) of each."""
        import ahocorasick

        owners: dict[str, list[tuple[int, int]]] = {}
        for o, (_, x, k) in enumerate(self.short):
            cuts = [len(x) * j // (k + 1) for j in range(k + 2)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                owners.setdefault(x[lo:hi], []).append((o, lo))
        out = ahocorasick.Automaton()
        for piece, own in owners.items():
            out.add_word(piece, (len(piece), own))
        if owners:
            out.make_automaton()
        return out

    def _few(self, docs: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """Short items, by what stands around their pieces."""
        letter = lambda c: c.isalnum() and ord(c) < 0x2E80  # noqa: E731  scripts without spaces have no borders

        def inside(t: str, lo: int, hi: int) -> bool:
            return bool(lo and letter(t[lo - 1]) and letter(t[lo]) or hi < len(t) and letter(t[hi]) and letter(t[hi - 1]))

        for d, t in enumerate(docs):
            best: dict[int, int] = {}
            for last, (size, own) in self.pieces.iter(t):
                for o, offset in own:
                    i, x, k = self.short[o]
                    at = last + 1 - size - offset
                    if best.get(o, k + 1) == 0 or self.whole_words and inside(t, max(0, at), min(len(t), at + len(x))):
                        continue
                    low = max(0, at - k)
                    dist, to = infix_distance(x, t[low : at + len(x) + k], k)
                    if dist < best.get(o, k + 1):
                        best[o] = dist
                        yield d, i, low + to, dist

    def hits(self, texts: list) -> Iterator[tuple[int, int, int, int]]:
        """(index of the text, item id, end of the stretch, edits), some more than once."""
        docs = [normal(t) if t else b"" for t in texts]
        if self.short:
            yield from self._few([t.decode("utf-8", "replace") for t in docs])
        if not self.items or not any(docs):
            return
        start = np.cumsum([0, *[len(t) + APART for t in docs]])
        a = np.frombuffer(b"".join(t + b"\0" * APART for t in docs), np.uint8)
        checked: set[tuple[int, int, int]] = set()
        sure: dict[tuple[int, int], list[int]] = {}  # where an item is known to stand
        for band, places, likely in self._windows(a):
            n, keys, owner, column = self.bands[band]
            doc_of = np.searchsorted(start, places, side="right") - 1
            stop = start[doc_of + 1] - APART
            for part in range(0, len(places), 5_000):
                w, end = places[part : part + 5_000], stop[part : part + 5_000]
                span = w[:, None] + np.arange(n)
                rows = np.where(span < end[:, None], a[np.minimum(span, len(a) - 1)], 0).astype(np.uint8)
                for o, rows_of in self._candidates(self.cgk.keys(rows, n), keys, owner, column):
                    # Only where the item itself has enough grams; the windows are those of all items of the band.
                    key, reach = (np.int64(o) << np.int64(40)) + w[rows_of] + 1_000_000, self.reach[o] + 1
                    rows_of = rows_of[np.searchsorted(likely, key - reach) < np.searchsorted(likely, key + reach, "right")]
                    for r in rows_of:
                        d = int(doc_of[part + r])
                        at = int(w[r] - start[d])
                        step = self.most[o] // 2 + 8  # windows this near to each other are verified as one
                        if (d, o, at // step) in checked or any(abs(at - x) < 4 * n // 5 for x in sure.get((d, o), ())):
                            continue
                        checked.add((d, o, at // step))
                        low, stretch = self._around(docs[d], at, len(self.items[o][1]), self.most[o] + step)
                        if not can_hold(self.chars[o], stretch, self.most[o]):
                            continue
                        dist, to = infix_distance(self.text[o], stretch, self.most[o])
                        if dist <= self.most[o]:
                            sure.setdefault((d, o), []).append(at)
                            yield d, self.items[o][0], low + to, dist

    @staticmethod
    def _around(text: bytes, at: int, size: int, slack: int) -> tuple[int, str]:
        """`size` bytes from `at` with `slack` characters on both sides, and how many characters come before."""
        while at < len(text) and at > 0 and (text[at] & 0xC0) == 0x80:
            at -= 1
        before = text[max(0, at - 4 * slack) : at].decode("utf-8", "ignore")[-slack:]
        after = text[at : at + size].decode("utf-8", "ignore")
        rest = text[at + len(after.encode()) : at + size + 4 * slack].decode("utf-8", "ignore")[:slack]
        return len(text[:at].decode("utf-8", "replace")) - len(before), before + after + rest

    @staticmethod
    def _candidates(k: np.ndarray, keys: np.ndarray, owner: np.ndarray, column: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Per item the windows that share a key with it in the same table."""
        held = np.zeros(1 << 16, bool)  # by the keys' high bits, most windows' keys are no item's
        held[keys >> np.uint64(48)] = True
        r, c = np.nonzero(held[k >> np.uint64(48)])
        lo, hi = np.searchsorted(keys, k[r, c], "left"), np.searchsorted(keys, k[r, c], "right")
        r, c, lo, many = r[hi > lo], c[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        x = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(r) else np.zeros(0, np.int64)
        r, c = np.repeat(r, many), np.repeat(c, many)
        same = column[x] == c
        pairs = np.unique((owner[x[same]] << np.int64(32)) + r[same])
        if len(pairs):
            own, rows = pairs >> np.int64(32), pairs & np.int64(0xFFFFFFFF)
            cuts = np.flatnonzero(np.diff(own)) + 1
            for o, part in zip(np.split(own, cuts), np.split(rows, cuts), strict=True):
                yield int(o[0]), part


def found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", ratio: float = 0.1,
          walks: int = 5, tables: int = 20, sampled: int = 4, seed: int = 11, band: float = 0.2, block_bytes: int = 2_000_000, whole_words: bool = False) -> DataFrame:
    """Distinct (id, item_id) with the least edits and the end of that stretch in the normalised text.

    The defaults' recall, measured against brute force, is in the tests."""
    sc = docs.sparkSession.sparkContext
    rows = items.where(F.col(item_text).isNotNull()).select(item_id, item_text).orderBy(item_id).toLocalIterator()
    out_schema = f"{id_col} {dict(docs.dtypes)[id_col]}, {item_id} {dict(items.dtypes)[item_id]}, edits int, end_char long"
    ids = pa.int64() if dict(items.dtypes)[item_id] == "bigint" else None

    def one(block: list[tuple]) -> DataFrame:
        shared = sc.broadcast(Finder(block, ratio, walks, tables, sampled, seed, band, whole_words))  # of at most block_bytes of item text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = shared.value
            for b in batches:
                names = b.column(0)
                for lo, hi in _slices(b.column(1)):
                    got = list(finder.hits(b.column(1).slice(lo, hi - lo).to_pylist()))
                    if got:
                        d, i, e, k = zip(*got, strict=True)
                        yield pa.record_batch([names.take(pa.array([lo + x for x in d])), pa.array(i, ids), pa.array(k, pa.int32()), pa.array(e, pa.int64())], [id_col, item_id, "edits", "end_char"])

        return docs.select(id_col, text).mapInArrow(run, out_schema)

    parts, block, size = [], [], 0
    for r in rows:
        block.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= block_bytes:
            parts, block, size = [*parts, one(block)], [], 0
    if block or not parts:
        parts.append(one(block))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col, item_id).agg(F.min(F.struct("edits", "end_char")).alias("_m")).select(id_col, item_id, "_m.edits", "_m.end_char")


def _slices(column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes, so that memory does not follow the batch."""
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    lo, size = 0, 0
    for i, s in enumerate(sizes):
        size += int(s)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """docs without those that contain an item."""
    hit = found(docs, items, id_col, **kw).select(id_col).distinct()
    return docs.join(hit, id_col, "left_anti")
