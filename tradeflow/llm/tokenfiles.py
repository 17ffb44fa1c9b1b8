"""Token ids in Parquet files (operator 11).

A folder holds two tables. `tokens` has a row a document, in ascending order of ids over its files and within each:
the document's id, shard (its file), offset (token ids of the shard before it), n_tokens and ids, a list column.
`shards` has a row a file: its first and last document, numbers of documents and tokens, and start, the token ids of
all shards before it. A document's place in the whole stream is start plus offset.

Ids are dictionary-encoded or delta-encoded (ENCODINGS), row groups and pages have stated sizes, and the writer adds
page indexes. A reader of some documents or of a range of token positions therefore skips row groups and pages whose
ids, shards or offsets lie outside, and a reader of metadata never touches the ids (`documents`, `token_range`).

Texts are dealt out and sorted by document id, so that a task writes a file of consecutive documents: one shuffle of
the texts, one pass through the tokenizer, one write. No task holds more than an Arrow batch. Rows of one id (a third
of all rows may share one) lie side by side in the order of a hash of their texts; they may span several files.

A null or empty text has the end id alone. Rows without an id come first. Repeated rows are rows of their own. An empty
table gives two empty tables. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import scratch_root

#: Writer options by encoding. Version 2 of the format encodes numbers without a dictionary as bit-packed differences.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary#ids.list.element": "false"},
}
#: Distinct pieces whose ids a worker keeps; when there are more, it starts anew.
MOST_KEPT = 500_000
#: Characters of the longest piece that is kept.
LONGEST_KEPT = 40

_loaded: dict[str, Words] = {}


class Words:
    """Token ids of texts by a tokenizer file, as bytes of little-endian unsigned 32-bit integers.

    For tokenizers that lower-case, drop white space and merge within the pieces of a pattern (`splits` says whether a file is
    one; others encode whole texts): what stands between spaces is then encoded alone. Runs of words whose characters are their
    own normal form are cut by the file's own pattern, and each piece is merged by the library once and kept. All other
    words, and those with a special token's beginning, go through the library whole."""

    #: Characters up to U+024F but for white space, controls and U+0130, whose small form is two characters: they
    #: are their own normal form.
    PLAIN = "!-~¡-įı-ɏ"

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        self.pieces: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers") or []]
        #: The chain for which words stand alone and the short way is known to be the library's.
        self.splits = (
            normal == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and told["model"]["type"] == "BPE" and told["normalizer"]["normalizers"][1]["content"] == " "
        )
        if self.splits:
            self.plain = re.compile(f"[{self.PLAIN} \n]*").fullmatch
            bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
            chars = [chr(c) for c in range(0x21, 0x250) if self.plain(chr(c))]
            chars = sorted({*chars, *"".join(chars).lower()})
            # The pattern's classes of letters and numbers as the plain characters in them.
            among = lambda kind: "".join(re.escape(c) for c in chars if regex.fullmatch(kind, c))
            self.cut = re.compile(steps[0]["pattern"]["Regex"].replace(r"\p{L}", among(r"\p{L}")).replace(r"\p{N}", among(r"\p{N}"))).findall
            self.shown = str.maketrans({c: bytewise.pre_tokenize_str(c)[0][0] for c in chars})
            self.special = [t["content"][:2] for t in told["added_tokens"]]

    def _ids(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, text: str) -> bytes:
        """A text of plain words."""
        known, found = self.pieces, self.cut(text.lower())
        fresh = set(found).difference(known)
        for piece in fresh:
            ids = [t.id for t in self.whole.model.tokenize(piece.translate(self.shown))]
            known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join(map(known.__getitem__, found))
        for piece in fresh:
            if len(piece) > LONGEST_KEPT:
                del known[piece]
        return out

    def _odd(self, word: str) -> bytes:
        if len(word) > LONGEST_KEPT:
            return self._ids(word)
        if word not in self.odd:
            self.odd[word] = self._ids(word)
        return self.odd[word]

    def __call__(self, text: str) -> bytes:
        if not self.splits:
            return self._ids(text)
        for kept in (self.pieces, self.odd):
            if len(kept) > MOST_KEPT:
                kept.clear()
        special = any(s in text for s in self.special)
        if not special and self.plain(text):
            return self._run(text)
        out = []
        for plain, words in groupby(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), lambda w: bool(self.plain(w)) and not (special and any(s in w for s in self.special))):
            out += [self._run(" ".join(words))] if plain else map(self._odd, words)
        return b"".join(out)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in order to rows of `tokens`; the task's number is the shard's."""
    words = _loaded.get(path) or _loaded.setdefault(path, Words(path))
    shard, offset, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
    for batch in batches:
        at = 0
        texts = batch.column(1)
        while at < len(texts):
            begun, parts, sizes = at, [], [0]
            while at < len(texts) and sizes[-1] < 4_000_000:  # the ids of some documents at a time
                ids = words(texts[at].as_py() or "")
                parts += (ids, end)
                sizes.append(sizes[-1] + len(ids) // 4 + 1)
                at += 1
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            ends = np.array(sizes, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, at - begun), pa.array(np.full(at - begun, shard, np.int32)), pa.array(offset + ends[:-1].astype(np.int64)), pa.array(np.diff(ends).astype(np.int64)), lists], ["doc_id", "shard", "offset", "n_tokens", "ids"])
            offset += int(ends[-1])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10, page_rows: int = 2_000, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes `tokens` and `shards` of docs into the folder at path. tokenizer: a file of the tokenizers library that
    every executor has; end_id follows each document's ids."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    place = [F.col("id").asc_nulls_first(), F.col("_h"), F.col("_n")]
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(*place).sortWithinPartitions(*place).select("id", "text")
    fields = [("shard", T.IntegerType()), ("offset", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, k) for n, k in fields]])

    out = dealt.mapInArrow(lambda it: _encoded(it, tokenizer, end_id), schema).write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    out.options(**ENCODINGS[encoding]).parquet(f"{path}/tokens")
    rows = spark.read.schema(schema).parquet(f"{path}/tokens")
    shards = rows.groupBy("shard").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/shards")


def documents(spark: SparkSession, path: str, first=None, last=None, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids of the documents from first to last (None: no bound).

    Row groups and pages of other documents are skipped. `shards` is small, a row a file, and its join is left to Spark."""
    d = spark.read.parquet(f"{path}/tokens")
    if first is not None:
        d = d.where(F.col("doc_id") >= F.lit(first))
    if last is not None:
        d = d.where(F.col("doc_id") <= F.lit(last))
    starts = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("_start"))
    return d.join(starts, "shard").select("doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", *["ids"] * ids)


def token_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """doc_id, start and ids for the stream's positions from lo up to hi, of each document only what lies inside.

    The shards at both ends are looked up, so the files' own filters are on shard and offset."""
    shards = spark.read.parquet(f"{path}/shards").where((F.col("start") < hi) & (F.col("start") + F.col("n_tokens") > lo))
    ends = shards.agg(F.min(F.struct("shard", "start")).alias("a"), F.max(F.struct("shard", "start")).alias("b")).first()
    d = spark.read.parquet(f"{path}/tokens")
    if ends["a"] is None or lo >= hi:
        d = d.where("false")
    else:
        (a, at_a), (b, at_b) = ends["a"], ends["b"]
        d = d.where(F.col("shard").between(a, b) & ((F.col("shard") < b) | (F.col("offset") < hi - at_b)) & ((F.col("shard") > a) | (F.col("offset") + F.col("n_tokens") > lo - at_a)))
    d = d.join(shards.select("shard", F.col("start").alias("_start")), "shard")
    start = F.col("_start") + F.col("offset")
    skip = F.greatest(F.lit(lo) - start, F.lit(0)).cast("int")
    upto = F.least(F.lit(hi) - start, F.col("n_tokens")).cast("int")
    return d.select("doc_id", (start + skip).alias("start"), F.slice("ids", skip + 1, upto - skip).alias("ids"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(2)
        values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = np.fromiter((zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)), np.int64, len(lists))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian unsigned 32-bit integers), from the ids in the files."""
    d = documents(spark, path).select("doc_id", "start", "ids")
    return d.mapInArrow(_checked, T.StructType([d.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    import uuid

    return f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
