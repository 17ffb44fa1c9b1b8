"""Token files: the library's ids exactly, the order of documents, encodings, page indexes and selective reads."""

import zlib

import numpy as np
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tradeflow.llm import tokenfiles  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (5, "The cat's hat, it'll do"), (None, "no id"), (2, None), (3, ""), (3, "same id, other text"), (9, "été J̌ İstanbul ª ² x\x1fy a b"),
    (7, "tab\tand\r\nline <|endoftext|> mid<|startoftext|>dle < | >"), (8, "中文字 " * 40), (10, "again"), (10, "again"), (4, "word " * 30_000), (11, "n" * 50_000), (12, "ΣΣΣ σΣ. ẞ"),
]


def expected(rows, end_id=2, path=WORDS):
    """By brute force: whole texts through the library, rows in order."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end_id]) for i, x in rows]


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(list(" \n'<|>́̇ 　中한Σ"))), max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_are_the_librarys(text):
    words = tokenfiles._loaded.setdefault("test", tokenfiles._loaded.get("test") or tokenfiles.Words(WORDS))
    assert words.splits
    assert np.frombuffer(words(text), "<u4").tolist() == words.whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    words = tokenfiles.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not words.splits
    assert np.frombuffer(words("two  spaces\n kept"), "<u4").tolist() == words.whole.encode("two  spaces\n kept", add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tmp_path, encoding):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    docs = docs.selectExpr("*", "1 AS shard", "2 AS ids", "3 AS `start`", "4 AS _h", "5 AS id")
    path = f"file://{tmp_path}/t"
    tokenfiles.write(docs, path, WORDS, encoding=encoding, row_group_bytes=1 << 16, page_bytes=4_096, page_rows=2)
    got = sorted(((r["doc_id"], list(r["ids"]), r["start"], r["n_tokens"]) for r in tokenfiles.documents(spark, path).collect()), key=lambda r: r[2])
    assert sorted((-1 if i is None else i, ids) for i, ids, _, _ in got) == sorted((-1 if i is None else i, ids) for i, ids in expected(ROWS))
    assert [-1 if r[0] is None else r[0] for r in got] == sorted(-1 if i is None else i for i, _ in ROWS)
    at = 0
    for _, ids, start, n in got:
        assert (start, n) == (at, len(ids))
        at += n
    crc = {(r["start"], r["ids_crc32"]) for r in tokenfiles.digests(spark, path).collect()}
    assert crc == {(s, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, ids, s, _ in got}
    # The order of files is that of shards, and rows of a file ascend.
    files = sorted(ds.dataset(tmp_path / "t/tokens", exclude_invalid_files=True).files)
    starts = [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()]
    assert [-1 if x is None else x for x in starts] == sorted(-1 if i is None else i for i, _ in ROWS)
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            c = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            ids = next(v for k, v in c.items() if k.startswith("ids"))
            assert ids.has_offset_index and c["doc_id"].has_column_index
            assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary")
            assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")


def test_row_groups_and_pages_are_small_and_skipped(spark, tmp_path):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' other words '), 20) AS text").coalesce(1)
    path = f"file://{tmp_path}/t"
    tokenfiles.write(docs, path, WORDS, row_group_bytes=1 << 14, page_bytes=1 << 12, page_rows=50)
    f = max(ds.dataset(tmp_path / "t/tokens", exclude_invalid_files=True).files)
    assert pq.ParquetFile(f).metadata.num_row_groups > 2
    some = tokenfiles.documents(spark, path, 1_000, 1_009)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1000)" in plan and "LessThanOrEqual(doc_id,1009)" in plan
    assert [r["doc_id"] for r in some.orderBy("doc_id").collect()] == list(range(1_000, 1_010))
    light = tokenfiles.documents(spark, path, ids=False)
    assert "ids" not in light.columns and "ids" not in light._jdf.queryExecution().executedPlan().toString()
    # Positions: the stream cut anywhere is the stream.
    whole = [x for r in sorted(tokenfiles.documents(spark, path).collect(), key=lambda r: r["start"]) for x in r["ids"]]
    for lo, hi in ((0, 1), (12_345, 13_456), (len(whole) - 7, len(whole) + 5), (5, 5), (0, len(whole))):
        part = sorted(tokenfiles.token_range(spark, path, lo, hi).collect(), key=lambda r: r["start"])
        assert [x for r in part for x in r["ids"]] == whole[lo:hi]
        assert all(whole[r["start"] : r["start"] + len(r["ids"])] == list(r["ids"]) for r in part)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = tokenfiles.token_range(spark, path, 12_345, 13_456)._jdf.queryExecution().explainString(formatted)
    assert any("PushedFilters" in x and "LessThan(offset," in x for x in plan.splitlines())


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert tokenfiles.documents(spark, path).count() == 0 and tokenfiles.digests(spark, path).count() == 0 and tokenfiles.token_range(spark, path, 0, 5).count() == 0


def test_query_over_the_table(spark):
    from tradeflow.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    at, want = 0, []
    for i, ids in expected(rows):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    d = queries.QUERIES["op11_token_files"](spark, sf)
    assert d.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in d.collect()) == want
