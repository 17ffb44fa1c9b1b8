"""Queries whose result SQL expresses, against that SQL; contracts of the others' columns."""

import duckdb
import pytest

from tradeflow.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op3_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_url_filters": ["page_id", "host", "path", "rule", "verdict"], "op6_jaccard_join": ["doc_id", "n_shingles", "component_id", "n_links"],
    "op7_license_scans": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    text = lambda r: tuple(str(x) for x in r)
    assert sorted(text(r[c] for c in order) for r in df.collect()) == sorted(text(r[cols.index(c)] for c in order) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(df.columns)
    rows = df.collect()
    whole = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op4') else 'documents'}.parquet").count()
    assert len(rows) == whole
    if name == "op1_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows) and {r["held_out"] for r in rows} == {True, False}
