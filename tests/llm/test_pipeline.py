import corpus_pipeline
from tradeflow.llm import decontamination, jaccard, mixing

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        if name == "sharding":
            assert {"shard", "slot"} <= set(out.columns) and len(ids) == before
            break
        assert out.columns == columns
        if name == "near copies":
            assert jaccard.linked(out).where("component_id <> doc_id").count() == 0
        if name == "benchmark":
            assert decontamination.found(out, items).count() == 0
        if name == "mixing":
            assert len(ids) == before
        docs, before = out, len(ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.columns[0] == "doc_id"


def test_odd_rows(spark, tmp_path):
    """Null columns, empty and repeated rows, and an empty table, through all stages."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id", "en", "s", 1), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "twice the same row", "en", None, 3), (9003, "twice the same row", "en", None, 3)], docs.schema)
    docs.limit(30).unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(None) == 1 and ids.count(9003) == 2 and {9001, 9002} <= set(ids)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0


def test_slots_follow_the_schedule(spark, tmp_path):
    """In each shard the documents stand in the order of the mix, read from files or handed over as a frame."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = {r["doc_id"]: r["position"] for r in mixing.mixed(docs, block_bytes=corpus_pipeline.BLOCK_BYTES).collect()}
    mix = corpus_pipeline.mix_sources(spark, docs, SF)
    mix.write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "mix"))
    for given in (spark.read.parquet(str(tmp_path / "mix")), mix.cache()):
        got = corpus_pipeline.shard(spark, given, SF).select("doc_id", "shard", "slot").collect()
        assert len(got) == len(order)
        for s in {r["shard"] for r in got}:
            own = sorted((r["slot"], order[r["doc_id"]]) for r in got if r["shard"] == s)
            assert [x for x, _ in own] == list(range(len(own))) and [p for _, p in own] == sorted(p for _, p in own)


def test_near_copies_send_no_text_for_few_ids(spark, monkeypatch):
    """Ids are broadcast whatever Spark's own threshold is, unless there are too many; the rows are the same."""
    from tradeflow.llm import util

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, rows = [], []
        for most in (util.MOST_IDS, 0):
            monkeypatch.setattr(util, "MOST_IDS", most)
            out = corpus_pipeline.drop_near_copies(spark, docs, SF)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            rows.append(sorted(map(str, out.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    assert rows[0] == rows[1] and 0 < len(rows[0]) < docs.count()
