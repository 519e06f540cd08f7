import pyarrow as pa

from codeframes.llm.common import BATCH_BYTES, FALLBACK_SHARED, bound_batches, held_out, join_heads, shared_dir, slices, text_slices, written


def test_slices_cover_all_rows_in_order():
    texts = [None, "a" * 10, "", "b" * 100, "c", None, "d" * 7]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    for rows, size in ((1, 1000), (3, 12), (512, 1 << 20), (512, 1)):
        parts = [p.column("text").to_pylist() for p in slices(batch, rows=rows, size=size)]
        assert [t for p in parts for t in p] == texts and all(0 < len(p) <= rows for p in parts)
        parts = list(text_slices(texts, rows=rows, size=size))
        assert [t for p in parts for t in p] == texts and all(0 < len(p) <= rows for p in parts)
    assert list(slices(batch.slice(0, 0))) == [] and list(text_slices([])) == []


def test_batches_are_only_lowered(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1048576b")
        bound_batches(spark)
        assert spark.conf.get(key) == "1048576b"
        spark.conf.set(key, "1073741824b")
        bound_batches(spark)
        assert spark.conf.get(key) == f"{BATCH_BYTES}b"
    finally:
        spark.conf.set(key, before)


def test_shared_folder_is_that_of_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_SHARED
    assert shared_dir(spark, "x").startswith(base) and shared_dir(spark, "x") != shared_dir(spark, "x")
    out = written(spark.createDataFrame([], "a int, b string"), "empty")
    assert out.count() == 0 and out.columns == ["a", "b"]


def test_held_out(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (*range(50), None)], "doc_id long").select("doc_id", held_out().alias("h"))
    assert {r.doc_id: r.h for r in df.collect()} == {**{i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}, None: False}


def test_heads_of_hot_keys_meet_their_members_in_several_tasks(spark):
    from pyspark.sql import functions as F

    rows = [(7, 1)] * 3000 + [(i, i) for i in range(100)] + [(200, 0)]  # equal rows too; 200 has no head
    members = written(spark.createDataFrame(rows, "k long, x long"), "members")
    heads = written(members.filter("k < 200").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")), "heads")
    got = join_heads(members, heads, "k")
    assert got.columns == ["k", "x", "top"]
    assert sorted(map(tuple, got.collect())) == sorted((k, x, 7 if k == 7 else k) for k, x in rows if k < 200)
    alone = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in alone}
    for k, v in alone.items():
        spark.conf.set(k, v)
    try:
        spread = join_heads(members, heads, "k").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in spread) == 3100 and max(r["count"] for r in spread) < 1500
    assert join_heads(members.limit(0), heads.limit(0), "k").count() == 0
