"""State of streams: seen ids in buckets, folded and replayed."""

from pyspark.sql import functions as F

from graphloom.streaming import seen


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def batch(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_seen_ids_are_read_by_bucket(spark, tmp_path):
    state = str(tmp_path)
    seen.remember(batch(spark, *(f"p{i}" for i in range(200))), state, 0, 64, fold_every=1)
    fresh = seen.leave_out_seen(batch(spark, "p7", "q7"), state, 1, 64)
    assert ids(fresh) == ["q7"]
    mine = [r[0] for r in batch(spark, "p7", "q7").select(seen.bucket_of(F.col("id"), 64)).collect()]
    read = seen.seen_before(spark, state, 1).filter(F.col("bucket").isin(mine))
    assert 0 < len(read.inputFiles()) and read.select(F.input_file_name()).distinct().count() <= 2
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in read._jdf.queryExecution().toString()


def test_a_fold_keeps_all_ids_and_its_batch_can_be_replayed(spark, tmp_path):
    state = str(tmp_path)
    for n in range(8):
        seen.remember(batch(spark, f"a{n}", "b"), state, n, 8, fold_every=3)
    assert seen._numbered(spark, f"{state}/base", "upto") == [2, 5] and seen._numbered(spark, f"{state}/log", "batch") == [3, 4, 5, 6, 7]
    assert set(ids(seen.seen_before(spark, state, 8))) == {"b", *(f"a{n}" for n in range(8))}
    assert ids(seen.leave_out_seen(batch(spark, "a0", "a6", "a7", "c"), state, 7, 8)) == ["a7", "c"]  # batch 7 again
    assert ids(seen.leave_out_seen(batch(spark, "a2", "a5"), state, 5, 8)) == ["a5"]  # the batch that was folded, again
    seen.remember(batch(spark, "a5"), state, 5, 8, fold_every=3)
    assert set(ids(seen.seen_before(spark, state, 6))) == {"a0", "a1", "a2", "a3", "a4", "a5", "b"}


def test_nothing_seen_yet(spark, tmp_path):
    assert ids(seen.leave_out_seen(batch(spark, "x"), f"{tmp_path}/none", 0)) == ["x"]
