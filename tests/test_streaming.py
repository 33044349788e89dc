"""Request stream: restart from the checkpoint neither loses nor duplicates output."""

import os
import shutil

from pyspark.sql import functions as F

from rankloom.streaming import scoring

from conftest import SF001


def test_restart_from_checkpoint_is_exactly_once(spark, tmp_path):
    src = tmp_path / "requests"
    src.mkdir()
    shutil.copy(f"{SF001}/benchmark.parquet", src / "part-0.parquet")
    schema = spark.read.parquet(str(src)).schema

    def score(batch):
        # stateless per-batch scoring: a deterministic projection of each request
        return batch.select("item_id", F.length("text").alias("n_chars"))

    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):       # the second start finds every offset committed
        q = scoring.score_stream(scoring.file_request_stream(spark, str(src), schema), score, out, ck)
        q.awaitTermination()
        assert q.exception() is None
    first = spark.read.parquet(out)
    assert first.count() == spark.read.parquet(str(src)).count()
    assert first.select("batch_id").distinct().count() == 1

    shutil.copy(f"{SF001}/benchmark.parquet", src / "part-1.parquet")   # a new request file arrives
    q = scoring.score_stream(scoring.file_request_stream(spark, str(src), schema), score, out, ck)
    q.awaitTermination()
    both = spark.read.parquet(out)
    assert both.count() == 2 * first.count()
    assert both.select("batch_id").distinct().count() == 2


def test_batches_through_the_request_path_leave_no_tables(spark):
    """Three micro-batches give the batch result and remove what they wrote on the way."""
    from rankloom.plans import registry
    from rankloom.session import ensure_checkpoint_dir
    from tools.oracle_check import rows_of

    rows = lambda df: rows_of(df.columns, [tuple(r) for r in df.collect()])
    batch = rows(registry.QUERIES["recommend_requests"](spark, SF001))
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(f"{base}/rankloom"))
    out = registry.QUERIES["stream_requests"](spark, SF001)
    assert rows(out) == batch
    new = {n.rpartition("-")[0] for n in set(os.listdir(f"{base}/rankloom")) - before}
    assert new == {"stream_requests"}                      # the result itself


def test_a_batch_leaves_no_shuffle_files(spark, tmp_path):
    """Disk follows one micro-batch, not all of them."""
    import glob

    src = tmp_path / "requests"
    src.mkdir()
    for i in range(3):
        shutil.copy(f"{SF001}/benchmark.parquet", src / f"part-{i}.parquet")
    schema = spark.read.parquet(str(src)).schema
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffles():
        return {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}

    seen, before = [], shuffles()

    def score(batch):
        seen.append(len(shuffles() - before))
        return batch.groupBy("item_id").agg(F.max(F.length("text")).alias("n_chars"))

    requests = scoring.file_request_stream(spark, str(src), schema, max_files_per_trigger=1)
    q = scoring.score_stream(requests, score, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert q.exception() is None and len(seen) == 3
    assert seen == [0, 0, 0] and not shuffles() - before
