from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import common as C


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_without_a_shared_folder_raises():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            C.shared_dir(session(master))
        assert C.shared_dir(session(master, "s3a://b/c/")) == "s3a://b/c/brindle"
    assert all(C.shared_dir(session(m)).startswith("file:") for m in ("local", "local[8]", "local[*]", "local[2,3]"))


def test_tables_between_steps_can_be_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "shared_dir", lambda s: f"file://{tmp_path}/brindle")
    kept = C.materialise(spark.range(5), "numbers")
    assert kept.count() == 5 and list(tmp_path.glob("brindle/*/numbers-*"))
    assert C.clean_shared(spark) and not list(tmp_path.glob("brindle/*/numbers-*"))
    assert not C.clean_shared(spark)


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    def sizes(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    docs = spark.range(200, numPartitions=1).selectExpr("repeat('x', 100000) as text")
    got = [r.n for r in C.in_batches(docs, sizes, "n long").collect()]
    assert sum(got) == 200 and max(got) * 100_000 <= 2 * C.BATCH_BYTES
    given = pa.table({"a": list(range(1000))}).to_batches(max_chunksize=10)
    whole = list(C.gathered(iter(given), 800))
    assert [b.num_rows for b in whole] == [100] * 10 and pa.Table.from_batches(whole)["a"].to_pylist() == list(range(1000))
    assert list(C.gathered(iter([]), 800)) == []


def test_tables_of_few_row_groups_are_dealt_over_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    parts = lambda df: df.select(F.spark_partition_id()).distinct().count()
    rows = spark.range(2000, numPartitions=1).selectExpr("id", "id AS _metadata", "repeat('x', 20) AS text")
    rows.write.parquet(f"{tmp_path}/one.parquet")
    one = C.table(spark, str(tmp_path), "one")
    assert parts(one) == cores and one.columns == rows.columns and sorted(one.collect()) == sorted(rows.collect())
    rows.repartition(cores).write.parquet(f"{tmp_path}/many.parquet")
    many = C.table(spark, str(tmp_path), "many")
    assert "REPARTITION" not in many._jdf.queryExecution().toString().upper() and many.count() == 2000
    rows.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    assert C.table(spark, str(tmp_path), "none").collect() == []
